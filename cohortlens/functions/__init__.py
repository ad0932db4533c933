"""Column-level helpers: all built-in Spark expressions (codegen, no UDFs)."""

from cohortlens.functions.weeks import week_of, weeks_after, spine_weeks_col, in_spine  # noqa: F401
from cohortlens.functions.predicates import like_all_not, organic_group  # noqa: F401
