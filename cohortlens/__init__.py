"""Weekly registration-cohort analytics for two-sided marketplaces, on Spark.

Every metric is a function from DataFrames to a DataFrame; nothing is
collected to the driver.  See README.md for the module map.
"""

from cohortlens.config import ReportConfig, SegmentRules  # noqa: F401
from cohortlens.sources.fixtures import Sources, load_sources  # noqa: F401
