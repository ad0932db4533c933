"""Plan-level helpers: size-checked broadcasts, report assembly, the query catalog."""
