"""sparquill: cross-sectional text-signal analytics expressed as Spark DataFrame plans."""
