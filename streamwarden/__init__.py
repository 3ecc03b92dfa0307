"""Stream monitoring on Spark: windows over sensor observations, rules, alerts."""

__version__ = "0.1.0"
