"""Client analytics for service and retail businesses, as Spark DataFrame jobs."""

__version__ = "0.1.0"
