"""Privacy checks, redaction and signed audit tables as Spark DataFrame jobs."""

__version__ = "0.1.0"
