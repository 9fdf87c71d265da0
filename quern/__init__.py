"""quern: evidence scoring and text-corpus operators as Spark DataFrame plans."""

__version__ = "0.1.0"
