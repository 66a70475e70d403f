"""seqrec: interaction-sequence analytics and item recommendation on PySpark."""

__version__ = "0.1.0"
