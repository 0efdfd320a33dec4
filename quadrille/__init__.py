"""quadrille: spatial analytics on plain Spark columns."""

__version__ = "0.1.0"
