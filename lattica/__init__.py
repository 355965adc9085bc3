"""lattica: irregular analytics (scatter, gather, sparse matrices, graphs) as Spark plans."""

__version__ = "0.1.0"
