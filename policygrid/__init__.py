"""policygrid: policy documents, chunks and indicator time series as Spark plans."""

__version__ = "0.1.0"
