"""lodestone: document search, registry audit, data quality and publishing on Spark DataFrames."""

__version__ = "0.1.0"
