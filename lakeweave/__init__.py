"""lakeweave: DataFrame operators for governed data assets and documents on Spark."""

__version__ = "0.1.0"
