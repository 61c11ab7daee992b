"""corpusloom: analytics over code and text corpora, expressed as Spark DataFrames."""

__version__ = "0.1.0"
