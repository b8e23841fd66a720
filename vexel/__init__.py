"""vexel: vector search and metadata predicates planned as Spark DataFrames."""

__version__ = "0.1.0"
