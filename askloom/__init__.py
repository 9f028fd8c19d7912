"""Question-and-answer corpus preparation, hybrid search and evaluation on Spark.

Every operator is a function from DataFrames to a DataFrame (or from Columns to
a Column) and stays lazy unless its docstring says it runs a small job.
"""

__version__ = "0.1.0"
