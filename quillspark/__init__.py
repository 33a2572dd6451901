"""Question-answering corpus analytics on plain Spark DataFrames."""
