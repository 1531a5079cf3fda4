"""Corrective retrieval over documents, and the document dataflow it needs, on Spark DataFrames."""
