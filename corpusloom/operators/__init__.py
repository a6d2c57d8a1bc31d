"""Retrieval, chunking, quotation and claim operators: DataFrames in, DataFrames out."""
