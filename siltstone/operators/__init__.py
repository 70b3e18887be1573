"""Chunking, packing, memory, search and table operators over DataFrames."""
