"""Operators for building training data out of web-scale text.

Each module holds one operator. They take and return DataFrames, collect nothing
that grows with the documents, and keep intermediate tables in the folder that
the cluster names in ``spark.checkpoint.dir``.
"""
