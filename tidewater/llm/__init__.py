"""Operators for large training-data pipelines.

Nothing outside this package imports it; the package itself uses PySpark,
numpy and the tokenizer/compression libraries only.
"""
