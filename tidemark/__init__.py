"""Validated reuse of derived results, and training-data operators, on PySpark."""
