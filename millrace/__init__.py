"""Millrace: a relational analytics engine expressed in PySpark."""
