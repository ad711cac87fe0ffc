"""Retail decision analytics as PySpark DataFrame operators."""
