"""Column builders and aggregates shared by the operators."""
