"""Operators put together over a star: one entry per named analysis."""
