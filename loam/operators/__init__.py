"""Operators on the log of versions, all DataFrame to DataFrame."""
