"""Scalar functions: column expressions where Spark has them, Arrow batches in pandas functions where it has not."""
