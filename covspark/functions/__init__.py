"""Scalar functions, as Spark SQL text; Python functions only where SQL can't express them."""
