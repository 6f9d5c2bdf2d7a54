"""Compilers of rules into Spark SQL text, and the joins and aggregates around them."""
