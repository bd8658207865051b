"""Scalar expressions: each takes and gives Spark columns, and stays in the JVM."""
