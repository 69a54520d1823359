"""Benchmark-ageing and corpus analytics on PySpark."""
