"""Signature scanning and security-log analytics on Spark DataFrames."""
