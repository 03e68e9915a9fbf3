"""Readers of dirty delimited and Parquet microdata, and sinks for result tables."""
