"""Relational operators of the master-data pipeline: DataFrame in, DataFrame out."""
