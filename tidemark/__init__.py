"""Tidemark: an index-and-search engine for collections of files, written for Spark.

State lives in DataFrames with explicit schemas; every operator takes DataFrames and
returns a DataFrame, so Catalyst sees whole plans.
"""
