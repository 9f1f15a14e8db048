"""Duplicate and similarity analytics over large text corpora, on Spark DataFrames."""
