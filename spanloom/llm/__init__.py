"""Operators for preparing large text corpora.

Every operator takes and returns DataFrames.  Texts are processed whole, in
Arrow batches, and everything that has to meet across documents does so through
Spark's shuffles, aggregations and joins.
"""
