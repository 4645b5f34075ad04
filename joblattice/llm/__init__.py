"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; Spark partitions and shuffles the work, numpy and Arrow do
the per-batch arithmetic.
"""
