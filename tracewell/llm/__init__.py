"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; numpy and Arrow are used inside tasks on data that Spark has
partitioned and shuffled.
"""
