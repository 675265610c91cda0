"""Training-data operators: scoring, de-duplication, filtering, mixing, tokenising.

Nothing outside this subpackage imports it.  Every operator takes and returns
Spark DataFrames; ``queries.py`` binds each one to its table with production
parameters.
"""
