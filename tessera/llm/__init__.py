"""Training-data operators: tokenising, dedup, PII, search, language ID, mixing, sharding and URL filters.

Every module works on DataFrames, takes its column names as arguments and never touches other
columns.  Nothing outside this folder imports it.
"""
