"""relweave: relational datasets as Spark DataFrames.

Catalog model, referentially intact subsets, set-oriented DML, integrity
checks, CSV and archive exchange, schema diffs and migration history, all
expressed with the DataFrame and SQL APIs.
"""
