"""carrylens: leveraged-lending market analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    schemas, readers, raw-log decoding, stand-in views over the test tables
functions  column expressions (units, guarded ratios, curves, labels)
operators  DataFrame -> DataFrame jobs (ledger, positions, accounts, series,
           scenarios, categories, quality, distributed ranking)
plans      session setup, the query catalog and its DuckDB oracle text
"""

__version__ = "0.1.0"
