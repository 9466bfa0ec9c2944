"""depotlens: warehouse stock search, stock ledger and request-log analytics on Spark.

Every operator takes DataFrames and returns DataFrames; no operator creates a
session.  Import from the sub-packages:

* ``depotlens.sources``    reading, writing and deriving the model tables
* ``depotlens.functions``  column functions (rounding, rates, tokens, percentiles)
* ``depotlens.operators``  search, paging, metrics, ledger, validation, skew
* ``depotlens.streaming``  change feeds, live metrics, continuous decrement
* ``depotlens.plans``      the registered queries and their SQL equivalents
"""
