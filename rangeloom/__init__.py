"""Ordered, keyed tables on Spark: lazy key-range reads, set-oriented writes, versions, transactions and maintenance."""
