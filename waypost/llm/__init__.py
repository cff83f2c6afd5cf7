"""Operators of a training-data pipeline: packing, filtering, sharding, deduplication, scoring and token work.

Nothing else in the package imports this subpackage. Every operator takes and returns DataFrames; `queries`
applies each to the whole `documents` table.
"""
