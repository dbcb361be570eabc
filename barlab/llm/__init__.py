"""Operations of a training-data pipeline: dedup, scans, packing, mixing, search.

Nothing else in the library imports this package.
"""
