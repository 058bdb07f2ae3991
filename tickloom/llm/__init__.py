"""Training-data operators: joins, search, scans, scoring, packing and mixing.

Nothing else in the library imports this subpackage.
"""
