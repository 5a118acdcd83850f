"""Operators of a training-data pipeline: extraction, formatting,
near-duplicate removal, sharding, encoding, filtering, packing, search.

Nothing else in the library imports this subpackage; it borrows the session
helpers and the table reader from the rest.
"""
