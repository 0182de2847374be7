"""Operators for preparing training text: deduplication, packing, models, archives.

Nothing else in the library imports this subpackage.
"""
