"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the ``opN_*`` contract queries live in :mod:`.entries`.
"""
