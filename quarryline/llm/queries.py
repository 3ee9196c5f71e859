"""Queries of this package and their SQL."""

from . import canon, cap, distinctive, encode, heavy, lookalike, mix, seen, termfreq

_MODULES = [seen, termfreq, distinctive, cap, heavy, canon, encode, mix, lookalike]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
