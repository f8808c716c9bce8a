"""Registered queries over the driver's tables, and the same in ANSI SQL."""

from catalog_queries import changing, cleaning, finding, layers, pages, storing, vectors

MODULES = (vectors, cleaning, changing, finding, pages, layers, storing)

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
