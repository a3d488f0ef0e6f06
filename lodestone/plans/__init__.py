"""Registered queries and their SQL twins."""

from . import columns, indexes, oracles, queries, readers, snapshots, sources, surveys

QUERIES = queries.QUERIES | snapshots.QUERIES | surveys.QUERIES | sources.QUERIES | columns.QUERIES | indexes.QUERIES | readers.QUERIES
SQL = oracles.SQL | snapshots.SQL | surveys.SQL | sources.SQL | columns.SQL | indexes.SQL | readers.SQL
