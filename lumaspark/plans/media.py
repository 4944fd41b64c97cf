"""All queries of the media operators."""

from . import codes, containers, pixels

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (codes, pixels, containers):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
