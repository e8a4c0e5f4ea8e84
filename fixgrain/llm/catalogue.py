"""All queries of this subpackage, and the SQL of those that SQL can express."""

from . import groups, leaks, mixing, quality, residue, splits, survivors, truncation

_MODULES = (splits, survivors, truncation, residue, groups, leaks, mixing, quality)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
