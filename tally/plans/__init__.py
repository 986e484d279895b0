"""The registered queries and their SQL."""

from . import analytics, audit, matches, records  # noqa: F401  (records adds to analytics' lists)

QUERIES = {**matches.QUERIES, **analytics.QUERIES, **audit.QUERIES}
ORACLES = {**matches.ORACLES, **analytics.ORACLES, **audit.ORACLES}
