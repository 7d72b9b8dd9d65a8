"""All queries of the core, and the SQL that each must agree with."""

from tidemark.plans import analytics, filings, records, signals

MODULES = [analytics, filings, records, signals]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "anchor_pick"
