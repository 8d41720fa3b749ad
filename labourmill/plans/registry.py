"""Every registered query of the library with its DuckDB counterpart."""

from labourmill.plans import jobs, marts

QUERIES = {**marts.QUERIES, **jobs.QUERIES}
ORACLES = {**marts.ORACLES, **jobs.ORACLES}
