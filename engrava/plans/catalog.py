"""Every registered query of the core, with its SQL equivalent."""

from engrava.plans import access_queries, engine_queries, general, lab_queries, source_queries, state_queries, streaming_queries, vector_queries

_MODULES = (general, vector_queries, lab_queries, state_queries, engine_queries, access_queries, streaming_queries, source_queries)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
