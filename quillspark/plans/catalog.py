"""All queries of the core, by name."""

from __future__ import annotations

from . import packed_queries, pipeline_queries, reference_queries  # noqa: F401

# The composed queries register in the same tables as those of the reference's single operators.
QUERIES = {**reference_queries.QUERIES, **packed_queries.QUERIES}
ORACLES: dict[str, str] = {**reference_queries.ORACLES}
ENTRY = reference_queries.federated_topk
