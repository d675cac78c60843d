"""The registered queries of the reference's operators, each with SQL that says the same."""

from __future__ import annotations

from weftline.plans import change_queries, code_queries, extra_queries, graph_queries, listing_queries, parsing_queries, registry, report_queries, session_queries, streaming_queries  # noqa: F401 - they register


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
