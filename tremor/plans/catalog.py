"""All registered queries: name -> (callable, SQL text or None)."""

from __future__ import annotations

from functools import wraps

from ..session import tune
from . import ingest_queries, pivot_queries, pricing_queries


def _tuned(run):
    @wraps(run)
    def query(spark, sf_dir):
        return run(tune(spark), sf_dir)

    return query


CATALOG = {
    name: (_tuned(run), sql)
    for group in (pricing_queries, pivot_queries, ingest_queries)
    for name, (run, sql) in group.QUERIES.items()
}
