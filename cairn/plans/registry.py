"""All named queries of the core and their SQL."""

from __future__ import annotations

from cairn.plans import card_queries, code_queries, log_queries, python_queries, similarity_queries, source_queries, star_queries, stats_queries, text_queries, problems

BOOKS = [m.book for m in (text_queries, log_queries, stats_queries, code_queries, similarity_queries, card_queries, star_queries, python_queries, source_queries)]


def queries() -> dict:
    out = dict(problems.QUERIES)
    for b in BOOKS:
        out.update(b.queries)
    return out


def oracles() -> dict:
    out = dict(problems.ORACLES)
    for b in BOOKS:
        out.update(b.oracles)
    return out
