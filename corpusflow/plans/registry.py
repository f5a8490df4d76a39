"""All registered queries of the library, llm excluded."""

from __future__ import annotations

from corpusflow.plans import answering, corpus, search
from corpusflow.plans.base import ORACLES, QUERIES

MODULES = (corpus, search, answering)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
