"""All registered queries."""

from __future__ import annotations

from ternweave.plans import corpus, graphs, jobs, measures, numbers, search, stores, streams, vectors  # noqa: F401
from ternweave.plans.common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
