"""Collects the registered queries of all plan modules."""

from __future__ import annotations

from vestigo.plans import bench, detections, fusion, history, hypotheses, integrity, quality, sources, vehicles, video  # noqa: F401  (imports register queries)
from vestigo.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
