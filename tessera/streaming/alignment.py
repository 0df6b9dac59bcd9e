"""Alignment of a stream of queries against a static table of targets.

Stateless: every query row meets every target, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.alignment import align_local_affine, align_local_linear


def linear_hits(targets: DataFrame, queries: DataFrame, **costs: int) -> DataFrame:
    """A streaming frame of linear-gap hits for a streaming frame of queries (name, seq)."""
    return align_local_linear(targets, queries, spread=False, **costs)


def affine_hits(targets: DataFrame, queries: DataFrame, **costs: int) -> DataFrame:
    """A streaming frame of affine-gap hits for a streaming frame of queries (name, seq)."""
    return align_local_affine(targets, queries, spread=False, **costs)
