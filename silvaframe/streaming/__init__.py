"""Scoring a fixed forest over streams: each row on its own, no state, so no watermark is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators.forest import TABLE_BYTES
from ..operators.model import ForestModel


def predictions(model: ForestModel, rows: DataFrame) -> DataFrame:
    """``(sample_id, predicted)`` of the rows of a stream (or table) ``(sample_id, x)``: the mean of the leaves they reach, zeros if none is known.

    The forest and its leaf means are broadcast, so they must be small:
    over ``TABLE_BYTES`` is an error. Null or ragged vectors are an error.
    """
    if not model.forest.fits(model.width):
        raise ValueError(f"leaf means of over {TABLE_BYTES} bytes are too large to broadcast: score in batches with ForestModel.predict")
    got = sorted((r.node_id, r.means) for r in model.forest_leaf_means().collect())
    return model.forest.by_leaves(rows, np.array([i for i, _ in got], np.int64), np.array([m for _, m in got], float).reshape(len(got), model.width))
