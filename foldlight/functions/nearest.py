"""Nearest of a few given centres, batch by batch."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096  # rows whose distances are held at once


def nearest(features: Column, centres: Sequence[Sequence[float]]) -> Column:
    """struct<cluster, cost>: number of the nearest centre, the first of equals, and its squared distance.

    Null for a null row; a row of another length than the centres is an error.
    """
    places = np.array([[float(x) for x in c] for c in centres])

    @P.pandas_udf("cluster int, cost double")
    def find(rows: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cluster": pd.array([None] * len(rows), "Int32"), "cost": np.nan})
        given = np.flatnonzero(rows.notna())
        for i in range(0, len(given), BLOCK):
            part = given[i : i + BLOCK]
            x = np.stack(rows.iloc[part].to_numpy()).astype(float)
            gaps = ((x[:, None, :] - places[None, :, :]) ** 2).sum(axis=2)
            best = gaps.argmin(axis=1)
            out.iloc[part, 0] = best
            out.iloc[part, 1] = gaps[np.arange(len(part)), best]
        return out

    return find(features)
