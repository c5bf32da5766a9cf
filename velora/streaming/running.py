"""Moments of each key of a stream, kept as a state that can be updated, merged and read at any time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, mean double, spread double"
RESULT = "n long, mean double, std double"


@dataclass(frozen=True)
class Moments:
    """Number, mean, and sum of squared deviations from the mean: merging is exact but for rounding, in any order."""

    n: int = 0
    mean: float = 0.0
    spread: float = 0.0

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        values = values[np.isfinite(values)]
        return cls(len(values), float(values.mean()), float(((values - values.mean()) ** 2).sum())) if len(values) else cls()

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * other.n / n, self.spread + other.spread + apart * apart * self.n * other.n / n)

    def result(self) -> tuple[int, float, float]:
        """n, mean, sample deviation (0 for a single value)."""
        return self.n, self.mean, float(np.sqrt(self.spread / (self.n - 1))) if self.n > 1 else 0.0


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, std) of a stream, a row for each key that a batch brought values for: write it in update mode. Nulls and values that aren't finite don't count.

    The state of a key is three numbers, kept by Spark with the query's checkpoint; a batch of a key comes in parts, each of which is merged into it."""
    kind = stream.schema[key].dataType.simpleString()

    def step(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Moments(*state.get) if state.exists else Moments()
        for part in parts:
            held = held.merged(Moments.of(part[value].to_numpy(np.float64, na_value=np.nan)))
        state.update((held.n, held.mean, held.spread))
        yield pd.DataFrame({key: [of[0]], "n": [held.n], "mean": [held.mean], "std": [held.result()[2]]})

    rows = stream.select(key, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {RESULT}", STATE, "update", GroupStateTimeout.NoTimeout)


def moments_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same of a table, by partial aggregates."""
    x = F.when(F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")), None).otherwise(F.col(value).cast("double"))
    return df.groupBy(key).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"))
