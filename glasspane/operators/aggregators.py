"""Aggregates with a state of their own: init, accumulate, merge and store, registered by name.

A state is an array of doubles. Each task accumulates the values of the groups that it meets, batch by batch, and gives
a row for each; the rows of a group are then merged and stored. So a group that holds most of the table costs a row a
task in the shuffle, as with built-in aggregates. Values that are null, no numbers or NaN are passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Aggregator:
    """accumulate takes the state and an array of values; store makes a number, or None, of a state."""

    init: Callable[[], np.ndarray]
    accumulate: Callable[[np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    store: Callable[[np.ndarray], float | None]


AGGREGATORS: dict[str, Aggregator] = {}


def register(name: str, aggregator: Aggregator) -> None:
    AGGREGATORS[name] = aggregator


def _spread_merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    if n == 0:
        return a
    d = b[1] - a[1]
    return np.array([n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n])


def _counted(pairs: np.ndarray) -> np.ndarray:
    """Values and their counts by turns, each value once, in order."""
    values, where = np.unique(pairs[0::2], return_inverse=True)
    return np.stack([values, np.bincount(where, pairs[1::2], len(values))], axis=1).ravel()


register("spread", Aggregator(lambda: np.zeros(3), lambda s, v: _spread_merged(s, np.array([len(v), v.mean(), ((v - v.mean()) ** 2).sum()])), _spread_merged, lambda s: s[2] / (s[0] - 1) if s[0] > 1 else None))
register("range", Aggregator(lambda: np.array([np.inf, -np.inf]), lambda s, v: np.array([min(s[0], v.min()), max(s[1], v.max())]), lambda a, b: np.array([min(a[0], b[0]), max(a[1], b[1])]), lambda s: s[1] - s[0] if s[0] <= s[1] else None))
#: The most frequent value, of several the least; the state grows with the different values.
register("mode", Aggregator(lambda: np.zeros(0), lambda s, v: _counted(np.concatenate([s, np.stack([v, np.ones(len(v))], axis=1).ravel()])), lambda a, b: _counted(np.concatenate([a, b])), lambda s: float(s[0::2][np.argmax(s[1::2])]) if len(s) else None))
register("geometric_mean", Aggregator(lambda: np.zeros(2), lambda s, v: s + [np.count_nonzero(v > 0), np.log(v[v > 0]).sum()], lambda a, b: a + b, lambda s: float(np.exp(s[1] / s[0])) if s[0] else None))


def aggregated(df: DataFrame, by: str, wanted: dict[str, tuple[str, str]], most: int = 10_000) -> DataFrame:
    """by and, under each name, an aggregator's result on a column; wanted: name -> (aggregator, column).

    A task that meets more than ``most`` groups gives what it has and starts anew.
    """
    own = [(AGGREGATORS[a], c) for a, c in wanted.values()]
    names, columns = list(wanted), list(dict.fromkeys(c for _, c in own))
    key = df.schema[by]

    def partial(batches):
        held: dict = {}

        def rows():
            return pd.DataFrame({by: list(held), "states": [[s.tolist() for s in states] for states in held.values()]})

        for pdf in batches:
            for group, part in pdf.groupby(by, dropna=False, sort=False):
                group = None if pd.isna(group) else group
                states = held.setdefault(group, [a.init() for a, _ in own])
                for k, (a, c) in enumerate(own):
                    values = part[c].to_numpy(float)
                    values = values[~np.isnan(values)]
                    if len(values):
                        states[k] = a.accumulate(states[k], values)
            if len(held) > most:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [a.init() for a, _ in own]
        for row in pdf["states"]:
            for k, (a, _) in enumerate(own):
                states[k] = a.merge(states[k], np.array(row[k], float))
        return pd.DataFrame({by: [pdf[by].iloc[0]]} | {n: pd.Series([a.store(s)], dtype="float64") for n, (a, _), s in zip(names, own, states)})

    numbers = df.select(by, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in columns])
    state = T.StructType([key, T.StructField("states", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return numbers.mapInPandas(partial, state).groupBy(by).applyInPandas(merged, T.StructType([key, *[T.StructField(n, T.DoubleType()) for n in names]]))
