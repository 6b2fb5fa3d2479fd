"""Metrics beside a query: Spark gathers them while the rows go by, without a pass of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A sink takes a name and a value, once an action over the observed rows has ended.
Sink = Callable[[str, float], None]


class Observed:
    """`rows` are the same as before; `emit` waits for an action over them and gives each metric to the sink."""

    def __init__(self, df: DataFrame, prefix: str, **metrics: Column) -> None:
        self.prefix, self._seen = prefix, Observation()
        named = metrics or {"rows_total": F.count(F.lit(1))}
        self.rows = df.observe(self._seen, *(c.alias(n) for n, c in named.items()))

    def emit(self, sink: Sink) -> dict[str, float]:
        found = {f"{self.prefix}.{k}": v for k, v in self._seen.get.items()}
        for k, v in found.items():
            sink(k, v)
        return found
