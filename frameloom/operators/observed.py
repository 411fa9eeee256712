"""Counters that ride along with a job instead of costing one."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Throughput:
    """Counts rows of a DataFrame while something else consumes it: `df = t.watch(df)`, run, then `t.rates()`."""

    def __init__(self, name: str = "throughput", unit: str = "frames"):
        self.observation, self.unit, self.began = Observation(name), unit, time.monotonic()

    def watch(self, df: DataFrame) -> DataFrame:
        self.began = time.monotonic()
        return df.observe(self.observation, F.count(F.lit(1)).alias(self.unit))

    def rates(self) -> dict[str, float]:
        n, seconds = self.observation.get[self.unit], time.monotonic() - self.began
        return {self.unit: n, "seconds": seconds, f"{self.unit}_per_s": n / max(seconds, 1e-9)}
