"""Counts of what the steps of a job drop, gathered in the pass that reads the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Losses:
    """Metrics of the steps of a job.

    ``watch`` adds aggregates to a step; they are computed beside the rows by the first action that runs through it, no pass of their
    own. ``table`` gives them once that action is over. An action that stops early, such as a limit, counts only what it read.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str, metrics: dict[str, Column]) -> DataFrame:
        """``df``, with ``metrics`` (aggregates) counted under the name of the step."""
        observed = Observation(f"{step} {len(self._steps)}")
        self._steps.append((step, observed))
        return df.observe(observed, *[c.alias(name) for name, c in metrics.items()])

    def counts(self) -> list[tuple[str, str, int]]:
        """(step, metric, n) in the order of the steps; steps of one name are added up."""
        out: dict[tuple[str, str], int] = {}
        for step, observed in self._steps:
            for metric, n in observed.get.items():
                out[step, metric] = out.get((step, metric), 0) + int(n or 0)
        return [(*name, n) for name, n in out.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts(), "step string, metric string, n long")
