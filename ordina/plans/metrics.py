"""What a plan does: exchanges, rows and bytes by partition, time."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan before adaptive changes; broadcasts do not count."""
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Round|Single)", physical_plan(df)))


def rows_by_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def _exchanges_run(node):
    """Shuffle nodes of a plan that has run, through the stages of adaptive execution."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _exchanges_run(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _exchanges_run(node.plan())
    elif kind != "ReusedExchangeExec":
        if kind == "ShuffleExchangeExec":
            yield node
        for i in range(node.children().size()):
            yield from _exchanges_run(node.children().apply(i))


def shuffle_stats(df: DataFrame) -> dict[str, int]:
    """Run ``df`` and count what its exchanges wrote: exchanges, records, bytes."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out = {"exchanges": 0, "records": 0, "bytes": 0}
    for node in _exchanges_run(execution.executedPlan()):
        out["exchanges"] += 1
        for name, metric in (("records", "shuffleRecordsWritten"), ("bytes", "shuffleBytesWritten")):
            out[name] += node.metrics().apply(metric).value()
    return out


def timed(df: DataFrame, runs: int = 4, warm_up: int = 1) -> list[float]:
    """Seconds of ``runs`` runs into the noop sink, after warm-up runs."""
    return timed_with(lambda: df, runs, warm_up)


def timed_with(build: Callable[[], DataFrame], runs: int = 4, warm_up: int = 1) -> list[float]:
    """Like ``timed``, with the time that ``build`` takes: planning may sample and count."""
    samples = []
    for i in range(warm_up + runs):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        if i >= warm_up:
            samples.append(time.perf_counter() - began)
    return samples
