"""The lookup join: every request gets at most one data row of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import unused


def lookup_join(requests: DataFrame, data: DataFrame, key: str, values: list[str], tiebreak: list[str] | None = None, plan: str = "join") -> DataFrame:
    """``requests`` with ``values`` of the last data row of the key, and ``has_value``.

    One row per request, matched or not. Of data rows with equal keys the one with the largest
    ``tiebreak`` (then the largest values) wins. Matching a row whose values are null still
    sets ``has_value``. Null keys match nothing. Requests may have no column named as one of
    ``values`` or ``has_value``.

    plan="join" reduces the data to one row per key before the shuffle where it can, and joins;
    adaptive execution splits a key that most requests ask for. plan="scan" unites both sides,
    sorts by (key, side) and carries the last data row to the requests: one exchange, but all
    rows of a key meet in one task.
    """
    clash = {c.lower() for c in requests.columns} & {c.lower() for c in [*values, "has_value"]}
    if clash:
        raise ValueError(f"requests have columns of the names {sorted(clash)} already; rename them")
    order = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate([*(tiebreak or []), *values])))
    carried = F.struct(*(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    hit, wanted = unused([*requests.columns, *values], "_hit", "_key")
    if plan == "join":
        best = data.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(wanted)).agg(F.max_by(carried, order).alias(hit))
        joined = requests.join(best, requests[key] == best[wanted], "left")
        return joined.select(*(requests[c] for c in requests.columns), *(F.col(hit)[f"v{i}"].alias(v) for i, v in enumerate(values)), F.col(hit).isNotNull().alias("has_value"))
    if plan != "scan":
        raise ValueError(f"unknown plan {plan!r}")
    # The user's columns are inside structs here, so these names clash with none.
    left = requests.select(F.col(key).alias("_k"), F.lit(1).alias("_side"), F.struct(*requests.columns).alias("_row"))
    right = data.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(0).alias("_side"), carried.alias("_hit"), order.alias("_tie"))
    both = left.unionByName(right, allowMissingColumns=True)
    own = Window.partitionBy("_k").orderBy("_side", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    scanned = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(own)).where("_side = 1")
    return scanned.select(*(F.col("_row")[c].alias(c) for c in requests.columns), *(F.col("_last")[f"v{i}"].alias(v) for i, v in enumerate(values)), F.col("_last").isNotNull().alias("has_value"))


def missing_keys(requests: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Requests without a data row."""
    return requests.join(data.select(key), key, "left_anti")
