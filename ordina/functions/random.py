"""Random-looking numbers made of stable columns, the same for every plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(stable: list[str], seed: int, method: str = "xxhash64") -> Column:
    """A long made of the columns ``stable`` and a seed.

    "xxhash64" is fast; "md5" (60 bits of the digest of the columns and the seed as text) can be
    computed again by any SQL engine.
    """
    if method == "xxhash64":
        return F.xxhash64(*stable, F.lit(seed))
    if method != "md5":
        raise ValueError(f"unknown method {method!r}")
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in stable), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
