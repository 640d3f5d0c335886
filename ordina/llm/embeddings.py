"""Near duplicates among vectors: spherical k-means cells and blocked cosine products.

Vectors of each length have cells of their own. Centroids are fitted on a bounded sample; every
vector is indexed. A vector is at home in the cell of its nearest centroid and a guest in the
cells whose border is near: with the threshold angle ``t``, a neighbour of ``y`` can be at home in
cell ``c`` only if ``y.(h - c) <= tan(t) * |h - c|`` (``h``: the centroid of ``y``'s home), and a
vector is a guest where that holds with a margin of the right side. A margin of 1 loses no link at
all. A neighbour lies beside ``y`` in any of the directions, and of all ``d`` of them the one
towards the border takes about ``1 / sqrt(d)``; so the margin is ``SPREADS`` times that, and 1 for
short vectors. Both vectors of a link fulfil this for the other's cell, so of two cells only one
receives guests from the other, and each pair meets once.

Cells are cut into blocks. A task multiplies two blocks, a slice at a time, and returns, for each
vector, the number of its links and the links of a spanning forest of what it found; pairs are
never emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, owning, plain, prepare
from .components import connected_components

#: Vectors that the centroids of a length are fitted on, wanted vectors of a cell, most cells,
#: rounds of k-means; most numbers of such a sample, and of the centroids of a length.
SAMPLE, CELL, MAX_CELLS, FIT_ROUNDS, SAMPLE_NUMBERS, CENTROID_NUMBERS = 20_000, 1024, 4096, 8, 1 << 23, 1 << 21
#: Standard deviations of a neighbour's place that the margin covers; see the module's text.
SPREADS = 4.0
#: Vectors of a block, and of a slice of it. A row is copied once for each block that it meets.
BLOCK, SLICE = 2048, 256


def _unit(vectors: pd.Series) -> list[bytes | None]:
    """Unit vectors as bytes of float64; null for vectors that link with nothing."""
    out = []
    for vector in vectors:
        values = np.array([np.nan if x is None else x for x in vector], np.float64) if vector is not None else np.zeros(0)
        finite = len(values) and np.isfinite(values).all()
        largest = np.abs(values).max() if finite else 0.0
        if largest > 0:
            values = values / largest  # no overflow in the norm
            out.append((values / np.sqrt((values * values).sum())).tobytes())
        else:
            out.append(None)
    return out


def _units(batches):
    for batch in batches:
        yield pd.DataFrame({"_id": batch["_id"], "unit": _unit(batch["_vector"])})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = FIT_ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centroids, at most ``cells`` of them."""
    draw = np.random.default_rng(seed)
    centroids = sample[np.sort(draw.choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        kept = norms > 1e-12
        centroids = sums[kept] / norms[kept][:, None]
    return centroids


def _receives(cell: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether ``cell`` receives guests at home in ``other``: true for one order of two cells."""
    return (cell != other) & ((cell < other) ^ ((cell + other) % 2 == 1))


def margin_of(width: int) -> float:
    """Share of the exact border width inside which vectors of so many components are guests."""
    return min(1.0, SPREADS / width**0.5)


def _assigner(index, threshold: float, margin: float | None):
    """``index``: for each length of vectors the number of its first cell, and its centroids if it has several."""

    def run(batches):
        for batch in batches:
            widths = batch["unit"].str.len() // 8
            for width in sorted(set(widths)):
                own = batch[widths == width]
                first, points = index.value[width]
                if points is None:
                    yield own.assign(home=np.full(len(own), first, np.int32), guest=[np.zeros(0, np.int32)] * len(own))
                    continue
                reach = (margin_of(width) if margin is None else margin) * np.sqrt(1 - threshold**2) / threshold
                near = _matrix(own["unit"]) @ points.T
                home = near.argmax(axis=1)
                best = near[np.arange(len(near)), home][:, None]
                gaps = np.sqrt(np.maximum(0.0, 2 - 2 * points[home] @ points.T))
                inside = best - near <= reach * gaps
                inside &= _receives(np.arange(len(points)), home[:, None])
                yield own.assign(home=(first + home).astype(np.int32), guest=[(first + np.flatnonzero(x)).astype(np.int32) for x in inside])

    return run


def _products(threshold: float):
    """Grouped function: links between the rows of two blocks of a cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(rows):
            return pd.DataFrame({k: pd.array([], "Int64") for k in "abn"})
        alone = bool(rows["i"].iloc[0] == rows["j"].iloc[0])  # hashing can leave a block empty
        own = first if alone else second
        out = {"a": [], "b": [], "n": []}
        if len(first) and len(own):
            x, y = _matrix(first["unit"]), _matrix(own["unit"])
            ids_x, ids_y = first["cid"].to_numpy(), own["cid"].to_numpy()
            size_x, size_y = first["size"].to_numpy(), own["size"].to_numpy()
            sums_x, sums_y, forests = np.zeros(len(x)), np.zeros(len(y)), []
            for at in range(0, len(x), SLICE):
                p, q = np.nonzero(x[at : at + SLICE] @ y.T >= threshold)
                p += at
                if alone:
                    p, q = p[p < q], q[p < q]
                sums_x += np.bincount(p, size_y[q], len(x))
                sums_y += np.bincount(q, size_x[p], len(y))
                forests.append(_forest(ids_x[p], ids_y[q]))
            for ids, sums in ((ids_x, sums_x), (ids_y, sums_y)):
                some = np.flatnonzero(sums)
                out["a"] += ids[some].tolist()
                out["b"] += [None] * len(some)
                out["n"] += sums[some].astype(np.int64).tolist()
            forest = _forest(*np.concatenate(forests).T)
            out["a"] += forest[:, 0].tolist()
            out["b"] += forest[:, 1].tolist()
            out["n"] += [0] * len(forest)
        return pd.DataFrame({k: pd.array(v, "Int64") for k, v in out.items()})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) for links a-b, without the smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


@owning("vectors")
def near_vectors(vectors: DataFrame, threshold: float = 0.95, margin: float | None = None, cell: int = CELL, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Two vectors of the same number of components are linked when their cosine in double
    precision is at least ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable, itself included; the vector of that id is kept.
    Equal vectors are compared once and counted as often as they occur. Rows that share an id are
    one vector with several values. Null ids link with nothing. Other columns are ignored.
    ``margin=1`` finds every link; without one it follows the number of components (``margin_of``).
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(plain(id_col).cast("long").alias("_id"), plain(vector_col).alias("_vector"))
    units = materialise(rows.mapInPandas(_units, "_id bigint, unit binary"), "units")
    valid = units.where("_id IS NOT NULL AND unit IS NOT NULL")
    classes = materialise(valid.groupBy("unit").agg(F.min("_id").alias("cid"), F.count(F.lit(1)).alias("size")), "vectors")
    found = materialise(_links(classes, threshold, margin, cell, block), "links")

    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    members = valid.join(classes, "unit").select("_id", "cid", "size")
    same = members.where("_id != cid").select(F.col("_id").alias("a"), F.col("cid").alias("b"))
    components = connected_components(found.where("b IS NOT NULL").select("a", "b").unionByName(same))
    linked = members.join(counts, F.col("cid") == F.col("a"), "left").groupBy("_id").agg(F.max(F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"))
    out = units.select("_id").join(linked, "_id", "left").join(components, F.col("_id") == F.col("node"), "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _index(classes: DataFrame, wanted: int) -> dict:
    """For each length of vectors the number of its first cell, and its centroids if it has several."""
    index, cells = {}, 0
    for row in classes.groupBy((F.length("unit") / 8).cast("int").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect():
        width, points = row["width"], None
        several = min(MAX_CELLS, max(1, CENTROID_NUMBERS // width), row["n"] // wanted)
        if several > 1:
            most = max(several, min(SAMPLE, SAMPLE_NUMBERS // width))
            drawn = classes.where(F.length("unit") == 8 * width).orderBy(F.xxhash64("unit"), "cid").limit(most).select("unit").toPandas()
            points = fit_centroids(_matrix(drawn["unit"]), several)
        index[width] = cells, points
        cells += 1 if points is None else len(points)
    return index


def _links(classes: DataFrame, threshold: float, margin: float | None, wanted: int, most: int) -> DataFrame:
    """(a, null, links of a) and (a, b, 0) rows of the spanning forests."""
    shared = classes.sparkSession.sparkContext.broadcast(_index(classes, wanted))
    placed = classes.mapInPandas(_assigner(shared, threshold, margin), "unit binary, cid bigint, size bigint, home int, guest array<int>")
    placed = materialise(placed, "placed")
    # A row for each cell (at most MAX_CELLS of each length): the number of its blocks.
    blocks = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cid", "unit"), F.col("blocks")).cast("int")
    columns = ["unit", "cid", "size"]
    home = placed.withColumn("cell", F.col("home")).join(F.broadcast(blocks), "cell").withColumn("block", block)
    # Block pairs i <= j of a cell: a row of block k is on the first side of (k, j) and the second of (i, k).
    first = home.select("cell", *columns, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    second = home.where("block > 0").select("cell", *columns, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    # Guests of a cell in blocks of their own (j < 0), against each block of the cell.
    visits = placed.select(*columns, F.explode("guest").alias("cell"))
    guests = materialise(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parties")), "parties")
    visits = visits.join(F.broadcast(blocks), "cell").join(F.broadcast(guests), "cell")
    party = (-1 - F.pmod(F.xxhash64("cid", "unit"), F.col("parties"))).cast("int")
    visitors = visits.select("cell", *columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), party.alias("j"), F.lit(1).alias("side"))
    hosts = home.join(F.broadcast(guests), "cell").select("cell", *columns, F.col("block").alias("i"), F.explode(F.sequence(-F.col("parties"), F.lit(-1))).alias("j"), F.lit(0).alias("side"))
    met = first.unionByName(second).unionByName(visitors).unionByName(hosts)
    return met.groupBy("cell", "i", "j").applyInPandas(_products(threshold), "a bigint, b bigint, n bigint")
