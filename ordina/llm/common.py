"""Helpers that the operators of this folder share.

Intermediate tables go as Parquet to the shared folder that the cluster names in
``spark.checkpoint.dir``: every executor can read them again after another one is lost, and
they cut the lineage of iterative work. Each call of an operator keeps them in a folder of its
own (see ``owning``), so no call deletes what another one still reads.

Python workers stay alive between tasks and operators and share an executor's memory, so caches
are small, and a worker lets go of them as its task ends (see ``tidy``).
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch from the JVM to Python. Texts can be very long.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20

#: White space as the text contracts define it.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session and ship this package to its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="ordina-package-")  # read by the driver's file server alone
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        file = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(file))
        _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application; it goes when the application ends."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="ordina-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        _FOLDERS[app] = f"{root.rstrip('/')}/ordina-{app}"
        path, system = _on_disk(spark, _FOLDERS[app])
        system.mkdirs(path)
        system.deleteOnExit(path)
    return _FOLDERS[app]


def _on_disk(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _on_disk(spark, folder)
    system.delete(path, True)


#: The folder of the operator call that is being planned.
_CALL: ContextVar[str | None] = ContextVar("call", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for one table of the running call."""
    return f"{_CALL.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts its lineage."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def owning(label: str):
    """For operators (of a DataFrame) with a small result: the tables that a call writes lie in a
    folder of the call, and that folder is deleted once the result is written beside it."""

    def wrap(operator):
        @functools.wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            folder = new_folder(df.sparkSession, label)
            before = _CALL.set(folder)
            try:
                planned = operator(df, *args, **options)
                _CALL.reset(before)
                return materialise(planned, f"{label}-result")
            finally:
                if _CALL.get() == folder:
                    _CALL.reset(before)
                delete(df.sparkSession, folder)

        return run

    return wrap


_CACHES: dict[str, list] = {}
_LAST = [""]


def cache_of(owner: str, clear) -> None:
    """Register what empties a cache that a Python worker keeps between tasks of ``owner``."""
    _CACHES.setdefault(owner, []).append(clear)


def begin(owner: str) -> None:
    """Called as a Python task begins: a reused worker lets go of what other operators left in it."""
    if _LAST[0] != owner:
        if not _LAST[0]:  # what this pool frees can go back to the machine
            pa.set_memory_pool(pa.system_memory_pool())
        _LAST[0] = owner
        for name, clears in _CACHES.items():
            if name != owner:
                for clear in clears:
                    clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory of this process back to the machine."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if release:
        release(0)


def tidy(function, owner: str):
    """``function`` of batches, after which its worker keeps no cache of ``owner``."""

    def run(batches):
        begin(owner)
        try:
            yield from function(batches)
        finally:
            for clear in _CACHES.get(owner, []):
                clear()
            trim()

    return run


#: Bits of the filter below (4 MB), whatever the number of ids.
FILTER_BITS = 1 << 25


def bitmap_of(ids: DataFrame):
    """A test of columns: true for every long in the one column of ``ids`` and for few others.

    It looks into a bitmap of hashed ids, whose size is fixed; more ids than bits only let more
    values through.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    marked = ids.select(slot(F.col(ids.columns[0])).alias("slot")).select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("mask"))
    words = marked.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, "<i8")
    bitmap[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    marks = ids.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    @F.arrow_udf("boolean")
    def is_marked(slots: pa.Array) -> pa.Array:
        begin("bitmap_of")
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((np.frombuffer(marks.value, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1)

    return lambda value: is_marked(slot(value))


def rows_of(df: DataFrame, column_name: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id (a long) is in the one column of ``ids``; few others are shuffled.

    A bitmap drops most other rows before the exact semi-join.
    """
    wanted = df.where(F.col(column_name).isNotNull()).where(bitmap_of(ids)(F.col(column_name)))
    return wanted.join(ids.select(F.col(ids.columns[0]).alias(column_name)), column_name, "left_semi")


def learnable(doc_id: str = "doc_id"):
    """Rows that models may learn from: crc32 of the id's decimal text mod 3 is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training. A null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)) == 1


def fresh(taken, *names: str) -> list[str]:
    """``names`` with underscores added until none of them is a column in ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def plain(name: str):
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ddl(fields) -> str:
    """The schema string of some fields."""
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in fields)


#: Sum of the sizes of rows that come to the driver at once (one row may have more).
AT_ONCE = 1 << 20


class Filed:
    """Rows on the driver, by ``order`` and then by their bytes.

    Columns of bytes lie in a file (it goes with the object) until one of them is asked for;
    ``filed[name]`` is the array of any other column.
    """

    def __init__(self, rows: DataFrame, order: str):
        self._blobs = [f.name for f in rows.schema if f.dataType.typeName() == "binary"]
        values: dict[str, list] = {n: [] for n in rows.columns if n not in self._blobs}
        self._file, edges = tempfile.TemporaryFile(), [0]  # noqa: SIM115
        for row in rows.toLocalIterator():
            for name, kept in values.items():
                kept.append(row[name])
            for name in self._blobs:
                edges.append(edges[-1] + self._file.write(row[name]))
        self._file.flush()
        self._edges = np.array(edges, np.int64)
        orders = np.array(values[order], np.int64)
        self._places = np.argsort(orders, kind="stable")
        for same in np.split(self._places, np.flatnonzero(np.diff(orders[self._places])) + 1):
            if self._blobs and len(same) > 1:
                same[:] = sorted(same.tolist(), key=lambda at: [self._read(at, k) for k in range(len(self._blobs))])
        text = {f.name for f in rows.schema if f.dataType.typeName() == "string"}
        self._values = {n: np.array(v, object if n in text else None)[self._places] for n, v in values.items()}

    def __len__(self) -> int:
        return len(self._places)

    def __getitem__(self, name: str) -> np.ndarray:
        return self._values[name]

    def _read(self, at: int, k: int) -> bytes:
        start, end = self._edges[at * len(self._blobs) + k :][:2]
        return os.pread(self._file.fileno(), int(end - start), int(start))

    def bytes_of(self, name: str, i: int) -> bytes:
        return self._read(int(self._places[i]), self._blobs.index(name))


@dataclass
class Made:
    """A sequence whose items are made each time that they are asked for."""

    make: Callable
    size: int

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int):
        return self.make(i)


def within(rows: DataFrame, limit: int, size: str, order: str, always=None) -> Filed:
    """The first of the written ``rows`` by ``order`` whose ``size`` sums to ``limit`` at most, on the driver.

    Rows where ``always`` holds come whatever their place. At least one row comes. They come
    ``AT_ONCE`` at a time, and the driver's memory never holds the bytes of all.
    """
    sizes = rows.select(F.col(order).alias("o"), F.col(size).alias("s")).toPandas().sort_values("o", kind="stable")
    ends = sizes["s"].cumsum().to_numpy()
    if len(ends) and ends[-1] > limit:
        last = int(sizes["o"].iloc[max(0, int(np.searchsorted(ends, limit, side="right")) - 1)])
        keep = F.col(order) <= last
        rows = rows.where(keep if always is None else keep | always)
    parts = -(-int(ends[-1] if len(ends) else 0) // AT_ONCE)
    return Filed(rows.repartition(parts) if parts > 1 else rows, order)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(batches, byte_limit: int, name: str):
    """Join Arrow batches to tables of at most about ``byte_limit`` bytes of column ``name``."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(int(np.searchsorted(ends, before + byte_limit - size, side="right")), at + (not held))
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(ends[end - 1]) - before
                at = end
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
