"""WARC archives: write, read back, and merge their indexes.

A record per page is built with SQL functions and compressed as a gzip member of its own, so that
a reader can seek to it. A Python worker strings members together to files of at most
``FILE_RECORDS`` records and about ``FILE_BYTES`` bytes, and Spark's text writer writes each of
them to any store that Spark can write to. The writer ends a file with a separator: the last byte
of a member, which is zero, is left out for it.

The index of an archive, sorted by url key and time, is a run. Runs are range-partitioned by
(url key, time, id, archive, offset) in ranges of about ``RANGE_ROWS`` rows. A shuffle hands on the
rows of a run in order, so what arrives in a range is a few ascending stretches, which a loser
tree merges. The ranges in order are the capture history of every url.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, column, delete, materialise, new_folder, partitions, plain, prepare

#: Payloads shorter than this are never revisits. Most records and about the most bytes of a file.
LEAST_REVISIT, FILE_RECORDS, FILE_BYTES = 100, 1000, 16 << 20
#: Rows of the index that one task merges.
RANGE_ROWS = 100_000
END = "\r\n\r\n"
_URN = "urn:x-page:"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, digest, bytes, refers_to): ``refers_to`` is set for revisits.

    Only digests are shuffled, and the pages whose digest may occur under several ids.
    """
    rows = pages.select(plain(id_col).cast("long").alias("id"), plain(url_col).alias("url"), F.coalesce(plain(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    first = rows.select("id", "digest", "bytes").where(F.col("bytes") >= LEAST_REVISIT)
    first = first.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("digest", "first")
    first = materialise(first, "repeats")
    repeats = bitmap_of(first.select(F.xxhash64("digest")))(F.xxhash64("digest"))
    refers_to = F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to")
    some = rows.where(repeats).join(first, "digest", "left").select("id", "url", "html", "digest", "bytes", refers_to)
    return rows.where(~repeats).withColumn("refers_to", F.lit(None).cast("long")).unionByName(some)


def _second(number):
    """A time of capture for pages that have none: seconds after the start of 2024."""
    n = F.pmod(F.coalesce(number, F.lit(0)), F.lit(10**9))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(n / 86400).cast("int")).cast("string")
    rest = n % 86400
    clock = [F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, rest % 3600 / 60, rest % 60)]
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def records(plan: DataFrame) -> DataFrame:
    """(record): header and block of each row, without the record's closing line ends."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace("url", "[\\x00-\\x20]+", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", _second(F.col("id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">")))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return plan.withColumn("block", block).select(F.concat(header, F.col("block")).alias("record"))


def member(record: bytes) -> bytes:
    """The record as a gzip member, always of the same bytes."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _files(batches):
    """Records to the content of files, without the last zero byte of each."""
    held: list[bytes] = []

    def file() -> pa.RecordBatch:
        if held[-1][-1]:  # a member of a record of 16 MB or more can end so; one of nothing follows it
            held.append(member(b""))
        content = b"".join(held)[:-1]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    size = 0
    for batch in batches:
        for record in batch.column(0):
            held.append(member(record.as_buffer().to_pybytes() + END.encode()))
            size += len(held[-1])
            if len(held) >= FILE_RECORDS or size >= FILE_BYTES:
                yield file()
                size = 0
    if held:
        yield file()


def write_archives(pages: DataFrame, path: str, **names) -> None:
    """Write a record per row of ``pages`` to WARC files (gzip, a member each) in the folder ``path``."""
    prepare(pages.sparkSession)
    files = records(plan_records(pages, **names)).mapInArrow(_files, "content binary")
    files.select(F.col("content").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(archive: bytes):
    """(offset, content) of each gzip member of a file, one at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpacker, out, end = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            part = view[end : end + (1 << 16)]
            if not part:
                raise ValueError(f"the member at {at} is cut off")
            out.append(unpacker.decompress(part))
            end += len(part)
        yield at, b"".join(out)
        at = end - len(unpacker.unused_data)


def parse(archive: bytes):
    """(offset, header fields, block) of each record of a file; the offset is that of its member."""
    for at, record in members(archive):
        if not record:
            continue
        end = record.index(b"\r\n\r\n")
        version, *lines = record[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        stop = end + 4 + int(fields["content-length"])
        if record[stop:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, fields, record[end + 4 : stop]


def url_key(url: str) -> str:
    """The url with its host's labels turned round, lower case, without scheme and fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:cut].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].lower() or "/")


_INDEX = "id bigint, url string, url_key string, captured string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, archive string, offset bigint, has_body boolean"


def _number(urn: str | None) -> int | None:
    value = (urn or "").removeprefix(f"<{_URN}").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def _index_files(batches):
    names = [x.split()[0] for x in _INDEX.split(", ")]
    types = dict(bigint=pa.int64(), string=pa.string(), boolean=pa.bool_())
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _INDEX.split(", ")])
    for batch in batches:
        for path, content in zip(column(batch, "path").to_pylist(), column(batch, "content"), strict=True):
            own = []
            for offset, fields, block in parse(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.lower().rpartition(b"content-length:")[2])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: the payload at {offset} is not the one that was written")
                url = fields.get("warc-target-uri")
                own.append((_number(fields["warc-record-id"]), url, url_key(url or ""), fields["warc-date"], kind, digest, size, _number(fields.get("warc-refers-to")), path.rsplit("/", 1)[-1], offset, kind == "response"))
            own.sort(key=_capture_order)
            if own:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*own, strict=True), strict=True)), schema=schema)


def _capture_order(row: tuple) -> tuple:
    """Url key, time, id (null first), archive and offset of an index row."""
    return row[2].encode("utf-8", "surrogatepass"), row[3], row[0] is not None, row[0] or 0, row[8], row[9]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``; payloads are checked against their digests."""
    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_index_files, _INDEX)


class LoserTree:
    """Merge sorted runs: each next row takes one comparison for each level of the tree."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            node = (run + self.k) // 2
            while node > 0:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def stretches(keys: list) -> list[list[int]]:
    """Numbers of the keys, cut where a key is smaller than the one before."""
    cuts = [i for i in range(1, len(keys)) if keys[i] < keys[i - 1]]
    return [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, len(keys)])] if keys else []


def _merge_range(batches):
    held = [pa.Table.from_batches([b]) for b in batches]
    if not held:
        return
    table = pa.concat_tables(held).combine_chunks()
    keys, times, ids, archives, offsets = (column(table, n).to_pylist() for n in ("url_key", "captured", "id", "archive", "offset"))
    order = [(k.encode("utf-8", "surrogatepass"), t, i is not None, i or 0, a, o) for k, t, i, a, o in zip(keys, times, ids, archives, offsets, strict=True)]
    merged = list(LoserTree(stretches(order), order.__getitem__))
    yield from table.take(pa.array(merged, pa.int64())).to_batches()


def merge_index(index: DataFrame) -> DataFrame:
    """The written ``index`` in global order of (url_key, captured, id): range by range, merged from runs."""
    prepare(index.sparkSession)
    ranges = max(partitions(index.sparkSession), -(-index.count() // RANGE_ROWS))
    return index.repartitionByRange(ranges, "url_key", "captured", "id", "archive", "offset").mapInArrow(_merge_range, _INDEX)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write, read back and merge. One row per input row in global capture order.

    (id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive,
    offset). Null html is the empty payload. Of equal payloads of ``LEAST_REVISIT`` bytes or
    more the smallest id is the response; rows that share that id are all responses. A null
    id is never revisited; a null url has no target and the key ``)/``. Other columns are
    ignored. The archives stay in the new folder ``path``; without one they go in the end.
    """
    spark = pages.sparkSession
    folder = path or new_folder(spark, "warc")
    write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    index = materialise(read_index(spark, folder), "index")
    if not path:
        delete(spark, folder)
    return merge_index(index).select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "offset")
