"""Byte-level BPE through a table of distinct words.

1. Blocks of documents (``BLOCK_BYTES`` of text) are split into words. A block keeps, for
   each position, the number of its word, and its distinct words once.
2. The distinct words of all blocks meet by a hash of the word; each is encoded once there,
   and its ids go back to the blocks that asked for it.
3. A block joins ids to positions by word number.

Words are cut at a space between two non-spaces (the space begins the next word) and around a
lone line feed. The tokenizer's own pattern always cuts there, so words encode independently.
Texts with any other white space, NUL or a special token's text are cut by the tokenizer's
pre-tokenizer instead, which gives the same property.

Decoding joins ids to the table of pieces, whose size is the vocabulary's.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache_of, column, materialise, partitions, prepare, runs, tidy, trim

#: Bytes of text in a block, and buckets of words for each shuffle partition.
BLOCK_BYTES = 8 << 20
BUCKETS_PER_PARTITION = 2
#: Most buckets. Each block has a row in each of them, so more would leave a word or two in a row.
MAX_BUCKETS = 4096
#: Bytes of text that are split at once: the copies that this takes stay small beside a block.
SPLIT_BYTES = 1 << 20
#: Words whose ids are joined at once, for the same reason.
POSITIONS = 1 << 17
#: Distinct words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 100_000

_ODD = (
    r"  |\n\n| \n|\n |[\t\r\x0b\x0c\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Below this code point all versions of Unicode agree on letters, numbers and spaces.
_SETTLED = "ɐ"


class Splitter:
    """Cuts texts to words; knows the special tokens of a tokenizer, but not its vocabulary."""

    def __init__(self, special: tuple[str, ...]):
        self.special = special
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.odd = "|".join([_ODD, *(re.escape(c).replace("<", r"\x3c").replace(">", r"\x3e") for c in special)])

    @cached_property
    def _pattern(self):
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True)

    def words(self, text: str) -> list[str]:
        """Words of any text, special tokens on their own."""
        out, at = [], 0
        for match in [*self.cut.finditer(text), None]:
            part = text[at : match.start() if match else len(text)]
            out += [part[a:b] for _, (a, b) in self._pattern.pre_tokenize_str(part)] if part else []
            if match:
                out.append(match[0])
                at = match.end()
        return out


class Vocabulary:
    """A byte-level BPE tokenizer file: encode words, and the bytes of each id."""

    def __init__(self, text: str):
        spec = json.loads(text)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE tokenizer")
        special = spec.get("added_tokens") or []
        if any(t.get(k) for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with stripping or normalisation are not supported")
        self.special = {t["content"]: t["id"] for t in special}
        self.text = text

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _bytes(self, model: dict) -> dict[int, bytes]:
        visible = _visible_bytes()
        return {i: bytes(visible[c] for c in token) for token, i in model["vocab"].items()}

    @cached_property
    def pieces(self) -> dict[int, bytes]:
        """The bytes of each id, special tokens included."""
        return self._bytes(json.loads(self.text)["model"]) | {i: content.encode() for content, i in self.special.items()}

    @cached_property
    def fast(self):
        """The same merges as ranks, if ids were given in the order of merges; else None."""
        import public_tokenizers
        import tiktoken

        model = json.loads(self.text)["model"]
        pieces = self._bytes(model)
        order = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"].get(a + b) for a, b in order]
        singles = {i for i, piece in pieces.items() if len(piece) == 1}
        if len(singles) != 256 or ids != sorted(set(ids)) or {*ids} & singles or {*ids} | singles != set(pieces):
            return None
        ranks = {piece: i for i, piece in pieces.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[list[int]]:
        quick = [self.fast is not None and (w.isascii() or max(w) < _SETTLED) and w not in self.special for w in words]
        slow = [w for w, q in zip(words, quick, strict=True) if not q]
        rest = iter([e.ids for e in self.tokenizer.encode_batch(slow, add_special_tokens=False)] if slow else [])
        return [self.fast.encode_ordinary(w) if q else next(rest) for w, q in zip(words, quick, strict=True)]


def _visible_bytes() -> dict[str, int]:
    """The usual one-character names of bytes: printable Latin-1 is itself, the rest follows 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


cache_of("bpe", _vocabulary.cache_clear)


def _pack(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 3)


def _unpack(body: bytes):
    return pickle.loads(zstandard.decompress(body))


def _planes(numbers: np.ndarray) -> bytes:
    """Little-endian bytes by significance, which compress better than numbers in a row."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _numbered(texts: pa.Array, splitter: Splitter) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each text, the number of the word at each position, the distinct words."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    counts, coded, at = [np.zeros(0, np.uint32)], [], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT_BYTES, side="right")))
        n, words = _words_of(texts[at:stop], splitter)
        counts.append(n)
        coded.append(words.dictionary_encode())
        at = stop
    if not coded:
        return counts[0], np.zeros(0, np.uint32), []
    chunks = pa.chunked_array(coded).unify_dictionaries().chunks
    numbers = [c.indices.to_numpy(zero_copy_only=False).astype(np.uint32) for c in chunks]
    return np.concatenate(counts), np.concatenate(numbers), chunks[0].dictionary.to_pylist()


def _words_of(texts: pa.Array, splitter: Splitter) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all of them in a row."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, splitter.odd)
    has_odd = pc.any(odd).as_py()
    usual = pc.if_else(odd, "", texts) if has_odd else texts
    lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(usual, " ", "\0 "), "\n", "\0\n\0"), "\0")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    if has_odd:
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = [splitter.words(texts[int(i)].as_py()) for i in where]
        starts = np.cumsum(counts) - counts
        words = pa.concat_arrays([words, pa.array([w for ws in cut for w in ws], words.type)])
        starts[where] = int(counts.sum()) + np.cumsum([0, *map(len, cut)])[:-1]
        counts[where] = [*map(len, cut)]
        take = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        words = words.take(pa.array(take))
    return counts.astype(np.uint32), words


def _blocks(special: tuple[str, ...], names: list[str], text_col: str, buckets: int, kinds: tuple[int, ...], block_bytes: int):
    """Arrow function: documents to the payload row (kind 0) and the rows of words (1) of each block.

    A block's number is a hash of its content, so both kinds can be made in separate runs.
    """

    def run(batches):
        import xxhash

        splitter = Splitter(special)
        for table in runs(batches, block_bytes, text_col):
            texts = table.column(text_col).combine_chunks()
            carry = _ipc(table.select(names))
            body = xxhash.xxh64(carry)
            for buffer in pa.concat_arrays([texts]).buffers()[1:]:
                body.update(buffer or b"")
            block = int(np.uint64(body.intdigest()).astype(np.int64))
            counts, numbers, words = _numbered(texts, splitter)
            bucket = (_hashes(words) % np.uint64(buckets)).astype(np.uint32)
            rows = []
            if 0 in kinds:
                rows.append((0, block, -1, _pack((carry, counts, _planes(numbers), bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32)))))
            if 1 in kinds:
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.unique(bucket):
                    own = [words[i].encode() for i in order[ends[b] : ends[b + 1]]]
                    rows.append((1, block, int(b), _pack((np.array([*map(len, own)], np.uint32), b"".join(own)))))
            del texts, counts, numbers, words
            trim()
            yield pa.RecordBatch.from_pydict(dict(zip(_BLOCK.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in _BLOCK.names}, schema=_BLOCK)

    return run


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


_BLOCK = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])
_BLOCK_DDL = "kind int, block bigint, bucket int, body binary"


def _encoder(vocabulary_text):
    """Arrow function: rows of words to rows of ids; a word is encoded at its first row."""

    def run(batches):
        vocabulary, known = _vocabulary(vocabulary_text.value), {}
        for batch in batches:
            out = []
            for body in batch.column(3):
                lengths, data = _unpack(body.as_py())
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                words = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(ids, "<u4").tobytes() for ids in vocabulary.encode(new)), strict=True))
                ids = [known[w] for w in words]
                out.append(_pack((np.array([len(x) // 4 for x in ids], np.uint32), _planes(np.frombuffer(b"".join(ids), "<u4")))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], schema=_BLOCK)

    return run


def _gather(numbers: np.ndarray, counts: np.ndarray, lengths: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where those of each text begin and end, ``POSITIONS`` words at a time.

    Word ``w`` has ``lengths[w]`` ids from ``ids[starts[w]]``; ``numbers`` holds the word at each
    position and ``counts`` how many positions each text has.
    """
    steps = [numbers[at : at + POSITIONS] for at in range(0, len(numbers), POSITIONS)]
    out = np.empty(sum(int(lengths[part].sum()) for part in steps), "<u4")
    texts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])  # positions before each text
    edges, at, done = np.zeros(len(texts), np.int64), 0, 0
    for part in steps:
        n = lengths[part]
        before = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(starts[part] - before[:-1], n)
        of += np.arange(len(of))
        out[done : done + len(of)] = ids[of]
        first, last = np.searchsorted(texts, [at, at + len(part)], side="right")
        edges[first:last] = done + before[texts[first:last] - at]
        at, done = at + len(part), done + len(of)
    return out, edges


def _join(schema: pa.Schema, finish: Callable | None):
    """Grouped Arrow function: a block's payload and its rows of ids to ids by document."""

    def run(payload: pa.Table, replies: pa.Table) -> pa.Table:
        by_bucket = dict(zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist(), strict=True))
        out = []
        for body in payload.column("body").to_pylist():
            carry, counts, planes, bucket = _unpack(body)
            numbers = _from_planes(planes)
            order = np.argsort(bucket, kind="stable")
            found = [_unpack(by_bucket[b]) for b in np.unique(bucket).tolist()]  # a KeyError if one is missing
            lengths = np.zeros(len(bucket), np.int64)
            lengths[order] = np.concatenate([x[0] for x in found]) if found else 0
            ids = np.concatenate([_from_planes(x[1]) for x in found]) if found else np.zeros(0, "<u4")
            starts = np.zeros(len(bucket), np.int64)
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
            joined, edges = _gather(numbers, counts, lengths, starts, ids)
            column = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges * 4), pa.py_buffer(joined)]).cast(pa.binary())
            table = pa.ipc.open_stream(carry).read_all()
            out.append(pa.table([*table.columns, column], schema=pa.schema([*table.schema, ("ids_le", pa.binary())])))
        joined_table = pa.concat_tables(out).cast(schema) if out else schema.empty_table()
        result = finish(joined_table) if finish else joined_table
        trim()
        return result

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", store_blocks: bool = True, finish: Callable | None = None, finish_schema: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ids_le): the ids of each whole text as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library. The ids
    equal its ``encode(text, add_special_tokens=False)`` without truncation and padding. A
    null or empty text has no ids. Null and repeated ids are carried as they are, other
    columns are ignored, an empty table gives an empty result.

    With ``store_blocks`` the split blocks are written once (about 0.7 of the size of Parquet
    input); without it they are split twice, for less disk and more CPU. That needs an input
    whose partitions come out the same each time, as files do; otherwise it raises an error.
    ``finish`` turns the Arrow table of a block (id column ``_id``) into rows of ``finish_schema``
    in the same Python worker.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    special = tuple(_vocabulary(text).special)  # fails here rather than in a task
    shared = spark.sparkContext.broadcast(text)
    buckets = min(BUCKETS_PER_PARTITION * partitions(spark), MAX_BUCKETS)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if store_blocks:
        blocks = materialise(rows.mapInArrow(tidy(_blocks(special, ["_id"], "_text", buckets, (0, 1), block_bytes), "bpe"), _BLOCK_DDL), "blocks")
        payload, words = blocks.where("kind = 0"), blocks.where("kind = 1")
    else:
        payload, words = (rows.mapInArrow(tidy(_blocks(special, ["_id"], "_text", buckets, (kind,), block_bytes), "bpe"), _BLOCK_DDL) for kind in (0, 1))
    words = words.repartition("bucket").mapInArrow(tidy(_encoder(shared), "bpe"), _BLOCK_DDL)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, ids_le binary"
    arrow = pa.schema([(f.name, f.type) for f in to_arrow_schema(rows.select("_id").schema)] + [("ids_le", pa.binary())])
    joined = payload.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_join(arrow, finish), finish_schema or schema)
    return joined.withColumnRenamed("_id", id_col)


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): the bytes of each id of the vocabulary."""
    with open(tokenizer, encoding="utf-8") as file:
        pieces = _vocabulary(file.read()).pieces
    return spark.createDataFrame([(i, bytearray(p)) for i, p in sorted(pieces.items())], "id int, piece binary")


def _decoder(pieces, ids_col: str, out_col: str):
    def run(batches):
        table = _pieces(pieces.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = pc.fill_null(column(batch, ids_col), b"")
            lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            taken = table.take(pa.array(np.frombuffer(b"".join(ids.to_pylist()), "<u4")))
            edges = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
            ends = edges[np.concatenate([[0], np.cumsum(lengths)])]
            data = taken.buffers()[2]
            data = data.to_pybytes() if data is not None else b""
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return run


@lru_cache(2)
def _pieces(body: bytes) -> pa.Array:
    pieces = pickle.loads(body)
    known = pa.array([pieces.get(i) for i in range(max(pieces, default=-1) + 1)], pa.large_binary())
    return known


def decode(encoded: DataFrame, pieces: DataFrame, ids_col: str = "ids_le", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included, in ``out_col``.

    ``pieces`` is the id-to-piece table; its size is the vocabulary's, so every task gets a
    copy and joins by id. Null ids decode to the empty text; bytes that are no UTF-8 become
    U+FFFD. An id that no piece has raises an error.
    """
    spark = encoded.sparkSession
    prepare(spark)
    table = pickle.dumps({row["id"]: bytes(row["piece"]) for row in pieces.collect()}, 5)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{out_col}` string"])
    return encoded.mapInArrow(_decoder(spark.sparkContext.broadcast(table), ids_col, out_col), schema)
