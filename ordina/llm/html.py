"""Main text of web pages: markup where it says what a block is, a host suffix array elsewhere.

A page is cut into blocks. Blocks in an ``article`` (or else ``main``) element are the article;
blocks in elements that markup clearly names as a menu, header, footer, sidebar, notice, advert,
form or comment are not. Two kinds of blocks are undecided: all others of a page without an
``article`` or ``main``, and blocks whose class only hints at something around an article
(``post-header``, ``share-price``).

For these, the token streams of a host's pages (all blocks that are not clearly the article) are
concatenated and their suffixes sorted by their first ``RUN`` tokens, page and position, over
range partitions. The common prefix of neighbours in that order tells the repeated substrings of
``RUN`` tokens or more; those that two pages have are boilerplate. Their tokens are removed from
undecided blocks, and runs that occur on one page alone stay. A class of equal prefixes may cross
the borders of partitions: its pages at each border are compared afterwards, so no host and no
class has to meet in one task.
"""

from __future__ import annotations

import html as entities
import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ddl, materialise, partitions, plain, prepare

#: Tokens of the shortest repeated run that counts as boilerplate.
RUN = 8
#: Bytes from which a token stands in the suffix array as its 128-bit hash.
LONG_TOKEN = 40

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements whose content is no markup, and elements that are never part of an article.
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_DROPPED = frozenset("head nav footer aside form noscript template svg math button select dialog menu object audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture map area".split()
)
#: Elements that hold a piece of running text, and those that the next of their kind closes.
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption li dt dd td th tr caption summary".split())
_SUCCEEDED = frozenset("li dt dd td th tr option".split())
#: Words of a class, an id or a role that name what is around an article.
_AROUND = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination footer header masthead "
    "comment comments disqus replies respond share sharing social related recommended login signup search toolbar contentinfo complementary".split()
)
#: Those that remove an inline element from a line of text as well.
_AROUND_INLINE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo share sharing social comment comments popup newsletter".split())
_NEGATED = frozenset("no has with without is not".split())
_CORE = ("article", "main")
_ROOT = frozenset("html body main".split())


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag and (start, end, ...) of other markup, with an empty name.

    One pass: a quote counts only after ``=``. If a tag's quotes leave it open to the end of the
    page, it and all later tags end at their first ``>``; what has none is text.
    """
    at, size, strict = 0, len(page), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            ends = [(i, n) for i, n in ((page.find("-->", start + 2), 3), (page.find("--!>", start + 4), 4)) if i >= 0]
            end, n = min(ends, default=(size, 0))
            at = end + n
            yield start, at, "", "", ""
            continue
        name = _NAME.match(page, start + 1)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
                yield start, at, "", "", ""
            else:
                at = start + 1
            continue
        end = _tag_end(page, name.end()) if strict else -1
        if end < 0:
            strict = False
            end = page.find(">", name.end())
        if end < 0:
            return
        at = end + 1
        yield start, at, name[1], name[2].lower(), page[name.end() : end]
        if not name[1] and name[2].lower() in _RAW:
            close = re.compile(rf"</{re.escape(name[2])}(?=[\s/>])", re.IGNORECASE).search(page, at)
            end = page.find(">", close.end()) if close else -1
            start, at = at, end + 1 if end >= 0 else size
            yield start, at, "", "", ""


def _tag_end(page: str, at: int) -> int:
    while True:
        stop = _STOP.search(page, at)
        if not stop:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = _SPACE.match(page, stop.end()).end()
        if page[at : at + 1] in ("'", '"'):
            at = page.find(page[at], at + 1) + 1
            if not at:
                return -1


def _ends(found: list[tuple]) -> dict[int, int]:
    """The number of the closing tag of each opening tag that has one; of equal names the last opened closes first."""
    opened: dict[str, list[int]] = {}
    out = {}
    for i, (_, _, closing, name, _) in enumerate(found):
        if name and not closing:
            opened.setdefault(name, []).append(i)
        elif name and opened.get(name):
            out[opened[name].pop()] = i
    return out


def _hint(attributes: str, words: frozenset = _AROUND) -> int:
    """2 if a class, id or role names something around an article, 1 if its first or last part does."""
    most = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for word in "".join(values).lower().split():
                parts = [p for p in re.split(r"[-_]+", word) if p]
                if parts and parts[0] not in _NEGATED:
                    most = max(most, 2 if all(p in words for p in parts) else int(parts[0] in words or parts[-1] in words))
    return most


class _Region:
    """What lies in an element that is left out (or only hinted at), and the articles opened in it."""

    def __init__(self, end: int | None = None, name: str = "", hint: bool = True):
        self.end, self.name, self.hint = end, name, hint
        self.core: list[str] = []
        self.counts = dict.fromkeys(_CORE, 0)


class _Nesting:
    """Open regions, the page itself first. Every step is constant or paid for by what it closes."""

    def __init__(self):
        self.regions, self.sure, self.open = [_Region()], 0, dict.fromkeys(_CORE, 0)
        self.by_end: dict[int, int] = {}

    @property
    def top(self) -> _Region:
        return self.regions[-1]

    @property
    def articles(self) -> int:
        return sum(self.open.values())

    def kind(self) -> str:
        if self.top.core and len(self.regions) == 1:
            return "article" if self.top.counts["article"] else "main"
        if self.sure:
            return "inner" if self.top.core else "around"
        return "doubt" if len(self.regions) > 1 else "open"

    def enter(self, end: int | None, name: str, hint: bool) -> None:
        if hint and self.top.hint and len(self.regions) > 1 and not self.top.core:
            return  # it says nothing new
        if end is not None:
            self.by_end[end] = len(self.regions)
        self.regions.append(_Region(end, name, hint))
        self.sure += not hint

    def leave(self, depth: int) -> None:
        while len(self.regions) > depth:
            region = self.regions.pop()
            self.sure -= not region.hint
            for name, n in region.counts.items():
                self.open[name] -= n

    def open_core(self, name: str) -> None:
        self.top.core.append(name)
        self.top.counts[name] += 1
        self.open[name] += 1

    def close_core(self, name: str) -> None:
        if not self.open[name]:
            return
        depth = len(self.regions) - 1
        while not self.regions[depth].counts[name]:
            depth -= 1
        self.leave(depth + 1)
        popped = ""
        while popped != name:
            popped = self.top.core.pop()
            self.top.counts[popped] -= 1
            self.open[popped] -= 1


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks that hold text.

    article, main; inner: in an article that lies in an element around the article; doubt: a hint
    only; around; open: all others.
    """
    page = page or ""
    found = list(tags(page))
    ends = _ends(found)
    out: list[tuple[str, str]] = []
    pieces: list[str] = []
    nest, kind, at = _Nesting(), "open", 0

    def close() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((kind, text))
            pieces.clear()

    for i, (start, end, closing, name, attributes) in enumerate(found):
        if start > at:
            pieces.append(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            pieces.append(" ")
            continue
        depth = nest.by_end.get(i, 0)
        if depth and depth < len(nest.regions) and nest.regions[depth].end == i:
            close()
            nest.leave(depth)
            kind = nest.kind()
            continue
        inline = name in _INLINE
        if inline and (closing or not attributes or _hint(attributes, _AROUND_INLINE) < 2):
            continue
        close()
        if name in _VOID:
            continue
        if closing:
            if name in _CORE:
                nest.close_core(name)
        else:
            _opened(nest, name, attributes, ends.get(i), inline)
        kind = nest.kind()
    if at < len(page):
        pieces.append(page[at:])
    close()
    return out


def _opened(nest: _Nesting, name: str, attributes: str, end: int | None, inline: bool) -> None:
    if len(nest.regions) > 1 and nest.top.end is None:  # a region that is never closed
        last = nest.top.name
        if (last == "p" and not inline) or (last == name and name in _SUCCEEDED):
            nest.leave(len(nest.regions) - 1)
        elif name in _CORE and not nest.articles and not _hint(attributes):
            nest.leave(1)
    hint = _hint(attributes) if attributes and name not in _ROOT else 0
    if inline:
        hint = 2
    elif hint == 2 and nest.articles and name in _TEXTUAL:
        hint = 1
    free = not nest.sure or bool(nest.top.core)
    if free and (name in _DROPPED or (name == "header" and not nest.articles) or hint == 2):
        nest.enter(end, name, False)
    elif free and hint == 1 and name not in _CORE:
        nest.enter(end, name, True)
    elif name in _CORE:
        if not nest.sure and not nest.articles:
            nest.leave(1)  # a hint around a whole article does not count
        nest.open_core(name)


def article_kind(found: list[tuple[str, str]]) -> str | None:
    """The kind of the blocks that are the article; null if markup does not tell."""
    kinds = {k for k, _ in found}
    return next((k for k in ("article", "main", "inner") if k in kinds), None)


def main_text(found: list[tuple[str, str]]) -> str | None:
    """The article of a page that markup decides altogether, else null."""
    kind = article_kind(found)
    if kind is None or any(k == "doubt" for k, _ in found):
        return None
    return "\n".join(t for k, t in found if k == kind)


def _stream(found: list[tuple[str, str]]) -> list[str]:
    """Blocks of the host's token stream: all of a page but what is clearly its article."""
    kind = article_kind(found)
    return [t for k, t in found if k != kind]


def unique_runs(found: list[tuple[str, str]], positions: list[int]) -> str:
    """The article with undecided blocks, without the tokens that repeated runs cover.

    ``positions``: where runs of ``RUN`` tokens begin in the page's stream. Undecided are blocks
    of the kind doubt, and open ones if markup does not tell the article.
    """
    kind = article_kind(found)
    tokens = sum(len(t.split()) for t in _stream(found))
    covered = np.zeros(tokens + RUN + 1, np.int64)
    np.add.at(covered, positions, 1)
    np.add.at(covered, np.asarray(positions, np.int64) + RUN, -1)
    covered = np.cumsum(covered) > 0
    out, at = [], 0
    for k, text in found:
        if k == kind:
            out.append(text)
            continue
        words = text.split()
        own = [w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c]
        at += len(words)
        if own and (k == "doubt" or (k == "open" and kind is None)):
            out.append(" ".join(own))
    return "\n".join(out)


def prefixes(tokens: list[str]) -> list[bytes]:
    """The first ``RUN`` tokens of each suffix that is long enough, each token behind a zero byte."""
    coded = [b"\0" + (t if len(t) < LONG_TOKEN else b"\1" + xxhash.xxh128_digest(t)) for t in (x.encode("utf-8", "surrogatepass") for x in tokens)]
    return [b"".join(coded[i : i + RUN]) for i in range(len(coded) - RUN + 1)]


def _page_key(page_id, page: str | None) -> int:
    return xxhash.xxh64_intdigest(f"{page_id}\0{page or ''}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _parse(batches):
    """Pages to their text if markup decides it; else null and their blocks. And the host's stream."""
    for batch in batches:
        out: dict[str, list] = {"page": [], "text": [], "blocks": [], "stream": []}
        for page_id, page in zip(column(batch, "_id").to_pylist(), column(batch, "_html").to_pylist(), strict=True):
            found = blocks(page)
            text = main_text(found)
            for name, value in zip(out, (_page_key(page_id, page), text, zstandard.compress(pickle.dumps(found, 5)) if text is None else None, " ".join(_stream(found))), strict=True):
                out[name].append(value)
        types = (pa.int64(), pa.string(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_url"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["_id", "_url", *out])


def _suffixes(batches):
    for batch in batches:
        hosts, pages, undecided, streams = (column(batch, n).to_pylist() for n in ("host", "page", "undecided", "stream"))
        for host, page, wanted, stream in zip(hosts, pages, undecided, streams, strict=True):
            found = prefixes(stream.split())
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array(found, pa.binary()), pa.array([page] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([wanted] * n, pa.bool_())], ["host", "prefix", "page", "position", "undecided"])


def common_tokens(a: bytes, b: bytes) -> int:
    """How many tokens two prefixes share at their beginning."""
    if a == b:
        return RUN
    n = 0
    for x, y in zip(a.split(b"\0")[1:], b.split(b"\0")[1:], strict=False):
        if x != y:
            break
        n += 1
    return n


def _neighbours(batches):
    """Sorted suffixes of one partition to the starts of repeated runs on undecided pages.

    Neighbours with ``RUN`` tokens in common are of one class. The classes at both ends of the
    partition also give a row with their first and last page (``lo``, ``hi``), and while they have
    one page here, their starts wait (``waits``) for what other partitions know.
    """
    rows: list[tuple] = []
    before = None
    first_page, several, pending, first_class = None, False, [], True

    def end_class(at_edge: bool) -> None:
        if before is None:
            return
        host, prefix, page = before
        if at_edge:
            rows.append((host, prefix, None, None, first_page, page, False))
            if not several:
                rows.extend((host, prefix, first_page, p, None, None, True) for p in pending)

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STARTS.types, strict=True)], schema=_STARTS) if rows else None
        rows.clear()
        return batch

    for batch in batches:
        columns = (column(batch, n).to_pylist() for n in ("host", "prefix", "page", "position", "undecided"))
        for host, prefix, page, position, wanted in zip(*columns, strict=True):
            same = before is not None and host == before[0] and common_tokens(prefix, before[1]) >= RUN
            if not same:
                end_class(first_class)
                first_class = before is None
                first_page, several, pending = page, False, []
            elif page != first_page and not several:
                several = True
                rows.extend((None, None, first_page, p, None, None, False) for p in pending)
                pending = []
            if wanted:
                if several:
                    rows.append((None, None, page, position, None, None, False))
                else:
                    pending.append(position)
            before = (host, prefix, page)
        if rows:
            yield flush()
    end_class(True)
    if rows:
        yield flush()


_STARTS = pa.schema([("host", pa.string()), ("prefix", pa.binary()), ("page", pa.int64()), ("position", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("waits", pa.bool_())])
_STARTS_DDL = "host string, prefix binary, page bigint, position int, lo bigint, hi bigint, waits boolean"


def _keep_unique(batches):
    for batch in batches:
        texts = [unique_runs(pickle.loads(zstandard.decompress(b)), p or []) for b, p in zip(column(batch, "blocks").to_pylist(), column(batch, "positions").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_url"), pa.array(texts, pa.string())], ["_id", "_url", "text"])


def repeated_starts(suffixes: DataFrame) -> DataFrame:
    """(page, position): where runs begin that another page of the host has, on undecided pages.

    ``suffixes`` (host, prefix, page, position, undecided) are sorted over range partitions.
    """
    order = ["host", "prefix", "page", "position"]
    ranged = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *order).sortWithinPartitions(*order)
    found = materialise(ranged.mapInArrow(_neighbours, _STARTS_DDL), "starts")
    edges = found.where("lo IS NOT NULL").groupBy("host", "prefix").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi")
    waiting = found.where("waits").join(edges.select("host", "prefix"), ["host", "prefix"], "left_semi")
    return found.where("lo IS NULL AND NOT waits").unionByName(waiting).select("page", "position")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: (id, url, text, n_chars).

    Character references are decoded, white space inside a block becomes one space, blocks
    are trimmed and joined by one line feed. Null, empty and textless pages give the empty text.
    Rows with equal id and html count as one page when repeats are sought; all of them are
    returned. Null ids and urls are carried; pages without a host are one host. Other columns are
    ignored.
    """
    from .url_filter import host_of

    prepare(pages.sparkSession)
    rows = pages.select(plain(id_col).alias("_id"), plain(url_col).alias("_url"), plain(html_col).alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()
    parsed = materialise(rows.mapInArrow(_parse, f"{ddl(rows.schema[:2])}, page bigint, text string, blocks binary, stream string"), "parsed")
    streams = parsed.select(host_of(F.col("_url")).alias("host"), "page", F.col("text").isNull().alias("undecided"), "stream")
    suffixes = materialise(streams.mapInArrow(_suffixes, "host string, prefix binary, page bigint, position int, undecided boolean"), "suffixes")
    starts = repeated_starts(suffixes).distinct()
    positions = starts.groupBy("page").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    open_pages = parsed.where("text IS NULL").select("_id", "_url", "page", "blocks")
    undecided = open_pages.join(positions, "page", "left").mapInArrow(_keep_unique, f"_id {kind}, _url {rows.schema['_url'].dataType.simpleString()}, text string")
    out = parsed.where("text IS NOT NULL").select("_id", "_url", "text").unionByName(undecided)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
