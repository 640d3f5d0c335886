"""Operators against plain versions on small fixtures with nulls, empties, ties and odd columns."""

import gzip
import hashlib
import html as entities
import io
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordina.llm import bpe, common, components, embeddings, exact_dedup, ftrl, html, langid, minhash, packing, quality, url_filter, warc
from ordina.llm.queries import URL_RULES

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, cid string, a int, kept boolean"
ODD = ["a  b", "<|endoftext|>x <|endoftext|>", " \n\n x\t\r\n y", "", None, "日本語 テキスト　です", "it's 12 we'll x  ", "é​ù 😀 ok", " x", "x ", "\n", "a\0b", "A b\nC", "a B c", "a B c", "word " * 3000]


def odd_docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", 1, False) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def classes(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), (3, 1), (7, 3)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 230)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 231)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html_blocks():
    page = (
        "<html><head><title>T</title></head><body class='no-sidebar'><header>H</header><nav><li>m</nav><div class='cookie-notice'>c<div>d</div></div>"
        "<article class=post><h1>A &amp; B</h1><p>one\n two<b>three</b><p>x &lt; y<br>z<script>var a='</p>';</script><aside>no</aside><form>f</form>"
        "<div id=\"comments\"><p>reader</div><p>end&nbsp;.</article><footer>F</footer><!-- <article>no</article> --></body>"
    )
    assert html.main_text(html.blocks(page)) == "A & B\none twothree\nx < y z\nend ."
    assert html.main_text(html.blocks("<nav>open <article><p>in</article>")) == "in"
    assert html.blocks(None) == [] and html.main_text(html.blocks("plain")) is None
    assert html.main_text(html.blocks("<aside><article>teaser</article></aside><article>Main</article>")) == "Main"
    assert html.main_text(html.blocks("<form><article>all<form>in</form> b</article></form>")) == "all\nb"
    assert html.main_text(html.blocks("<div class=content-with-sidebar><article>all</article></div><p>rest")) == "all"
    hints = html.blocks("<article><h1 class='post-header'>T</h1><p class=share-price>P</p><div class=header-one>D</div><p class=notice>N</p><div class=comments>c</div><p>x <b class=share-price>5</b> y</p></article>")
    assert hints == [("doubt", "T"), ("doubt", "P"), ("doubt", "D"), ("doubt", "N"), ("around", "c"), ("article", "x 5 y")]
    assert html.unique_runs(hints, []) == "T\nP\nD\nN\nx 5 y"
    assert html.blocks("<p title=it's>x</p><p title='a>b'>y</p>1 < 2") == [("open", "x"), ("open", "y"), ("open", "1 < 2")]


@pytest.mark.parametrize("unit", ["<a ", '<a b=">" ', "<a b='", "</script", "<article>", "<main><article></main>", "<p class=ad>", "<form>", "<div class='x-ad'>", "<div class=ad><article>", "</article><div class=ad><main>", "<!-", "&amp", "a=' a=\" "])
def test_html_of_a_megabyte(unit):
    began = time.perf_counter()
    html.blocks(unit * ((1 << 20) // len(unit)))
    assert time.perf_counter() - began < 10


def test_html_tables(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)(</article>|$)", r["html"], re.DOTALL)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>|<br>", body)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_html_repeats_without_markup(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, "http://h.example.org/x", f"<div>{menu}</div><div>own{i} words{i} only{i}</div>", 1) for i in range(4)]
    rows += [(9, "http://other.example.org/", f"<div>{menu}</div>", 1), (10, None, None, 1), (11, "http://h.example.org/", "", 1), (0, "http://h.example.org/x", rows[0][2], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect())
    own = [(i, f"own{i} words{i} only{i}", 17) for i in (0, 0, 1, 2, 3)]
    assert got == sorted([*own, (9, menu, len(menu)), (10, "", 0), (11, "", 0)])
    assert html.extract(df.limit(0)).count() == 0


def test_html_hints_are_decided_by_repeats(spark):
    share = " ".join(f"share{i}" for i in range(9))
    rows = [(i, "http://h.org/", f"<article><p>text {i}</p><div class=share-box>{share}</div><p class=share-price>price{i} now</p></article>") for i in range(3)]
    rows.append((None, None, f"<article>alone<div class=share-box>{share}</div></article>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}\nprice{i} now" for i in range(3)} | {None: f"alone\n{share}"}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_suffixes_meet_across_partitions(spark, parts):
    """Repeated runs against a plain count, with classes that fill several range partitions."""
    draw = random.Random(8)
    tokens = [(h, p, [draw.choice(["a", "b", "x" * 50]) if h else "same" for _ in range(draw.randrange(5, 60))]) for h in range(3) for p in range(12)]
    where = {}
    for h, p, found in tokens:
        for i in range(len(found) - html.RUN + 1):
            where.setdefault((h, *found[i : i + html.RUN]), []).append((100 * h + p, i))
    want = {x for places in where.values() if len({p for p, _ in places}) > 1 for x in places if x[0] % 2}
    rows = [(str(h), prefix, 100 * h + p, i, p % 2 == 1) for h, p, found in tokens for i, prefix in enumerate(html.prefixes(found))]
    suffixes = spark.createDataFrame([(a, bytearray(b), *c) for a, b, *c in rows], "host string, prefix binary, page long, position int, undecided boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [(r["page"], r["position"]) for r in html.repeated_starts(suffixes).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == want
    assert html.common_tokens(*html.prefixes("a b c d e f g h i".split())) == 0 and html.common_tokens(html.prefixes(list("abcdefgh"))[0], html.prefixes(list("abcdefgx"))[0]) == 7


def test_bpe(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "1L _id", "'' cid", "1 a", "true kept"))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for store in (True, False):
        rows = bpe.decode(bpe.encode(docs, TOKENIZER, store_blocks=store), bpe.piece_table(spark, TOKENIZER)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert np.frombuffer(r["ids_le"], "<u4").tolist() == ids
            assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty(spark), TOKENIZER).count() == 0


def test_packing(spark):
    docs = odd_docs(spark)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER, 64, 2).collect()
    by_doc, by_sequence = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(ODD):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for n, r in enumerate(by_doc[i]):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == 64 or n == 0
            at += r["length"]
        assert at == len(ids) and (len(ids) > 64 or len(by_doc[i]) == 1)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1024: 5}, {600: 10, 500: 10, 300: 5, 124: 3}, {i: 1 + i % 7 for i in range(1, 1025)}])
def test_packing_plan(histogram):
    plan = packing.solve(histogram, 1024)
    lengths = np.array([k for k, n in histogram.items() for _ in range(n)], np.int64)
    ranks = np.array([i for n in histogram.values() for i in range(n)], np.int64)
    if len(lengths):
        sequence, offset = plan.place(lengths, ranks)
        assert sequence.max() + 1 == plan.sequences == len(set(sequence.tolist()))
        order = np.lexsort((offset, sequence))
        start = np.r_[True, sequence[order][1:] != sequence[order][:-1]]
        assert (offset[order] == np.where(start, 0, np.r_[0, (offset + lengths)[order][:-1]])).all() and (offset + lengths).max() <= 1024
        assert plan.bound <= plan.sequences <= 1.005 * plan.bound + 3
    with pytest.raises(ValueError):
        packing.solve({1025: 1}, 1024)


@pytest.mark.parametrize("demand", [{600: 10, 500: 10, 300: 5, 124: 3}, {i: 1 + i % 7 for i in range(1, 1024)}])
def test_packing_program_covers_all(demand):
    count = np.zeros(1025, np.int64)
    count[list(demand)] = list(demand.values())
    shares, bound = packing.cover(count, 1024)
    assert all((taken * np.arange(1025)).sum() <= 1024 for taken, _ in shares)
    covered = sum(taken * x for taken, x in shares)
    assert np.allclose(covered, count) and bound >= (count * np.arange(1025)).sum() / 1024
    assert len(demand) < 1000 or bound <= sum(x for _, x in shares) <= 1.002 * bound


def test_packing_follows_the_program():
    draw = np.random.default_rng(6)
    lengths, n = np.unique(np.minimum(1023, draw.geometric(1 / 300, 20_000)), return_counts=True)
    plan = packing.solve(dict(zip(lengths.tolist(), n.tolist(), strict=True)), 1024)
    assert plan.share == 1.0 and plan.by_program > 0.9 * n.sum() and plan.sequences <= 1.002 * plan.bound + 1


def test_exact(spark):
    texts = ["a b", "ab", " a\tb ", None, "", " \r\n", "c", "é b", "éb", " b"] + ["hot text"] * 300 + ["hottext "]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd_docs(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub("[ \t-\r]+", "", t or ""), []).append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(members)[1], len(members), min(members)[1] == i, hashlib.sha256(norm.encode()).hexdigest())
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    assert sorted(r["kept"] for r in exact_dedup.exact_groups(twice).collect()) == [False, False, True, True]
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://a.b.net/es/q?x#y", "http://net/fr/", "http://xnet/fr/", "http://a.com", "http://a.com/", "x://y://z.net/es/", "http://İ.net/es/é", "http://a.net/es"]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, urls[3], "h", "p"), (6, urls[6], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES)).collect())

    def plain(i, url):
        match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in match[1]), match[2]) if match else ("", "")
        fits = [(len(r), r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        return (i, host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == Counter(plain(i, u) for i, u, *_ in rows)
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark, [])).count() == len(rows)
    many = [(f"h{i}.org/p/", "block") for i in range(3000)]
    blocks, table = url_filter.blocked_bloom(url_filter.rule_table(spark, many), len(many))
    assert len(table) == blocks * url_filter.BLOCK_WORDS
    keys = spark.createDataFrame([(f"h{i}.org/p/",) for i in range(6000)], "k string")
    passed = {r["k"] for r in keys.where(url_filter.maybe_listed(F.col("k"), blocks, table)).collect()}
    assert {k for k, _ in many} <= passed and len(passed) < 3300


def test_warc(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a.org/1", big, 0), (2, "http://www.A.org/x\r\nWARC-Type: y", big, 0), (3, None, None, 0), (4, "u", "", 0), (6, "http://b.org", "short", 0), (7, "http://b.org", "short", 0), (8, "http://c.org", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20, 0), (2, "http://www.a.org/x", big, 0)]
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect())
    want = []
    for i, _, text, _ in rows:
        body = (text or "").encode()
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if i == 5 else "response", 2 if i == 5 else None))
    assert got == sorted(want)


def test_warc_members_and_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    draw = random.Random(3)
    rows = [(None if i % 50 == 7 else i % 280, None if i % 41 == 3 else f"http://{draw.choice('ab')}.org/{draw.choice('Aéz')}", "x" * (i % 3) if i % 5 else "<p>" * 50) for i in range(300)]
    schema = "page_id long, url string, html string"
    frame = spark.createDataFrame(rows, schema).repartition(6)
    found = warc.archive_round_trip(frame, path=f"{tmp_path}/archives").collect()
    order = [(r["url_key"].encode(), r["captured"], r["page_id"] is not None, r["page_id"] or 0, r["archive"], r["offset"]) for r in found]
    assert order == sorted(order) and sorted(str(r["page_id"]) for r in found) == sorted(str(i) for i, _, _ in rows)
    assert {r["record_type"] for r in found if r["page_id"] is None} == {"response"}
    for r in found[::17]:  # a reader can seek to a record
        data = (tmp_path / "archives" / r["archive"]).read_bytes()
        record = gzip.GzipFile(fileobj=io.BytesIO(data[r["offset"] :])).read().decode()
        assert record.startswith("WARC/1.1\r\n") and f"sha256:{r['payload_digest']}" in record.split("\r\n\r\n")[0]
        gzip.decompress(data)
    assert warc.archive_round_trip(spark.createDataFrame([], schema)).count() == 0


def test_warc_files_are_bounded():
    long = random.Random(4).randbytes(1 << 24)  # its member ends in another byte than zero
    files = list(warc._files([pa.record_batch([pa.array([long, b"a"] + [b"b"] * 2500, pa.binary())], ["record"])]))
    files = [f.column(0)[0].as_py() + b"\0" for f in files]
    assert len(files) == 4 and b"".join(gzip.decompress(f) for f in files) == b"".join(x + b"\r\n\r\n" for x in [long, b"a"] + [b"b"] * 2500)
    assert max(sum(1 for _ in warc.members(f)) for f in files) <= warc.FILE_RECORDS
    assert warc.stretches([]) == [] and warc.stretches([1, 1, 3, 2, 5, 0]) == [[0, 1, 2], [3, 4], [5]]


def test_loser_tree():
    draw = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(draw.integers(0, 50, draw.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_cells_meet_once():
    cells = np.arange(9)
    meets = embeddings._receives(cells[:, None], cells[None])
    assert (meets ^ meets.T == ~np.eye(9, dtype=bool)).all()


def test_embeddings(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(40, 16))
    vectors = [b + draw.normal(size=16) * s for b in base for s in (0, 0.05, 0.1, 0.16)] + [base[0]] * 30
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [None] + [1.0] * 15, 0), (1005, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, size int")
    matrix = np.array(vectors)
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    label = classes(len(unit), np.argwhere(linked).tolist())
    want = {i: (int(linked[i].sum()), label[i], label[i] == i) for i in range(len(unit))} | {i: (0, i, True) for i in range(1000, 1006)}
    # Vectors of another length have cells of their own: a pair of two components, ten of one direction with five.
    other = [(2000, [2.0, 4.0], 0)] + [(2010 + i, [float(x) * (i + 1) for x in (1, 2, 3, 4, 5)], 0) for i in range(10)]
    df = df.unionByName(spark.createDataFrame(other, df.schema))
    want |= {1005: (1, 1005, True), 2000: (1, 1005, False)} | {2010 + i: (9, 2010, i == 0) for i in range(10)}
    for margin, cell, block in ((1.0, embeddings.CELL, embeddings.BLOCK), (None, 12, 5), (1.0, 40, 16)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df, margin=margin, cell=cell, block=block).collect()}
        assert got == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("width", "least"), [(16, 1.0), (64, 0.999), (200, 0.999)])
def test_embeddings_recall_with_the_shipped_margin(spark, width, least):
    """Links just above the threshold, in many cells, against brute force."""
    draw = np.random.default_rng(width)
    base = draw.normal(size=(600, width))
    base /= np.linalg.norm(base, axis=1)[:, None]
    beside = draw.normal(size=base.shape)
    beside -= (beside * base).sum(axis=1)[:, None] * base
    beside /= np.linalg.norm(beside, axis=1)[:, None]
    cosine = draw.uniform(0.951, 0.97, 600)[:, None]
    matrix = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * beside])
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    brute = int(((matrix @ matrix.T) >= 0.95).sum()) - len(matrix)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    found = embeddings.near_vectors(df, cell=20, block=16).collect()
    assert len(found) == len(matrix) and brute >= 1200
    assert least * brute <= sum(r["n_links"] for r in found) <= brute


@pytest.mark.parametrize(("words", "threshold"), [(3, (85, 100)), (5, (80, 100))])
def test_minhash(spark, words, threshold):
    draw = np.random.default_rng(3)
    texts = [None, "", " \n", "One", "one ", "one two", "ONE two"]
    for g in range(12):
        own = [f"w{draw.integers(0, 4000)}" for _ in range(150)]
        for _ in range(25 if g == 0 else 5):
            copy = list(own)
            for at in draw.integers(0, 150, draw.integers(0, 7)):
                copy[at] = f"e{draw.integers(0, 60)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and threshold[1] * len(sets[i] & sets[j]) >= threshold[0] * len(sets[i] | sets[j])]
    label = classes(len(sets), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_docs(spark, texts), words, threshold).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def test_minhash_blocks_of_a_template(spark, monkeypatch):
    """Many documents in the same buckets that link with few others: every pair across components, in bounded groups."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    draw = np.random.default_rng(9)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for g in range(70):  # at similarity 0.74 to 0.8 with each other
        copy = list(template)
        for at in draw.choice(300, 13, replace=False):
            copy[at] = f"g{g}w{at}"
        texts += [" ".join(copy), " ".join([*copy[:150], f"x{g}", *copy[151:]])]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    label = classes(len(sets), links)
    assert 40 < len(set(label)) < 140
    across = minhash._across

    def counted(threshold):
        run = across(threshold)

        def wrapped(rows):
            assert len(rows) < 60, "a group grows with its bucket"
            return run(rows)

        return wrapped

    monkeypatch.setattr(minhash, "_across", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(odd_docs(spark, texts), 3, (85, 100)).collect()}
    assert got == dict(enumerate(label))


def test_minhash_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, text), (5, text), (5, "quite another text of words"), (5, None), (2, text + " more"), (9, "quite another text of words"), (2, text + " more")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect())
    assert got == sorted([("None", 78, "None", True)] * 2 + [("5", 78, "2", False), ("5", 3, "2", False), ("5", 0, "2", False), ("9", 3, "2", False)] + [("2", 79, "2", True)] * 2)


def test_bits_of_both(monkeypatch):
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 256, (5, 70), np.uint8), draw.integers(0, 256, (7, 70), np.uint8)
    monkeypatch.setattr(minhash, "CHUNK", 16)
    assert (minhash._both_missing(x, y) == np.array([[np.bitwise_count(a & b).sum() for b in y] for a in x])).all()


def test_minhash_empty(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_classifiers(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    out = found[found["held_out"]]
    assert found["score"].between(0, 1).all() and (out["predicted"] == out["quality"]).mean() > 0.95
    spoken = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = spoken[spoken["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97 and spoken["score"].between(0, 1).all()
    crc = [zlib.crc32(str(i).encode()) % 3 == 1 for i in spoken["doc_id"]]
    assert crc == spoken["held_out"].tolist()


def test_classifiers_on_odd_rows(spark):
    docs, none = odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert [found[i] for i in (3, 4, 10)] == ["und"] * 3 and found[12] == "en"
    assert quality.classify(empty(spark), none).count() == 0 and langid.identify(empty(spark)).count() == 0


def plain_ftrl(rows, labels, outputs, epochs, seed, alpha, beta, l1, l2):
    """Follow-the-regularised-leader number by number; rows are {feature: value}, one sigmoid or a softmax."""
    z, n = Counter(), Counter()
    draw = np.random.default_rng(seed)

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    def chances(row):
        sums = [sum(v * weight((f, k)) for f, v in row.items()) for k in range(outputs)]
        if outputs == 1:
            return [1 / (1 + math.exp(-sums[0]))]
        e = [math.exp(x - max(sums)) for x in sums]
        return [x / sum(e) for x in e]

    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            found = chances(rows[i])
            for k, p in enumerate(found):
                error = p - (labels[i] if outputs == 1 else labels[i] == k)
                for f, v in rows[i].items():
                    w, g = weight((f, k)), v * error
                    step = (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha
                    z[f, k] += g - step * w
                    n[f, k] += g * g
    return weight, chances


def test_quality_against_plain_training(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: (r["o"], r["quality"]) for r in labels.select("doc_id", "quality", F.xxhash64("doc_id", F.lit(3)).alias("o")).collect()}
    learned = sorted((o, q, i) for i, (o, q) in marks.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in texts)
    rows = [{f: float(np.float32(v)) for f, v in zip(*(x.tolist() for x in quality.features(texts[i])), strict=True)} for _, _, i in learned]
    _, chances = plain_ftrl(rows, [q for _, q, _ in learned], 1, quality.EPOCHS, 11, **quality.RATES)
    for r in quality.classify(docs, labels).collect():
        want = chances(dict(zip(*(x.tolist() for x in quality.features(texts[r["doc_id"]])), strict=True)))[0]
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (want >= 0.5)


def test_language_against_plain_training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", F.lit(10)).alias("o")).collect()
    grams = {r["doc_id"]: langid.counts(r["text"]) for r in rows}
    learned = sorted((r["o"], r["doc_id"], r["lang"]) for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1)
    seen = sum((grams[i] > 0).astype(int) for _, i, _ in learned if grams[i] is not None)
    learned = [x for x in learned if grams[x[1]] is not None]
    idf = np.log((1 + len(learned)) / (1 + seen)) + 1
    names = sorted({lang for _, _, lang in learned})

    def row(i):
        at = np.flatnonzero(grams[i])
        values = np.sqrt(grams[i][at]) * idf[at]
        return dict(zip(at.tolist(), (values / np.sqrt((values**2).sum())).tolist(), strict=True))

    firsts = {names.index(lang): n for n, (_, _, lang) in reversed([*enumerate(learned)])}
    back = {n for n in range(len(learned)) if n % 5 == 4} - set(firsts.values())
    train = [n for n in range(len(learned)) if n not in back]
    weight, _ = plain_ftrl([row(learned[n][1]) for n in train], [names.index(learned[n][2]) for n in train], len(names), langid.EPOCHS, 13, **langid.RATES)
    logits = lambda i: np.array([sum(v * weight((f, k)) for f, v in row(i).items()) for k in range(len(names))])
    heat = ftrl.temperature(np.array([logits(learned[n][1]) for n in sorted(back)]), np.array([names.index(learned[n][2]) for n in sorted(back)]))
    for r in langid.identify(docs).collect():
        if grams[r["doc_id"]] is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        e = np.exp(logits(r["doc_id"]) / heat - max(logits(r["doc_id"]) / heat))
        assert abs(r["score"] - e.max() / e.sum()) < 1e-6 and r["lang_pred"] == names[int(e.argmax())]


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i % 40, f"{'good' if i % 2 else 'bad'} word{i % 7}", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == langid.identify(docs).count() == 400
    rows = spark.createDataFrame([(3, 5), (1, 5), (2, 5), (9, 1)], "o long, s long")
    assert common.within(rows, 11, "s", "o")["o"].tolist() == [1, 2] and sorted(common.within(rows, 4, "s", "o", F.col("o") == 9)["o"]) == [1, 9]


def test_training_rows_come_in_order(spark, monkeypatch):
    monkeypatch.setattr(common, "AT_ONCE", 3)
    rows = [(5, b"b", "x\0", b"1", 2), (1, b"", "y", b"22", 4), (5, b"a", None, b"333", 2), (5, b"a", "z", b"", 2), (9, b"c", "w", b"4", 2)]
    found = common.within(spark.createDataFrame(rows, "o long, at binary, name string, n binary, s long"), 10, "s", "o")
    got = [(int(found["o"][i]), found.bytes_of("at", i), found["name"][i], found.bytes_of("n", i), int(found["s"][i])) for i in range(len(found))]
    assert got == [rows[1], rows[3], rows[2], rows[0]]
    assert len(common.within(spark.createDataFrame([], "o long, at binary, s long"), 10, "s", "o")) == 0


def test_training_rows_stay_out_of_memory(spark):
    word = "concat('w', cast(xxhash64(id, x) as string))"
    docs = spark.range(150).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, 20000), x -> {word})) AS text", "cast(id % 2 as int) AS quality")
    tracemalloc.start()
    try:
        assert quality.fit(docs, docs).any()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20  # 95 MB when all rows were held


def test_more_than_a_hundred_languages(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(130):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        for n in range(9 if k < 110 else 4):
            rows.append((len(rows), " ".join("".join(draw.choice(letters, 4)) for _ in range(12)), f"l{k:03}"))
    rows.append((len(rows), "123", "digits"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1} - {"digits"}
    assert len(taught) > 120 and langid.fit(docs).languages == sorted(taught)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    # Every language that has a row to learn from is predicted.
    assert np.mean([found[i] == lang for i, _, lang in rows if lang in taught]) > 0.95 and len(set(found.values())) > 120


def test_sparse_rows():
    matrix = np.where(np.random.default_rng(6).random((50, 7)) < 0.3, 1.5, 0.0)
    at, values = np.array([3, 0, 49, 20]), np.array([0.5, 1.0, 2.0, 0.1])
    for rows in (ftrl.SparseRows.of(matrix), ftrl.SparseRows.joined([ftrl.SparseRows.of(matrix[:20]), ftrl.SparseRows.of(matrix[20:])])):
        assert np.allclose(rows.dot(at, values), values @ matrix[at])
        assert (rows.dot(np.zeros(0, np.int64), np.zeros(0)) == 0).all()


def test_training_state_in_a_file(monkeypatch):
    draw = np.random.default_rng(7)
    rows = [(draw.choice(40, 5, replace=False), draw.random(5)) for _ in range(30)]
    labels, rates = draw.integers(0, 3, 30), {"alpha": 0.5, "beta": 1.0, "l1": 0.01, "l2": 0.5}
    want = ftrl.train_multinomial(rows, labels, 40, 3, 2, **rates)
    monkeypatch.setattr(ftrl, "IN_MEMORY", 0)
    got = ftrl.train_multinomial(rows, labels, 40, 3, 2, **rates)
    assert all((getattr(got, n) == getattr(want, n)).all() for n in ("start", "columns", "values"))


def test_quality_features_follow_whole_words():
    long = "字" * 64
    at = [set(quality.features(long + rest)[0].tolist()) for rest in ("", "a1" * 500, "!?" * 500)]
    shapes = [set(quality.features(rest)[0].tolist()) & a for rest, a in (("a1" * 32, at[1]), ("!?" * 32, at[2]))]
    assert len(at[0]) < len(at[1]) and shapes[0] and shapes[1] and len(at[1] ^ at[2]) > 4
    assert quality.shape("A" * 100 + "!") == "A!"


@pytest.mark.parametrize("step", [1, 3, 1 << 17])
def test_ids_join_in_steps(monkeypatch, step):
    monkeypatch.setattr(bpe, "POSITIONS", step)
    ids = [[5], [], [6, 7, 8], [9, 10]]
    lengths = np.array([*map(len, ids)])
    starts, flat = np.cumsum(lengths) - lengths, np.array(sum(ids, []), "<u4")
    for texts in ([], [[]], [[1], [1, 1]], [[0, 2], [], [3, 3, 1, 0], [2], []]):
        numbers, counts = np.array(sum(texts, []), np.uint32), np.array([*map(len, texts)], np.uint32)
        joined, edges = bpe._gather(numbers, counts, lengths, starts, flat)
        plain = [sum((ids[w] for w in text), []) for text in texts]
        assert [joined[a:b].tolist() for a, b in zip(edges, edges[1:])] == plain
