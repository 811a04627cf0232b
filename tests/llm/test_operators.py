"""The corpus operators against plain versions, on fixtures with nulls, ties, copies and odd columns."""

import base64
import bz2
import gzip
import lzma
import math
import random
import re
import time
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docforge.llm import common, contamination, lines, minhash, mixing, neighbours, pitman_yor, quality, secrets, suffixes, tokens
from docforge.llm.common import components, new_path

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): distinct texts, exact and near copies, a shared passage, empty, null and very long ones."""
    rng = random.Random(5)
    out = [text_of(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = text_of(rng, 70)
    out += [out[3]] * 40 + [out[7].upper()]
    for keep in range(6):
        w = (text_of(random.Random(9), 100)).split()
        w[keep * 9] = f"new{keep}"
        out.append(" ".join(w))
    out += [text_of(rng, 20) + " " + passage + " " + text_of(rng, 20) for _ in range(5)]
    out += ["", None, "   \n\t ", "one", "Ünïcode ßtraße ẞ İ x y z", text_of(rng, 6000), "abc " * 400, passage.replace(" ", "\n")]
    out += [f"pass {k}: password = 'hunter2{k}!' AKIA{'Q' * 16} {'0af1' * 8}" for k in range(3)]
    return list(enumerate(out))


@pytest.fixture
def docs(spark, texts):
    sources = ["a", "b", None, "c"]
    return spark.createDataFrame([(i, t, "en", sources[min(i % 7, 3)], len(t or "")) for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(texts)


def test_near_duplicates_edges(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (2, None, 3)], "doc_id long, text string, kept int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect()), key=repr)
    assert got == [(2, 0, 2, True), (4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True)]


def test_near_duplicates_large_cluster(spark):
    """More members than a block, all distinct and linked only along a chain of neighbours."""
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(minhash.BLOCK + 60):
        w = list(base)
        w[30] = f"only{i}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_near_duplicates_blocks(spark):
    """Chains that drift away from their start, copies around a hub and loners, all compared in small blocks."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    texts, w = [], list(base)
    for i in range(60):
        w = list(w)
        w[rng.randrange(len(w))] = f"drift{i}"
        texts.append(" ".join(w))
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"own{i}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    want = brute.near_duplicates(list(enumerate(texts)))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert len({c for _, c, _ in want.values()}) > 1


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_super_minhash_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    one, two = np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))
    signature = minhash.super_minhash(np.concatenate([one, two]), np.array([0, 800, 1600]), 256)
    assert abs((signature[0] == signature[1]).mean() - 0.6) < 0.12


def test_secrets(docs, texts):
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scan_secrets(docs).collect()}
    assert got == {i: brute.secrets(t) for i, t in texts}


@pytest.mark.parametrize("wrap", [quote, lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(quote(s + " é").encode()).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s)])
def test_secrets_in_layers(spark, wrap):
    inner = "api_key: 'Zx81+/abcd'"
    text = "é before " + wrap(inner) + " after"
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [tuple(s.split(":")) for s in row["spans"].split(",")]
    hit = [(int(a), int(b)) for k, a, b in spans if k == "assign"]
    assert hit and all(0 <= a < b <= len(text) for a, b in hit)
    assert any(a >= 9 and b <= len(text) - 6 for a, b in hit)
    clean = secrets.redact(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")).first()
    assert "[REDACTED]" in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert not secrets.deep_matches(clean["text"].encode())


def b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("wrap", [
    lambda s: b64(gzip.compress(gzip.compress(s))), lambda s: b64(bz2.compress(gzip.compress(s))), lambda s: b64(lzma.compress(zlib.compress(s))),
    lambda s: quote(gzip.compress(s)), lambda s: "".join(f"\\x{c:02x}" for c in zlib.compress(s)),
    lambda s: b64(gzip.compress(b"one") + gzip.compress(s)), lambda s: b64(bz2.compress(s[:12]) + bz2.compress(s[12:])), lambda s: b64(lzma.compress(b"one") + lzma.compress(s)),
    lambda s: base64.encodebytes(gzip.compress(s * 9)).decode(), lambda s: base64.encodebytes(s * 9).decode().replace("\n", "\r\n  "),
    lambda s: "word" + b64(s), lambda s: "x" + b64(s) + "Y", lambda s: "abcdefghijklmnopqrstu" + b64(s), lambda s: "ab" + b64(zlib.compress(s)),
    lambda s: b64(s.decode().encode("utf-16")), lambda s: b64(s.decode().encode("utf-32-be")), lambda s: b64(b"\x01\xff" + s), lambda s: b64(gzip.compress(s * 30)[:-12]),
])
def test_secrets_in_compressed_and_unclean_layers(wrap):
    text = ("é before " + wrap(b"api_key: 'Zx81+/abcd' and more ") + " after").encode()
    assert any(kind == "assign" and 9 < a < b <= len(text) - 6 for kind, a, b in secrets.deep_matches(text))


@pytest.mark.parametrize("size", [1 << 20, 4 << 20])
def test_secrets_in_plain_base64_take_linear_time(size):
    """Random bytes in base64, as an embedded image is, with a secret behind them; and letters without a line break."""
    text = b"see " + base64.b64encode(random.Random(4).randbytes(size)) + b" password=hunter22 end"
    began = time.perf_counter()
    assert any(kind == "assign" and b == len(text) - 4 for kind, a, b in secrets.deep_matches(text))
    assert time.perf_counter() - began < 8 * size / (1 << 20)
    began = time.perf_counter()
    secrets.deep_matches(b"A" * size)
    assert time.perf_counter() - began < 8 * size / (1 << 20)


def test_secrets_of_every_wrap_pass_the_filter_of_rows(spark):
    """What the row filter passes over holds nothing: spans of a table are those of ``deep_matches`` on each text."""
    s = b"api_key: 'Zx81+/abcd' AKIA" + b"Q" * 16
    wraps = [bytes, lambda s: quote(s, safe="").encode(), base64.b64encode, lambda s: base64.encodebytes(s * 3), lambda s: base64.b64encode(gzip.compress(s)), lambda s: s.decode().encode("utf-16-le"), lambda s: s.decode().encode("utf-16-be"), lambda s: s.decode().encode("utf-32-be"), lambda s: base64.b64encode(s.decode().encode("utf-16")), lambda s: b"".join(b"\\u%04x" % c for c in s), lambda s: b"".join(b"&#%d;" % c for c in s), lambda s: "".join(f"\\x{c:02x}" for c in zlib.compress(s)).encode(), lambda s: b"plain words only"]
    rows = [(i * 20 + j, "é " + outer(inner(s)).decode() + " end") for i, outer in enumerate(wraps) for j, inner in enumerate(wraps)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for i, t in rows:
        raw = t.encode()
        place = lambda at: len(raw[:at].decode())  # noqa: E731, B023
        want = ",".join(f"{k}:{place(a)}:{place(b)}" for k, a, b in secrets.deep_matches(raw))
        assert got[i] == want
        found += bool(want)
    assert found > 130


@pytest.mark.parametrize(("make", "head"), [(gzip.compress, 65 << 20), (lambda s: gzip.compress(b64(bz2.compress(s)).encode()), 3 << 20), (gzip.compress, (1 << 20) - 9)])
def test_secrets_in_large_layers(make, head):
    """A secret behind 65 MB of a layer, and across the border of two pieces."""
    text = b"see " + b64(make(b"log line ok\n" * (head // 12) + b"." * (head % 12) + b" api_key: 'Zx81+/abcd' ")).encode() + b" end"
    assert any(kind == "assign" and 3 < a < b <= len(text) - 4 for kind, a, b in secrets.deep_matches(text))


def test_suffix_dedup(docs, texts):
    plain = dict(zip([i for i, _ in texts], brute.repeated_bytes([t for _, t in texts]), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_bytes(docs.select("doc_id", "text")).collect()}
    assert got == plain


def test_suffix_dedup_frequent_grams_and_shards(spark):
    """A passage that most texts hold, self-overlapping periods, and many small shards."""
    rng = random.Random(8)
    passage = text_of(rng, 90)
    rows = [(i, text_of(rng, 10) + passage[: 250 + i % 190] + text_of(rng, 10)) for i in range(60)] + [(90 + i, "ab" * (98 + i)) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_bytes(table, frequent=5, shard_bytes=4000).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.repeated_bytes([t for _, t in rows]), strict=True))


def test_language_model(docs, texts):
    plain = brute.base_scores(texts)
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(docs.select("doc_id", "text")).collect()}
    assert got.keys() == plain.keys()
    for i, (held, n, known, train, base) in plain.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_language_model_learns_order(spark):
    """Held-out texts that follow the training texts' word order score above the unigram base."""
    rng = random.Random(3)
    follow = {w: [rng.randrange(200) for _ in range(3)] for w in range(200)}

    def walk():
        w, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    got = pitman_yor.score_texts(spark.createDataFrame([(i, walk()) for i in range(150)], "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_language_model_counts_frequent_pairs_in_blocks(spark):
    """A pair that fills the corpus reaches its shard once a block; scores are those of brute force all the same."""
    rows = [(i, "same word " * 500 + f"w{i}") for i in range(40)]
    base = spark.createDataFrame([(i, i, i % 2 == 0, t) for i, t in rows], "row long, doc_id long, train boolean, text string").coalesce(1)
    blocks = pitman_yor._blocks(base, 1).toArrow()
    kinds = lambda t, *some: t.filter(pa.array(np.isin(t["kind"].to_numpy(), some)))
    numbers = pitman_yor._numbered(kinds(blocks, pitman_yor.WORDS), 1)
    both = pa.concat_tables([kinds(blocks, pitman_yor.BLOCK), kinds(numbers, pitman_yor.IDS).cast(blocks.schema)])
    asked = pitman_yor._parts(pitman_yor._paired(both, 3, 100, 10), pitman_yor.PAIRS)
    assert sum(len(p[1]) for _, p in asked) == 2 + 2 * 40 + 1  # same word, word same; word wI, wI END; END same
    plain = brute.base_scores(rows)
    got = pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=20_000).collect()
    assert len(got) == 40 and all((r["n_tokens"], r["n_known"]) == plain[r["doc_id"]][1:3] and r["base_score"] == pytest.approx(plain[r["doc_id"]][4]) for r in got)


@pytest.mark.parametrize("discount", [0.3, 0.7, 0.9])
def test_language_model_draws_tables(discount):
    """Draws from a dish's conditional against customers moved one by one, alone and beside other tables, and both ways to its weights."""
    rng = np.random.default_rng(3)
    draw = lambda n, c, others, chance, exact=1024: pitman_yor.draw_tables(np.full(n, c), np.full(n, others), np.full(n, chance), discount, rng, exact)
    many = 10**12  # other tables, beside which the dish's own don't count: a fixed weight of a new table
    of = lambda fresh: fresh / (pitman_yor.STRENGTH + discount * many)
    for c, fresh in ((6, 0.5), (40, 3.0)):
        assert draw(20_000, c, many, of(fresh)).mean() == pytest.approx(brute.mean_tables(c, fresh, discount), rel=0.03)
    for c, others, chance in ((6, 0, 0.5), (40, 0, 0.6), (40, 7, 0.2)):
        grown = brute.mean_tables(c, lambda t: (pitman_yor.STRENGTH + discount * (others + t)) * chance, discount)
        assert draw(20_000, c, others, chance).mean() == pytest.approx(grown, rel=0.04)
    for fresh in (0.05, 1.0, 100.0, 2000.0):
        whole, far = (draw(1000, 1024, many, of(fresh), exact) for exact in (1024, 100))
        assert far.mean() == pytest.approx(whole.mean(), rel=0.05) and 1 <= far.min() and far.max() <= 1024
    for c in (200, 1024):
        t = np.arange(1, c + 1)
        want = pitman_yor._log_stirling(discount, 1024)[c] + np.array([math.lgamma(x + 1) for x in t]) - math.lgamma(c + 1)
        assert np.abs(pitman_yor._log_share(float(c), t.astype(float), discount) - want).max() < 1e-4


def test_language_model_against_plain_gibbs(spark):
    """Scores beside those of a sampler that seats single customers; any long is an id, and none."""
    rng = random.Random(12)
    follow = {w: [rng.randrange(60) for _ in range(4)] for w in range(60)}

    def walk():
        w, out = rng.randrange(60), []
        for _ in range(25):
            out.append(f"w{w}")
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.randrange(80) % 60
        return " ".join(out)

    rows = [(i, walk()) for i in range(80)] + [(-(1 << 63), "w1 w2"), (200, ""), (201, None)]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"), chains=8, burn_in=3).collect()}
    pairs = Counter(p for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [[None, *brute.words(t), None]] for p in zip(w, w[1:]))
    rate = lambda c: pitman_yor._rate(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    plain = brute.gibbs_scores(rows, rate(pairs), rate(Counter(w for p, n in pairs.items() for w in [p[1]] * n)))
    assert got.keys() == {*plain, None}
    for held in (True, False):
        own = [i for i in plain if (zlib.crc32(str(i).encode()) % 5 == 1) == held]
        assert sum(got[i] for i in own) == pytest.approx(sum(plain[i] for i in own), rel=0.03)


def test_token_counts(spark, docs, texts):
    encode = tokens._encoder(tokens.TOKENIZER)
    path = new_path(spark, "cache")
    for _ in range(2):  # the second run finds all in the cache
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs, path).collect()}
        assert got == {i: (len((t or "").encode()), n := encode([t or ""])[0], n > 4096) for i, t in texts}
    assert spark.read.parquet(path).count() == len({t or "" for _, t in texts})


def test_nearest_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)] + [(600 + i, [1.0] * 8) for i in range(30)]
    rows += [(700, None), (701, []), (800, [0.0] * 8), (900, [1.0, float("nan")] * 4), (None, [1.0] * 8)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=200).collect())
    plain = brute.nearest(rows)
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in plain]
    hits = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in plain}
    assert len(hits) >= 0.9 * len(plain)
    exact = {(q, i): d for q, _, i, d in plain}
    assert all(d == pytest.approx(exact[q, i]) for q, _, i, d in got if (q, i) in exact)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    same = [(100, [1.0, 2.0]), (100, [5.0, 5.0]), (100, [5.0, 5.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (9, [2.0, 2.0, 2.0]), (200, [1.0, 1.0, 1.0])]
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(spark.createDataFrame(same, "vec_id long, embedding array<double>"), k=4).collect())
    want = []
    for q, (i, v) in enumerate(same):
        if i % 100 == 0:
            near = sorted((math.dist(v, w), j) for r, (j, w) in enumerate(same) if r != q and len(w) == len(v))
            want += [(i, n + 1, j, round(d, 6)) for n, (d, j) in enumerate(near[:4])]
    assert found == sorted(want)  # one query's rows for each row, lengths kept apart


def test_nearest_neighbours_over_full_shards(spark):
    """Recall over three shards and over one of the size in production; repeated rows count once."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (60, 24))
    vectors = (centres[rng.integers(0, 60, 10_000)] + 0.4 * rng.normal(0, 1, (10_000, 24))).astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    plain = set()
    for q in range(0, 10_000, 100):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        plain |= {(q, int(i)) for i in np.lexsort((np.arange(10_000), far))[:10]}
    for rows in (4096, neighbours.SHARD_ROWS):
        got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(table, shard_rows=rows).collect()}
        assert len(got) == 1000 and len(got & plain) >= 0.9 * len(plain), len(got & plain)
        print("recall", rows, len(got & plain) / len(plain))


def test_graph_by_insertion():
    """Layers are prefixes of the order, links stay within their layer, a node is never its own neighbour, recall against brute force."""
    vectors = np.random.default_rng(2).normal(size=(3000, 16))
    order, sizes, tables = neighbours.build_graph(vectors)
    assert sorted(order.tolist()) == list(range(3000)) and sizes == sorted(sizes, reverse=True) and sizes[0] == 3000
    for size, table in zip(sizes, tables, strict=True):
        assert table.shape[0] == size and table.max() < size
        assert not (table == np.arange(size)[:, None]).any()
        assert all(len(set(x)) == len(x) for x in ([n for n in row if n >= 0] for row in table.tolist()))
    queries = np.random.default_rng(3).normal(size=(100, 16))
    dist, node = neighbours.search_graph(queries, vectors[order], tables)
    exact = ((queries[:, None, :] - vectors[None]) ** 2).sum(axis=2)
    best = np.argsort(exact, axis=1)[:, :10]
    assert (np.diff(dist[:, :10], axis=1) >= 0).all()
    assert np.mean([len(set(a) & set(b)) for a, b in zip(order[node[:, :10]].tolist(), best.tolist(), strict=True)]) >= 9.5
    for n in (1, 2):
        order, _, tables = neighbours.build_graph(vectors[:n])
        assert sorted(order[neighbours.search_graph(queries[:1], vectors[order], tables)[1]][0].tolist()) == list(range(n))


def plain_units(rows, unit, least):
    """(doc_id, n_units, n_removed, removed_spans, kept_text) of rows in rank order, one unit at a time."""
    ends = {"line": r"\n", "sentence": r"[.!?][ \t-\r]+|\n", "paragraph": r"\n{2,}"}[unit]
    seen, out = set(), []
    for i, text in rows:
        text, at, units = text or "", 0, []
        for m in [*re.finditer(ends, text), None]:
            stop = m.end() if m else len(text)
            if stop > at:
                units.append((at, stop, " ".join(brute.words(text[at:stop]))))
            at = stop
        spans, run, n = [], [], 0
        for a, b, norm in [*units, (len(text), len(text), None)]:
            if norm == "":
                continue
            if norm in seen:
                run.append((a, b, norm))
                continue
            seen.add(norm)
            if run and sum(len(x[2].split(" ")) for x in run) >= least:
                spans.append((run[0][0], run[-1][1]))
                n += len(run)
            run = []
        kept, last = "", 0
        for a, b in spans:
            kept, last = kept + text[last:a], b
        out.append((i, len(units), n, ",".join(f"{a}:{b}" for a, b in spans), kept + text[last:]))
        seen.discard(None)
    return out


@pytest.mark.parametrize(("unit", "least"), [("sentence", 25), ("sentence", 0), ("line", 0), ("line", 8), ("paragraph", 0)])
def test_line_dedup(spark, unit, least):
    """Passages inside lines, blank units within runs, copies, a very long text, empty and null ones."""
    rng = random.Random(7)
    say = lambda n: " ".join(text_of(rng, rng.randrange(2, 9)).capitalize() + rng.choice([".", "!", "?\n", ".\n\n", " "]) for _ in range(n))
    passage = say(12)
    texts = [say(6) for _ in range(12)] + [say(3) + passage + say(2) for _ in range(6)] + [passage, passage, None, "", "\n\n \n", "one", "One ", say(400), "é " + passage + "ü"]
    rows = list(enumerate(texts))
    got = lines.repeated_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), unit, least_words=least).collect()
    assert sorted(map(tuple, got)) == plain_units(rows, unit, least)


def test_line_dedup_edges(spark, empty):
    assert lines.repeated_units(empty).count() == 0
    rows = spark.createDataFrame([(2, "A  b\nx\n\n"), (1, "a b\ny"), (3, None), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["removed_spans"], r["kept_text"]) for r in lines.repeated_units(rows, "line", least_words=0).collect()}
    assert got == {1: (2, 0, "", "a b\ny"), 2: (3, 1, "0:5", "x\n\n"), 3: (0, 0, "", ""), None: (1, 1, "0:1", "")}


def test_line_dedup_null_equal_ids_and_clashing_columns(spark):
    """Rows that share an id lose only what repeats; repeated rows lose all but the first; columns of any name are kept apart."""
    rows = spark.createDataFrame([(None, "x\ny", 0, "a"), (None, "p\nq", 1, "b"), (1, "x", 2, "c"), (7, "s\nt", 3, "d"), (7, "s\nu\nx", 4, "e"), (7, "s\nu\nx", 5, None)], "doc_id long, text string, gone int, n_units string").coalesce(1)
    rows = rows.withColumns({"whole": F.lit(1), "spans": F.lit(2), "_unit_row": F.lit(3)})
    got = lines.repeated_units(rows, "line", payload=True, least_words=0)
    assert got.columns == ["doc_id", "gone", "whole", "spans", "n_units", "n_removed", "removed_spans", "kept_text"]
    got = {r["gone"]: (r["doc_id"], r["n_units"], r["n_removed"], r["removed_spans"], r["kept_text"]) for r in got.collect()}
    assert got == {0: (None, 2, 1, "0:2", "y"), 1: (None, 2, 0, "", "p\nq"), 2: (1, 1, 0, "", "x"), 3: (7, 2, 0, "", "s\nt"), 4: (7, 3, 2, "0:2,4:5", "u\n"), 5: (7, 3, 3, "0:5", "")}
    same = spark.createDataFrame([(5, "first\nsame line\nx"), (5, "alpha\nbeta precious\ngamma"), (1, "same line\nkeep a")], "doc_id long, text string").coalesce(1)
    assert sorted(r["kept_text"] for r in lines.repeated_units(same, "line", least_words=0).collect()) == ["alpha\nbeta precious\ngamma", "first\nx", "same line\nkeep a"]


def test_mix_keeps_targets(docs, texts):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(texts)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    longest = max(r["size"] for r in got)
    assert all(abs(taken - target) <= 2 * longest for target, taken in by.values())
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("broadcast_rows", [contamination.BROADCAST_ROWS, 0])
def test_decontamination(monkeypatch, spark, docs, texts, broadcast_rows):
    """Items of all size classes, in texts too short for some of them, by a broadcast and by a thinned shuffle."""
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", broadcast_rows)
    items = [(1, texts[10][1]), (2, " ".join((texts[12][1] or "").split()[:6])), (3, None), (None, "x y z"), (4, "no such words at all here"), (5, "one")]
    items += [(10 + k, " ".join((texts[k][1] or "").split()[: 3 + 2 * k])) for k in range(0, 60, 3)]
    table = spark.createDataFrame(items, "item_id long, text string")
    plain = set()
    for i, t in texts:
        for j, item in items:
            own = brute.shingles(item)
            if j is not None and own and len(own & brute.shingles(t)) * 100 >= len(own) * 75:
                plain.add((i, j))
    odd = docs.withColumns({"item_id": F.lit(1), "key": F.lit("k"), "n_doc": F.lit(2)})
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(odd, table).collect()}
    assert got == plain
    left = contamination.decontaminate(odd, table)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in texts} - {i for i, _ in plain}


def test_shared_folder_is_asked_for(spark):
    """A cluster without spark.checkpoint.dir is refused; one process may use a folder of its own."""

    class Cluster:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Cluster

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_without(spark):
    rows = spark.createDataFrame([(i % 90 if i % 7 else None, i) for i in range(300)], "k long, other int")
    gone = spark.createDataFrame([(i,) for i in range(0, 90, 2)], "g long")
    got = {r["other"] for r in common.without(rows, "k", gone).collect()}
    assert got == {i for i in range(300) if not i % 7 or (i % 90) % 2}


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, 40, 150) if i % 2 else " ".join(f"junk{rng.randrange(40)}" for _ in range(40)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (999, 0), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, *quality.learn(docs, labels)).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(got) == 402 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


@pytest.mark.parametrize("run", [lambda t: minhash.near_duplicates(t), lambda t: secrets.scan_secrets(t), lambda t: secrets.redact(t), lambda t: suffixes.repeated_bytes(t), lambda t: pitman_yor.score_texts(t), lambda t: mixing.mix_sources(t), lambda t: tokens.count_tokens(t, new_path(t.sparkSession, "cache"))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("wide", [0, suffixes.WIDE])
def test_suffix_array(monkeypatch, wide):
    """Both ways to induce against sorted suffixes, on random and periodic strings."""
    import numpy as np

    monkeypatch.setattr(suffixes, "WIDE", wide)
    rng = np.random.default_rng(1)
    for k in range(80):
        alphabet = int(rng.integers(1, 6))
        text = rng.integers(0, alphabet, int(rng.integers(1, 300)))
        text = np.tile(text[: max(1, len(text) // 7)], 8) if k % 3 == 0 else text
        assert suffixes.suffix_array(text, alphabet).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert len(suffixes.suffix_array(np.zeros(0, np.int64), 4)) == 0


def test_language_model_drops_pairs_once_merged(spark, docs):
    """The pairs that blocks sent to shards aren't kept on disk beside the shards; the texts are."""
    import os

    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    scored = pitman_yor.score_texts(docs.select("doc_id", "text"))
    left = sorted(f.split("-")[0] for f in set(os.listdir(shared)) - before)
    assert left == ["scores", "texts"] and scored.count() == docs.count()
