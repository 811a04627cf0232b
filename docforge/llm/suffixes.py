"""Suffix arrays by induced sorting, and dedup of long repeated byte strings with them."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import documents, forget, release, written
from .kernel import U

LENGTH = 200
#: Bytes of the grams of which each window's least-digest one decides its shard; bytes of a shard's text.
GRAM, SHARD_BYTES = 100, 1 << 20
#: A gram that occurs more often has its windows dealt one by one, by their own digests.
FREQUENT = 20_000
#: A text is looked at in pieces of so many window starts.
PIECE = 1 << 22
#: Alphabets up to this size are induced bucket by bucket in whole arrays.
WIDE = 400
SEPARATOR = 255  # occurs in no UTF-8 text


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (S type); the last one is L, as the empty suffix is least."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    rises = np.append(text[change] < text[change + 1], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends])))


def _induce_wide(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array that follows from the order of ``seeds`` (positions of leftmost S suffixes), for a small alphabet.

    A bucket's entries are taken in waves: those there, then those they add to the bucket itself, so that
    every step is a whole-array operation in the order of a scan.
    """
    n = len(text)
    count = np.bincount(text, minlength=alphabet)
    end = np.cumsum(count)
    start = end - count
    out = np.full(n, -1, np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    seed_chars = text[seeds]
    group = np.argsort(seed_chars, kind="stable")
    cuts = np.searchsorted(seed_chars[group], np.arange(alphabet + 1))
    seeded = [seeds[group[cuts[c] : cuts[c + 1]]] for c in range(alphabet)]

    def spread(prev: np.ndarray, to: list[list[np.ndarray]]) -> None:
        chars = text[prev]
        order = np.argsort(chars, kind="stable")
        prev, chars = prev[order], chars[order]
        at = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(prev)], strict=True):
            to[chars[a]].append(prev[a:b])

    parts[text[n - 1]].append(np.array([n - 1]))  # induced by the empty suffix
    larger: list[np.ndarray] = []
    for c in range(alphabet):
        if not count[c]:
            larger.append(np.zeros(0, np.int64))
            continue
        wave = np.concatenate(parts[c]) if parts[c] else np.zeros(0, np.int64)
        done = []
        while len(wave):
            done.append(wave)
            prev = wave[wave > 0] - 1
            prev = prev[~small[prev]]
            same = text[prev] == c
            if len(prev) and not same.all():
                spread(prev[~same], parts)
            wave = prev[same]
        own = np.concatenate(done) if done else np.zeros(0, np.int64)
        out[start[c] : start[c] + len(own)] = own
        larger.append(own)
        prev = seeded[c]
        prev = prev[prev > 0] - 1
        prev = prev[~small[prev]]
        if len(prev):
            spread(prev, parts)
    parts = [[] for _ in range(alphabet)]
    for c in range(alphabet - 1, -1, -1):
        if not count[c]:
            continue
        wave = np.concatenate(parts[c]) if parts[c] else np.zeros(0, np.int64)
        done = []
        while len(wave):  # from the bucket's end
            done.append(wave)
            prev = wave[wave > 0] - 1
            prev = prev[small[prev]]
            same = text[prev] == c
            if len(prev) and not same.all():
                spread(prev[~same], parts)
            wave = prev[same]
        own = np.concatenate(done) if done else np.zeros(0, np.int64)
        out[end[c] - len(own) : end[c]] = own[::-1]
        prev = larger[c][::-1]
        prev = prev[prev > 0] - 1
        prev = prev[small[prev]]
        if len(prev):
            spread(prev, parts)
    return out


def _ranked(at: np.ndarray, slot: np.ndarray, ahead: np.ndarray) -> None:
    """Order the suffixes ``at`` by their own slot, then by those ahead, twice as far with every pass.

    ``slot`` holds the first slot of the ties each suffix is in, and gets its final one; ``ahead`` points along its run of
    one type, at whose end a suffix of known slot points to itself. A pass sorts only what is still tied.
    """
    n = len(slot)
    while len(at):
        key = slot[at] * (n + 1) + slot[ahead[at]] + 1
        order = np.argsort(key)
        at, key = at[order], key[order]
        was, place = slot[at], np.arange(len(at))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(np.concatenate([[True], was[1:] != was[:-1]]), place, 0))
        further = ahead[ahead[at]]
        slot[at] = was + np.maximum.accumulate(np.where(fresh, place, 0)) - head
        ahead[at] = further
        at = at[~(fresh & np.append(fresh[1:], True))]


def _induce_long(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """The same for a large alphabet, in whole arrays: L suffixes follow from the seeds that end their runs, S suffixes from
    the L suffixes that end theirs. In a bucket L suffixes come before S suffixes."""
    n = len(text)
    start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))[:-1]])
    larger, smaller = np.flatnonzero(~small), np.flatnonzero(small)
    inside = start + np.bincount(text[larger], minlength=alphabet)  # where a bucket's S suffixes begin
    slot = np.full(n + 1, -1, np.int64)  # the empty suffix at n comes before all
    slot[larger] = start[text[larger]]
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    chars = text[seeds]
    slot[seeds] = inside[chars] + np.arange(len(seeds)) - np.searchsorted(chars, chars)
    for own, ends in ((larger, np.append(seeds, n)), (smaller, larger)):
        ahead = np.arange(1, n + 2)
        ahead[ends] = ends
        if own is smaller:
            slot[smaller] = inside[text[smaller]]
        _ranked(own, slot, ahead)
    out = np.empty(n, np.int64)
    out[slot[:n]] = np.arange(n)
    return out


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of all suffixes in order, by induced sorting.

    Suffixes are classified; the substrings between leftmost S positions are sorted by one induction and
    named; where names repeat, the string of names is sorted recursively; the order of the leftmost S
    suffixes induces the whole array.
    """
    text = np.ascontiguousarray(text)
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = _types(text)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_wide if alphabet <= WIDE else _induce_long
    if len(marks):
        first = induce(text, small, marks, alphabet)
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        order = first[is_mark[first]]
        stop = np.append(marks[1:] + 1, n)  # one past each substring's last symbol
        code = kernel.mix(np.arange(1, alphabet + 1, dtype=np.uint64))
        key = kernel.mix(_range_hash(text, code, marks, stop) + (stop - marks).astype(np.uint64))
        key[-1] ^= U(0x5BD1E995)  # ends with the text and equals none
        place = np.searchsorted(marks, order)
        fresh = np.concatenate([[True], key[place[1:]] != key[place[:-1]]])
        names = np.empty(len(marks), np.int64)
        names[place] = np.cumsum(fresh) - 1
        kinds = int(fresh.sum())
        seeds = marks[np.argsort(names) if kinds == len(marks) else suffix_array(names, kinds)]
    else:
        seeds = marks
    return induce(text, small, seeds, alphabet)


def _range_hash(text: np.ndarray, code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = len(text)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code[text] * kernel._power(kernel._PRIME, n), out=total[1:])
    return (total[stop] - total[start]) * kernel._power(kernel._PRIME_INV, n + 1)[start]


def long_repeats(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True at i where the permuted common prefix with a neighbour in suffix order reaches ``length``.

    Prefixes are compared eight bytes at a time for all positions together; a position leaves once it differs.
    """
    n = len(text)
    order = suffix_array(text, 256)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[: n + length], (n + length, 8), (1, 1)).copy().view(np.uint64)[:, 0] if n < 1 << 16 else _eights(padded, n + length)
    here = np.flatnonzero((before >= 0) & (np.arange(n) + length <= n) & (before + length <= n))
    there = before[here]
    steps = [*range(0, length - 7, 8)]
    if length % 8:
        steps.append(length - 8)
    for k in steps:
        same = words[here + k] == words[there + k]
        here, there = here[same], there[same]
    out = np.zeros(n, bool)
    out[here] = True
    out[there] = True
    return out


def _eights(padded: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at every position as one number."""
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k : k + n].astype(np.uint64) << U(8 * k)
    return out


def window_grams(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows whose least-digest gram is the same one: (text, first start, windows, gram digest).

    The gram of a window depends on the window's bytes alone, so equal windows have equal grams.
    """
    n, width = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(n - gram + 1)
    code = kernel._CODE.copy()
    code[65:91] = kernel.mix(np.arange(65, 91, dtype=np.uint64))
    digest = kernel.mix((lambda t: (t[gram:] - t[:-gram]) * kernel._power(kernel._PRIME_INV, n - gram + 1))(np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[data] * kernel._power(kernel._PRIME, n), dtype=np.uint64)])))
    low = U((1 << 24) - 1)
    key = (digest & ~low) | at.astype(np.uint64)
    m = len(key)
    pad = -m % width
    blocks = np.concatenate([key, np.full(pad, U(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - width + 1
    least = np.minimum(left[:count], right[width - 1 : width - 1 + count])
    spot = (least & low).astype(np.int64)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    valid = np.arange(count) + length <= offsets[1:][own]
    edge = np.concatenate([[True], (spot[1:] != spot[:-1]) | (own[1:] != own[:-1]) | (valid[1:] != valid[:-1])])
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, count))
    keep = valid[starts]
    starts, sizes = starts[keep], sizes[keep]
    return own[starts], starts - offsets[own[starts]], sizes, digest[spot[starts]]


def _pieces(texts: pa.Array):
    """(row, start in the text, bytes, offsets) of slices, long texts cut with an overlap of LENGTH - 1."""
    for row, data, offsets in kernel.slices(texts):
        if len(offsets) == 2 and len(data) > PIECE + LENGTH:
            for a in range(0, len(data) - LENGTH + 1, PIECE):
                part = data[a : a + PIECE + LENGTH - 1]
                yield row, a, part, np.array([0, len(part)])
        else:
            yield row, 0, data, offsets


def shard_repeats(texts: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct text of a shard its covered ranges (start, end) as rows; a text that occurs twice is covered whole."""
    if not texts:
        return []
    parts, at, begins = [], 0, []
    for t in texts:
        begins.append(at)
        parts += [np.frombuffer(t, np.uint8), np.array([SEPARATOR], np.uint8)]
        at += len(t) + 1
    joined = np.concatenate(parts)
    marks = long_repeats(joined, length)
    out = []
    for t, c, b in zip(texts, counts, begins, strict=True):
        n = len(t) - length + 1
        hit = np.ones(n, bool) if c > 1 else marks[b : b + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        out.append(np.stack([edge[::2], edge[1::2] - 1 + length], axis=1))
    return out


def _packed(batches):
    """Arrow batches (row, id, text) with compressed texts, which are written once and shuffled twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(x or b"") for x in batch.column(2).to_pylist()], pa.binary())], batch.schema.names)


def _unpacked(column: pa.Array) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(x) for x in column.to_pylist()]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", payload: bool = False, frequent: int = FREQUENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove each byte covered by a 200-byte string that also starts anywhere else.

    1. Every 200-byte window is represented by its least-digest 100-byte gram; grams that occur once are
       dropped, since their windows can't repeat. Only digests and places are shuffled.
    2. The stretches of windows around the other grams, each distinct one once with its count, are dealt to shards
       by gram. A gram that occurs more than ``frequent`` times has its windows dealt singly by their own digests, so
       no gram fills a shard however many texts hold it.
    3. A stretch that occurs twice, byte by byte, is repeated whole. Where the stretches of a gram differ, their shard sorts
       them by induced sorting and finds the windows whose permuted common prefix reaches 200; a gram with one
       distinct stretch has no other text to meet. Ranges go back to all places of a stretch.

    A null text is empty. Strings are judged on the input, repeated rows count as elsewhere, matches never
    cross rows. Rows are numbered once and written, so they are told apart however the input is read. Null and equal ids are kept. Result: the id, n_bytes, n_removed, n_spans, kept_sha256; with
    ``payload`` also kept (bytes).
    """
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    base = written(base.mapInArrow(_packed, base.schema), "rows")  # numbered once: a later scan of the input may split it otherwise

    def grams(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for row, begin, data, offsets in _pieces(pa.array(_unpacked(batch.column(1)), pa.large_binary())):
                own, start, size, digest = window_grams(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(rows[row + own]), pa.array(start + begin), pa.array(size.astype(np.int32)), pa.array(digest.view(np.int64))], ["row", "start", "size", "gram"])

    places = written(base.select("row", "body").mapInArrow(grams, "row long, start long, size int, gram long"), "grams")
    # written, so that the join reads two plain tables and adaptive execution can split a gram that many places share
    again = written(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    runs = places.join(again, "gram").groupBy("row").agg(F.collect_list(F.struct("start", "size", "gram", (F.col("n") > frequent).alias("often"))).alias("runs"))
    runs = written(runs, "runs")
    forget(spark, places)
    forget(spark, again)
    release(spark)

    def stretches(batches):
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in held.values()], pa.int64()), pa.array(list(held), pa.binary()), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.array([v[1] for v in held.values()], pa.binary()), pa.array([v[2] for v in held.values()], pa.int64())], names)

        names = ["gram", "digest", "row", "start", "body", "n"]
        for batch in batches:
            for r in range(batch.num_rows):
                row, body = batch.column(0)[r].as_py(), _unpacked(batch.column(1).slice(r, 1))[0]
                digests, starts = [], []
                for run in batch.column(2)[r].as_py():
                    cuts = [(run["start"], run["size"])] if not run["often"] else [(run["start"] + i, 1) for i in range(run["size"])]
                    for start, windows in cuts:
                        own = body[start : start + windows - 1 + LENGTH]
                        digest = hashlib.blake2b(own, digest_size=16).digest()
                        digests.append(digest)
                        starts.append(start)
                        if digest in held:
                            held[digest][2] += 1
                        else:
                            held[digest] = [int.from_bytes(digest[:8], "little", signed=True) if run["often"] else run["gram"], own, 1]
                            size += len(own)
                m = len(digests)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(digests, pa.binary()), pa.array([row] * m, pa.int64()), pa.array(starts, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names)
                if size > 32 << 20:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    cut = base.select("row", "body").join(runs, "row").select("row", "body", "runs").mapInArrow(stretches, "gram long, digest binary, row long, start long, body binary, n long")
    cut = written(cut, "stretches")
    forget(spark, runs)
    release(spark)
    bodies = cut.where("body is not null").select("gram", "digest", "body", "n")
    total = bodies.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-total // shard_bytes))

    def solve(table: pa.Table) -> pa.Table:
        own: dict[bytes, list] = {}
        for gram, digest, body, n in zip(*(table[c].to_pylist() for c in ("gram", "digest", "body", "n")), strict=True):
            own.setdefault(digest, [gram, body, 0])[2] += n
        kinds = Counter(v[0] for v in own.values())
        mixed = {d: v for d, v in own.items() if kinds[v[0]] > 1}
        found = dict(zip(mixed, shard_repeats([v[1] for v in mixed.values()], [v[2] for v in mixed.values()]), strict=True))
        found |= {d: np.array([[0, len(v[1])]]) for d, v in own.items() if kinds[v[0]] == 1 and v[2] > 1}
        some = [(d, x) for d, x in found.items() if len(x)]
        return pa.table({"digest": pa.array([d for d, _ in some], pa.binary()), "ranges": pa.array([x.tolist() for _, x in some], pa.list_(pa.list_(pa.int64())))})

    solved = bodies.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard").applyInArrow(solve, "digest binary, ranges array<array<long>>")
    solved = written(solved, "repeats")
    release(spark)
    spans = cut.where("body is null").select("digest", "row", "start").join(solved, "digest").select("row", F.transform("ranges", lambda x: F.struct((x[0] + F.col("start")).alias("a"), (x[1] + F.col("start")).alias("b"))).alias("spans"))
    spans = written(spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    forget(spark, cut)
    release(spark)

    def finish(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for body, own in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, last, removed, count = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in own or ()):
                    if a > end:
                        count += 1
                        kept.append(body[max(last, 0) : a])
                        removed += b - a
                        last = end = b
                    elif b > end:
                        removed += b - end
                        last = end = b
                kept.append(body[last:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(body), removed, count, hashlib.sha256(rest).hexdigest(), rest if payload else None), strict=True):
                    column.append(value)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(out[4], pa.binary())] if payload else []), [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * payload)

    shape = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * payload
    return base.join(spans, "row", "left").select("id", "body", "spans").mapInArrow(finish, shape)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without bytes of repeated 200-byte strings."""
    return repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))
