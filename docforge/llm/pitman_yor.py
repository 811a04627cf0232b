"""Language-model scores from a hierarchical Pitman-Yor model seated by Gibbs sampling."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import documents, forget, release, written
from .kernel import U
from .kernel import pack as _pack
from .kernel import unpack as _unpack

#: The token that ends every text and is the context of the next first word.
END = U(0x3C6EF372FE94F82B)
#: Text in a block, and for a shard of word pairs.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 20 << 20
#: Chains of Gibbs sweeps, all started with a table for each dish; sweeps of a chain that are dropped before the one that counts.
CHAINS, BURN_IN = 3, 1
#: Up to so many customers a dish's Stirling numbers come from their recurrence, beyond from an integral of so many points.
EXACT, POINTS = 1024, 64
STRENGTH = 1.0
FOLDS, HELD = 5, 1
#: All stages pass rows of one shape: what a row is, the group that takes it next, its place there, packed arrays, numbers to be summed.
SHAPE = "kind int, key long, part long, body binary, sums array<long>"
BLOCK, WORDS, IDS, COUNTS, PAIRS, STATE, INDEX, ASKED, REPLY, TABLES, SCORES, ROOT = range(12)


def _rows(items: Iterable[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    columns = list(zip(*items, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "key", "part", "body", "sums"])


def _parts(table: pa.Table, kind: int) -> list[tuple[int, list[np.ndarray]]]:
    """The rows of a kind in order of their places, unpacked."""
    own = table.filter(pa.array(table["kind"].to_numpy() == kind)).sort_by("part")
    return [(p, _unpack(b)) for p, b in zip(own["part"].to_pylist(), own["body"].to_pylist(), strict=True)]


@functools.cache
def _log_stirling(discount: float, most: int) -> list[np.ndarray]:
    """For each number of customers up to ``most`` the log weight of seatings at 1, 2, ... tables: generalised Stirling numbers."""
    rows = [np.zeros(0), np.zeros(1)]
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.append(rows[c] + np.log(c - discount * t[:-1]), -np.inf)
        rows.append(np.logaddexp(stay, np.concatenate([[-np.inf], rows[c]])))
    return rows


def _saddle(ratio: np.ndarray, discount: float) -> np.ndarray:
    """log y, where r = 1 - y is the point at which tables that hold ``ratio`` customers on average are drawn with weights r ** size."""
    low, high = np.full(len(ratio), -700.0), np.zeros(len(ratio))
    for _ in range(60):
        y = (low + high) / 2
        over = discount * -np.expm1(y) * np.exp((discount - 1) * y) > ratio * -np.expm1(discount * y)
        low, high = np.where(over, y, low), np.where(over, high, y)
    return low


def _log_share(c: float, t: np.ndarray, discount: float) -> np.ndarray:
    """log(S(c, t) * t! / c!) for many customers ``c``: a coefficient of a power, as an integral around its singular point.

    The numbers S have the generating function ((1 - (1 - z) ** d) / d) ** t / t!. With z = exp(-s) its coefficient is an integral
    over s on a parabola around the negative axis, or over an arc where its vertex, the saddle, lies far out. Both are sums of
    POINTS terms whose error falls exponentially.
    """
    near = np.clip(-np.log1p(-np.exp(_saddle(c / t, discount))), 10 / c, 700.0)
    bent = near < 0.3
    log_g = lambda s: np.log(-np.expm1(discount * np.log1p(-np.exp(-s))) / discount)
    h = 1e-3 * near
    curve = np.abs(t * (log_g(near + h) - 2 * log_g(near) + log_g(near - h))) / h**2
    far = np.where(bent, np.minimum(6.0, 12 / np.sqrt(c * near)), np.minimum(np.pi, 12 / np.sqrt(np.maximum(curve, 1e-9))))
    phi = far[:, None] * np.arange(POINTS + 1) / POINTS
    s = np.where(bent[:, None], near[:, None] * (1 + 1j * phi) ** 2, near[:, None] + 1j * phi)
    power = t[:, None] * log_g(s) + c * s
    top = power[:, 0].real
    terms = (np.exp(power - top[:, None]) * np.where(bent[:, None], 2 * near[:, None] * (1 + 1j * phi), 1)).real
    terms[:, [0, -1]] /= 2
    return np.where(t < c, top + np.log(np.maximum(terms.sum(axis=1) * far / POINTS / np.pi, 1e-300)), 0.0)


def draw_tables(counts: np.ndarray, others: np.ndarray, chance: np.ndarray, discount: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """A Gibbs draw of the number of tables of each dish, given everything outside the dish.

    ``counts``: customers of the dish; ``others``: tables of the other dishes of its restaurant; ``chance``: its probability in
    the parent. The seating of all customers of a dish is one block of the sampler: with the sizes of the tables summed out, t
    tables have weight S(c, t) * chance ** t * the product over i < t of (strength + discount * (others + i)), where S is the
    generalised Stirling number. So a draw has no starting point to forget. Up to ``exact`` customers S comes from its
    recurrence; beyond, from ``_log_share`` for all t within 14 standard deviations and 40 tables of the conditional's saddle
    point. Both give the same distribution.
    """
    out = np.minimum(counts, 1).astype(np.int64)
    mid = np.flatnonzero((counts > 1) & (counts <= exact))
    mid = mid[np.argsort(counts[mid], kind="stable")]
    sizes, first = np.unique(counts[mid], return_index=True)
    rows = _log_stirling(round(discount, 3), exact)
    edges = [*first.tolist(), len(mid)]
    for c, a, b in zip(sizes.tolist(), edges[:-1], edges[1:], strict=True):
        step = max(1, (1 << 20) // c)
        i = np.arange(c)
        for at in range(a, b, step):
            own = mid[at : min(at + step, b)]
            weight = np.cumsum(np.log((STRENGTH + discount * (others[own][:, None] + i)) * chance[own][:, None]), axis=1) + rows[c]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (weight < (rng.random(len(own)) * weight[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(counts > exact)
    c = counts[big].astype(np.float64)
    table = lambda t: (STRENGTH + discount * (others[big] + t)) * chance[big]  # noqa: E731  weight of one more table at t tables
    low, high = np.ones(len(big)), c  # the number of tables at which the saddle point of the weights lies
    for _ in range(40):
        t = (low + high) / 2
        y = np.exp(_saddle(c / t, discount))
        more = table(t) * (1 - y**discount) / discount > t
        low, high = np.where(more, t, low), np.where(more, high, t)
    wide = 40 + 14 * np.sqrt(low * (1 + low * discount * chance[big] / table(low)))
    first, last = np.maximum(1, np.floor(low - wide)).astype(np.int64), np.minimum(c, np.ceil(low + wide)).astype(np.int64)
    for n, k in enumerate(big.tolist()):
        t = np.arange(first[n], last[n] + 1)
        weight = np.cumsum(np.log((STRENGTH + discount * (others[k] + t - 1)) * chance[k] / t))
        weight += np.concatenate([_log_share(c[n], t[i : i + 4096].astype(np.float64), discount) for i in range(0, len(t), 4096)])
        weight = np.cumsum(np.exp(weight - weight.max()))
        out[k] = t[np.searchsorted(weight, rng.random() * weight[-1], side="right")]
    return out


def _rate(ones: int, twos: int) -> float:
    """A discount from how many dishes are met once, and twice."""
    return round(min(0.95, max(0.1, ones / max(ones + 2 * twos, 1))), 3)


def _blocks(docs: DataFrame, homes: int) -> DataFrame:
    """Blocks of texts as numbers of words, and the distinct words of each block, dealt to homes by digest."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            seqs, counts, rows, ids, known, train = (np.concatenate([h[i] for h in held]) for i in range(6))
            block = int(rows[0])
            words, index = np.unique(np.append(seqs, END), return_inverse=True)
            learnt = np.bincount(index[:-1][np.repeat(train, counts)], minlength=len(words))
            home = (words % U(homes)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words))
            cuts = np.searchsorted(home[order], np.arange(homes + 1))
            items = [(BLOCK, block, 0, _pack(number[index], counts.astype(np.uint32), ids, known, train), None)]
            for h in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[h] : cuts[h + 1]]
                items.append((WORDS, h, block, _pack(np.diff(words[own], prepend=U(0)), learnt[own]), None))
            yield from _rows(items).to_batches()

        for batch in batches:
            rows, train = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(1).fill_null(0).to_numpy()
            for row, data, offsets in kernel.slices(batch.column(3)):
                hashes, first = kernel.words(data, offsets)
                own = slice(row, row + len(offsets) - 1)
                held.append((np.insert(hashes, first[1:], END), np.diff(first) + 1, rows[own], ids[own], known[own], train[own]))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, SHAPE)


def _numbered(table: pa.Table, homes: int) -> pa.Table:
    """Numbers of the words of one home, small ones for frequent words, and training counts, for each block that has them."""
    home, parts = table["key"][0].as_py(), _parts(table, WORDS)
    hashes = [np.cumsum(p[0], dtype=np.uint64) for _, p in parts]
    words, index = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.zeros(len(words), np.int64)
    np.add.at(count, index, np.concatenate([p[1] for _, p in parts]))
    rank = np.empty(len(words), np.int64)
    order = np.argsort(-count, kind="stable")
    rank[order] = np.arange(len(words))
    items = [(COUNTS, home, 0, _pack(count[order]), [int((count > 0).sum()), int(count.sum()), int((count == 1).sum()), int((count == 2).sum())])]
    at = 0
    for block, p in parts:
        own = index[at : at + len(p[0])]
        items.append((IDS, block, home, _pack(rank[own] * homes + home, count[own]), None))
        at += len(own)
    return _rows(items)


def _paired(table: pa.Table, shards: int, n_tokens: int, n_known: int) -> pa.Table:
    """A block's texts as numbers of word pairs, with their base scores, and its distinct pairs, dealt to shards."""
    block = table["key"][0].as_py()
    ((_, (index, sizes, ids, known, train)),) = _parts(table, BLOCK)
    said = [p for _, p in _parts(table, IDS)]
    word, count = (np.concatenate([p[k] for p in said]) for k in (0, 1))
    end = index[-1]  # stands behind the last text
    index = index[:-1].astype(np.int64)
    before = np.concatenate([[end], index[:-1]]).astype(np.int64)
    pairs, pair = np.unique(before * len(word) + index, return_inverse=True)
    learnt = np.bincount(pair[np.repeat(train, sizes)], minlength=len(pairs))
    left, right = word[pairs // len(word)], word[pairs % len(word)]
    shard = (kernel.mix(kernel.mix(left.astype(np.uint64)) * U(3) + right.astype(np.uint64)) % U(shards)).astype(np.int64)
    order = np.lexsort((right, left, shard))
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order))
    flat = np.log10((count + 0.5) / (n_tokens + 0.5 * (n_known + 1)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    base, met = (np.bincount(doc, weights=x[index], minlength=len(sizes)) for x in (flat, count > 0))
    items = [(BLOCK, block, 0, _pack(number[pair], sizes, ids, known, train, base, met.astype(np.int64)), None)]
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[s] : cuts[s + 1]]
        items.append((PAIRS, s, block, _pack(np.diff(left[own], prepend=0), right[own], learnt[own]), None))
    return _rows(items)


class _Shard:
    """The distinct word pairs of one shard, and how their words are asked for at the words' homes."""

    def __init__(self, key: int, body: list[np.ndarray], homes: int):
        self.key, self.homes = key, homes
        steps, left, self.right, self.count = body
        self.words, self.left = np.cumsum(steps), np.cumsum(left)
        home = self.words % homes
        self.order = np.argsort(home, kind="stable")
        self.cuts = np.searchsorted(home[self.order], np.arange(homes + 1))

    def ask(self, tables: np.ndarray) -> list[tuple]:
        """Each home gets its words' tables in this shard, as dishes and as contexts, of each chain (rows of ``tables``)."""
        n = len(self.words)
        dish, context = ([np.bincount(at, weights=t, minlength=n).astype(np.int64)[self.order] for t in tables] for at in (self.right, self.left))
        items = []
        for h in np.flatnonzero(np.diff(self.cuts)).tolist():
            own = slice(self.cuts[h], self.cuts[h + 1])
            rank = self.words[self.order[own]] // self.homes
            items.append((ASKED, h, self.key, _pack(np.diff(rank, prepend=0), np.concatenate([x[own] for x in dish]), np.concatenate([x[own] for x in context])), None))
        return items

    def told(self, table: pa.Table, sums: dict, chains: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers of each word as a context; for each chain its root probability, and its tables as a context."""
        parts = [p for _, p in _parts(table, REPLY)]
        spread = lambda x: np.concatenate(x)[np.argsort(self.order)]
        count = spread([p[0] for p in parts])
        mass, context = (np.stack([spread([p[i].reshape(chains, -1)[k] for p in parts]) for k in range(chains)]) for i in (1, 2))
        floor = (STRENGTH + sums["rate"] * sums["tables"]) / (sums["known"] + 1)
        return count, (np.maximum(mass, 0) + floor[:, None]) / (STRENGTH + sums["customers"])[:, None], context


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of arrays, sorted in place: a table of hashes, as ``np.unique`` makes for integers, takes more time and memory."""
    values = np.concatenate(parts)
    values.sort(kind="stable")
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _coded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted arrays, and the place of every value among them; ``parts`` is emptied."""
    distinct = _distinct(parts)
    places = np.concatenate([np.searchsorted(distinct, p).astype(np.uint32) for p in parts])
    parts.clear()
    return distinct, places


def _merged(table: pa.Table, homes: int) -> pa.Table:
    """The pairs of all blocks of a shard, each once, with where each block's pairs are among them, and the first questions."""
    key, parts = table["key"][0].as_py(), _parts(table, PAIRS)
    words = _distinct([_distinct([x]) for _, (left, right, _) in parts for x in (np.cumsum(left), right)])
    codes, learnt, sizes = [], [], [(block, len(p[0])) for block, p in parts]
    while parts:  # block by block, so that a shard's pairs are held once
        _, (left, right, count) = parts.pop(0)
        codes.append(np.searchsorted(words, np.cumsum(left)) * len(words) + np.searchsorted(words, right))
        learnt.append(count.astype(np.uint32))
    pairs, pair = _coded(codes)
    count = np.zeros(len(pairs), np.int64)
    np.add.at(count, pair, np.concatenate(learnt))
    body = [np.diff(words, prepend=0), np.diff(pairs // len(words), prepend=0), pairs % len(words), count]
    items, begin = [(STATE, key, 0, _pack(*body), [int((count == 1).sum()), int((count == 2).sum())])], 0
    for block, n in sizes:
        items.append((INDEX, key, block, _pack(pair[begin : begin + n]), None))
        begin += n
    return _rows(items + _Shard(key, body, homes).ask(np.minimum(count, 1)[None, :]))


def score_texts(docs: DataFrame, shard_bytes: int = SHARD_BYTES, chains: int = CHAINS, burn_in: int = BURN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are lower-cased (A-Z) words and one end. Restaurants of one-word contexts share the root restaurant, whose
    own parent is uniform over the training tokens and one unknown. Training texts (crc32 of the id
    modulo 5 not 1; null ids learn) give each restaurant its customers. Seating starts with one table for each dish; in a sweep
    each dish's tables are drawn from their conditional given the other dishes' tables of its restaurant and the root's probabilities
    (``draw_tables``), then the root's are drawn under them in the same way. All dishes of a sweep are drawn side by side, so "given" means as the
    sweep before left them, and the root's probabilities still hold the dish's own tables of that sweep: a parallel sampler, and not one that moves a dish at a time; tests hold its scores against a sampler that seats one
    customer at a time. ``chains`` chains of ``burn_in`` dropped sweeps and one that
    counts run side by side, and the predictive probabilities of the chains are averaged. Discounts follow from how
    many pairs, and words, are met once and twice.

    Words are numbered by how frequent they are, in homes by digest. Word pairs are counted within blocks of texts and
    dealt to shards by a digest of both words, so a frequent context or word is spread over all of them, and a frequent
    pair costs its shard one entry a block. A pair's probability goes back to the blocks that have it, which sum by text.
    What a shard needs to know of a word (count, root probability, tables as context) it asks of the word's
    home. Everything gathered grows with the corpus; only totals reach the driver. Null and empty texts
    have the end alone. Repeated rows and equal ids each give their row, any long is an id; no rows give none.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), (~held).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-size // shard_bytes))

    def grouped(run, *tables: DataFrame) -> DataFrame:
        """Rows of one key from all tables, in one task."""
        return functools.reduce(DataFrame.unionByName, tables).groupBy("key").applyInArrow(run, SHAPE)

    def of(table: DataFrame, *kinds: int) -> DataFrame:
        return table.where(F.col("kind").isin(*kinds))

    def total(table: DataFrame, kind: int, n: int) -> list[int]:
        row = of(table, kind).agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(n)]).first()
        return [int(x) for x in row]

    made = written(_blocks(base, shards), "blocks")
    numbered = written(grouped(lambda t: _numbered(t, shards), of(made, WORDS)), "numbers")
    n_known, n_tokens, ones, twos = total(numbered, COUNTS, 4)
    root_rate = _rate(ones, twos)
    paired = written(grouped(lambda t: _paired(t, shards, n_tokens, n_known), of(made, BLOCK), of(numbered, IDS)), "pairs")
    forget(spark, made)
    release(spark)
    merged = written(grouped(lambda t: _merged(t, shards), of(paired, PAIRS)), "shards")
    rate = _rate(*total(merged, STATE, 2))
    texts = written(of(paired, BLOCK), "texts")  # the pairs beside them are in the shards now
    forget(spark, paired)
    release(spark)

    def root(asked: DataFrame, sweep: int, n: int, drawn: DataFrame | None = None, whole: np.ndarray | None = None) -> tuple[DataFrame, dict]:
        """Answers to all shards from the root restaurants of ``n`` chains, and the totals that make them probabilities.

        ``drawn`` has each word's root tables of the sweep before, ``whole`` the chains' sums of them; at first each word has one.
        """

        def reply(table: pa.Table) -> pa.Table:
            home, parts = table["key"][0].as_py(), _parts(table, ASKED)
            ((_, (count,)),) = _parts(table, COUNTS)
            rng = np.random.default_rng((2, sweep, home))
            rank = [np.cumsum(p[0]) for _, p in parts]
            every = np.concatenate(rank) if parts else np.zeros(0, np.int64)
            mass, contexts, sums, kept = [], [], [], []
            last = [t for _, p in _parts(table, ROOT) for t in p] or [np.ones(len(count), np.uint32)]
            for k in range(n):
                dish, context = (np.bincount(every, weights=np.concatenate([p[i].reshape(n, -1)[k] for _, p in parts]) if parts else None, minlength=len(count)) for i in (1, 2))
                customers = dish.astype(np.int64)
                before = last[k % len(last)].astype(np.int64)
                total_before = n_known if whole is None else whole[k % len(whole)]
                tables = draw_tables(customers, np.maximum(total_before - before, 0), np.full(len(count), 1 / (n_known + 1)), root_rate, rng)
                kept.append(tables.astype(np.uint32))
                mass.append(customers - root_rate * tables)
                contexts.append(context.astype(np.int64))
                sums += [int(customers.sum()), int(tables.sum())]
            items = [(REPLY, s, home, _pack(count[r], np.concatenate([x[r] for x in mass]), np.concatenate([x[r] for x in contexts])), sums if i == 0 else None) for i, ((s, _), r) in enumerate(zip(parts, rank, strict=True))]
            return _rows([*items, (ROOT, home, 0, _pack(*kept), None)])

        replies = written(grouped(reply, of(asked, ASKED), of(numbered, COUNTS), *([of(drawn, ROOT)] if drawn else [])), "replies")
        sums = np.array(total(replies, REPLY, 2 * n), np.float64).reshape(n, 2)
        release(spark)
        return replies, {"customers": sums[:, 0], "tables": sums[:, 1], "known": n_known, "rate": root_rate}

    def own_shard(table: pa.Table) -> _Shard:
        ((_, body),) = _parts(table, STATE)
        return _Shard(table["key"][0].as_py(), body, shards)

    def sweep_of(number: int, sums: dict, n: int):
        def run(table: pa.Table) -> pa.Table:
            own = own_shard(table)
            _, chance, context = own.told(table, sums, n)
            rng = np.random.default_rng((1, number, own.key))
            last = [t for _, p in _parts(table, TABLES) for t in p] or [np.minimum(own.count, 1)]
            tables = []
            for k in range(chains):
                others = context[k % n][own.left] - last[k % len(last)].astype(np.int64)
                tables.append(draw_tables(own.count, others, chance[k % n][own.right], rate, rng))
            return _rows([(TABLES, own.key, 0, _pack(*[t.astype(np.uint32) for t in tables]), None), *own.ask(np.stack(tables))])

        return run

    replies, sums = root(merged, 0, 1)
    asked = merged
    for number in range(1, burn_in + 2):
        last = [] if number == 1 else [of(asked, TABLES)]
        before, asked = asked, written(grouped(sweep_of(number, sums, 1 if number == 1 else chains), of(merged, STATE), of(replies, REPLY), *last), "sweep")
        if number > 1:
            forget(spark, before)
        release(spark)
        answered, (replies, sums) = replies, root(asked, number, chains, replies, sums["tables"])
        forget(spark, answered)

    def judge(table: pa.Table) -> pa.Table:
        own = own_shard(table)
        ((_, tables),) = _parts(table, TABLES)
        count, chance, context = own.told(table, sums, chains)
        below = (STRENGTH + count)[own.left]
        mean = sum(np.maximum(own.count - rate * tables[k], 0) + (STRENGTH + rate * context[k])[own.left] * chance[k][own.right] for k in range(chains)) / chains
        log = np.log10(mean / below).astype(np.float32)
        return _rows((SCORES, block, own.key, _pack(log[pair]), None) for block, (pair,) in _parts(table, INDEX))

    def by_text(table: pa.Table) -> pa.Table:
        """Sums over the tokens of each text of a block."""
        ((_, (pair, sizes, ids, known, train, flat, met)),) = _parts(table, BLOCK)
        log = np.concatenate([p[0] for _, p in _parts(table, SCORES)]).astype(np.float64)[pair]
        score = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=log, minlength=len(sizes))
        return pa.table({"doc_id": pa.array(ids, mask=~known), "held_out": ~train, "n_tokens": sizes.astype(np.int64), "n_known": met, "base_score": flat, "score": score})

    scored = written(grouped(judge, of(merged, STATE, INDEX), of(asked, TABLES), of(replies, REPLY)), "scores")
    for table in (merged, asked, replies, numbered):
        forget(spark, table)
    release(spark)
    whole = texts.unionByName(scored).groupBy("key").applyInArrow(by_text, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    return score_texts(documents(spark, sf_dir).select("doc_id", "text"))
