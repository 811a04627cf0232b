"""Alignment of two tokenizers' tokens: relational over distinct units of text, put together for whole documents in blocks."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import documents, forget, release, written

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 6 << 20
#: Overlaps within a group are found by bins of so many bytes.
BIN = 64
#: A place of a unit is its block and its slot there in one long: 20 bits for the block's task, 16 for its number there, the rest for the slot.
SLOT_BITS = 27
#: Links of so many documents are sorted at once in a block, about.
LINKS = 1 << 20
#: A text is cut before a single space between two of these; tokens of neither tokenizer reach over such a place. The space stands first, so
#: that nothing else is looked at around it.
SEAM = r"\x20(?<=[\p{L}\p{N}\p{P}\p{S}]\x20)(?=[\p{L}\p{N}\p{P}\p{S}])"
#: A token is an id and its bytes in one int.
ID_BITS = 17
#: Below this code point the ranks' own encoder splits texts as the tokenizer's file does, for certain; it is five times as fast.
SURE = 0x250


def _first_encoder():
    """Token ids of space+unit by FIRST, and each id's bytes."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path(FIRST)))
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    with open(public_tokenizers.path(FIRST.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = {code: chr(code) for code in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letter = {c: code for code, c in plain.items()} | {chr(256 + k): code for k, code in enumerate(c for c in range(256) if c not in plain)}
    pieces = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    values = [bytes(letter[c] for c in p) if all(c in letter for c in p) else None for p in pieces]

    def encode(units: list[str]) -> list:
        return [quick.encode_ordinary(" " + u) if len(u) < 2000 and (u.isascii() or max(map(ord, u)) < SURE) else model.encode(" " + u, add_special_tokens=False).ids for u in units]

    return encode, values


def _second_encoder():
    """Token ids of units by SECOND, which puts a space before them, and each id's bytes. No piece has a space after something else."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(SECOND)))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece reaches over a space, so texts can't be cut there")
    values = [None if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return lambda units: model.encode(units, num_threads=1), values


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``counts`` of ``values`` after each other as a binary column."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _lists(column: pa.Array, kind: type) -> pa.Array:
    """A binary column of numbers as one of lists, over the same bytes."""
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(held, kind, ends[-1] // size) if ends[-1] else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends // size, pa.int32()), pa.array(values))


def encoded(units: DataFrame) -> DataFrame:
    """places, a, b, shape, sound of distinct units (unit, places): ids of both tokenizers' tokens as binaries of uint16, the tokens' lengths, and
    whether both give back the unit's own bytes. A unit that isn't sound has neither tokens nor a shape.

    A shape is a binary of uint16: how many tokens the first side has (two numbers), their lengths in bytes, and those of the other side.
    """

    def encode(batches):
        sides = None
        for batch in batches:
            if sides is None:
                sides = []
                for encoder, values in (_first_encoder(), _second_encoder()):
                    if len(values) > 1 << 16:
                        raise ValueError("ids take more than 16 bits")
                    sides.append((encoder, [v or b"" for v in values], np.array([v is None for v in values]), np.array([len(v or b"") for v in values], np.uint32)))
            texts = batch.column(0).to_pylist()
            wanted = [b" " + u.encode() for u in texts]
            sound, found = np.ones(len(texts), bool), []
            for encoder, values, lost, sizes in sides:
                ids = encoder(texts)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
                of = np.repeat(np.arange(len(n)), n)
                sound[of[lost[flat]]] = False
                said = b"".join(map(values.__getitem__, flat.tolist()))
                ends = np.cumsum(np.bincount(of, sizes[flat], len(n)).astype(np.int64)).tolist()
                sound &= np.fromiter((said[x:y] == w for x, y, w in zip([0, *ends], ends, wanted)), bool, len(n))
                found.append((flat, n, of, sizes))
            held = []
            for flat, n, of, sizes in found:
                flat = flat[sound[of]]
                held.append((flat.astype(np.uint16), np.where(sound, n, 0), sizes[flat]))
            (a, n_a, size_a), (b, n_b, size_b) = held
            whole = np.where(sound, 2 + n_a + n_b, 0)
            first = np.cumsum(whole) - whole
            shape = np.empty(int(whole.sum()), np.uint16)
            shape[first[sound]], shape[first[sound] + 1] = n_a[sound] & 0xFFFF, n_a[sound] >> 16
            shape[_ranges(first + 2, n_a)], shape[_ranges(first + 2 + n_a, n_b)] = size_a, size_b
            yield pa.RecordBatch.from_arrays([batch.column(1), _binaries(a, n_a), _binaries(b, n_b), _binaries(shape, whole), pa.array(sound)], ["places", "a", "b", "shape", "sound"])

    return units.mapInArrow(encode, f"places {units.schema['places'].dataType.simpleString()}, a binary, b binary, shape binary, sound boolean")


def _shaped(batches):
    """uid, shape, a, b of shapes (uid, shape): tokens of such lengths, with 0 for their ids."""
    for batch in batches:
        sides = {"a": [], "b": []}
        for shape in batch.column(1).to_pylist():
            low, high, *sizes = np.frombuffer(shape, np.uint16).tolist()
            n = high << 16 | low
            for side, own in (("a", sizes[:n]), ("b", sizes[n:])):
                sides[side].append([x << ID_BITS for x in own])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int32())) for x in sides.values())], ["uid", "shape", "a", "b"])


def _told(batches):
    """Columns of lists as binaries of int32."""
    for batch in batches:
        lists = [x.cast(pa.list_(pa.int32())) for x in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(_binaries(x.flatten().to_numpy(zero_copy_only=False).astype(np.int32), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists)], batch.schema.names)


def align_shapes(shapes: DataFrame) -> DataFrame:
    """shape, n_a, n_b, at_a, at_b of distinct shapes: the groups' numbers of tokens and the numbers of the tokens that each link joins, as binaries of int32.

    Where tokens end and overlap follows from their lengths alone, so units of equal lengths share the groups and links of one.
    """
    numbered = written(shapes.withColumn("uid", F.monotonically_increasing_id()).select("uid", "shape"), "shapes")
    with one_dealing(shapes.sparkSession):
        coded = numbered.mapInArrow(_shaped, "uid long, shape binary, a array<int>, b array<int>")
        groups, links = align_units(coded.select("uid", "a", "b"))
        every = F.array_sort(F.collect_list(F.struct("grp", F.size("a").alias("n_a"), F.size("b").alias("n_b")))).alias("every")
        of = lambda c: F.transform("every", lambda x: x[c]).alias(c)
        said = groups.groupBy("uid").agg(every).select("uid", of("n_a"), of("n_b"))
        linked = links.groupBy("uid").agg(F.collect_list(F.struct(F.col("a_pos").alias("at_a"), F.col("b_pos").alias("at_b"))).alias("every")).select("uid", of("at_a"), of("at_b"))
        both = numbered.repartition("uid").join(said, "uid").join(linked, "uid").select("shape", "n_a", "n_b", "at_a", "at_b")
        aligned = written(both.mapInArrow(_told, "shape binary, n_a binary, n_b binary, at_a binary, at_b binary"), "aligned-shapes")
    forget(shapes.sparkSession, numbered)
    return aligned


def _tokens(coded: DataFrame, side: str) -> DataFrame:
    """uid, pos, id, start, end of one side's tokens."""
    exploded = coded.select("uid", F.posexplode(side).alias("pos", "x"))
    size = F.shiftrightunsigned("x", ID_BITS)
    so_far = F.sum(size).over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return exploded.select("uid", "pos", F.col("x").bitwiseAND((1 << ID_BITS) - 1).alias("id"), size.alias("size"), so_far.alias("end")).select("uid", "pos", "id", (F.col("end") - F.col("size")).alias("start"), "end")


def align_units(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, links) of units given as uid, a, b.

    Both sides' ends are met by unit and end; the cuts before a token, counted along the unit, number its group. Groups: uid, grp, a and b
    (arrays of ids, in order). Links: uid, a_pos, a_id, b_pos, b_id, all pairs of a group whose byte ranges overlap, joined by unit,
    group and the bins of BIN bytes that both reach, each pair in the first of these alone. So a group that goes
    on for long makes pairs as its bytes, not as its tokens squared.

    Units are dealt once, as arrays; within ``one_dealing`` all windows and joins keep to that.
    """
    dealt = coded.repartition("uid")
    sides = {s: _tokens(dealt, s) for s in ("a", "b")}
    before = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def grouped(own: str, other: str) -> DataFrame:
        cuts = sides[other].select("uid", "end", F.lit(1).alias("cut"))
        return sides[own].join(cuts, ["uid", "end"], "left").select("uid", "pos", "id", "start", "end", F.coalesce(F.sum("cut").over(before), F.lit(0)).cast("int").alias("grp"))

    placed = {"a": grouped("a", "b"), "b": grouped("b", "a")}

    def listed(side: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "id")))
        return placed[side].groupBy("uid", "grp").agg(F.transform(ordered, lambda x: x["id"]).alias(side))

    def binned(side: str) -> DataFrame:
        first, last = F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN)
        names = [F.col(c).alias(f"{side}_{c}") for c in ("pos", "id", "start", "end")]
        return placed[side].where(F.col("end") > F.col("start")).select("uid", "grp", *names, F.explode(F.sequence(first, last)).alias("bin"))

    both = binned("a").join(binned("b"), ["uid", "grp", "bin"]).where("a_start < b_end AND b_start < a_end")
    first_common = F.floor(F.greatest("a_start", "b_start") / BIN)
    return listed("a").join(listed("b"), ["uid", "grp"]), both.where(F.col("bin") == first_common).select("uid", "a_pos", "a_id", "b_pos", "b_id")


@contextmanager
def one_dealing(spark: SparkSession):
    """Joins whose keys begin with what both sides are already dealt by don't deal them again; without broadcasts, so that all keep to it."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    was = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _packed_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, ids, slots, units: documents packed to blocks, each text as the numbers of its units in the block's own list of distinct units.

    Frequent units have small numbers, so that most bytes of the packed numbers are alike.
    """

    def pack(batches):
        number = TaskContext.get().partitionId() << 16
        ids, units, slots, sizes, size = [], {}, [], [], 0
        for batch in batches:
            lists, grown = batch.column(1), np.cumsum(batch.column(2).to_numpy())
            offsets = np.asarray(lists.offsets)
            at = 0
            while at < batch.num_rows:
                done = grown[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(grown, done + block_bytes - size, "right")))
                coded = lists.values.slice(offsets[at], offsets[to] - offsets[at]).dictionary_encode()
                own = np.array([units.setdefault(u, len(units)) for u in coded.dictionary.to_pylist()], np.int32)
                slots.append(own[coded.indices.to_numpy()])
                sizes.append(np.diff(offsets[at : to + 1]).astype(np.int32))
                ids.append(batch.column(0).slice(at, to - at))
                size += grown[to - 1] - done
                at = to
                if size >= block_bytes:
                    yield row(number, ids, sizes, slots, units)
                    number += 1
                    ids, units, slots, sizes, size = [], {}, [], [], 0
        if ids:
            yield row(number, ids, sizes, slots, units)

    def row(number, ids, sizes, slots, units):
        if len(units) >> SLOT_BITS or (number & 0xFFFF) == 0xFFFF:
            raise ValueError("places take more than 63 bits")
        every = np.concatenate(slots)
        order = np.argsort(-np.bincount(every, minlength=len(units)), kind="stable")
        rank = np.empty(len(units), np.uint32)
        rank[order] = np.arange(len(units), dtype=np.uint32)
        listed = pa.array(list(units), pa.string()).take(pa.array(order))
        whole = [[number], [pa.concat_arrays(ids)], [kernel.pack(np.concatenate(sizes), rank[every])], [listed]]
        return pa.RecordBatch.from_arrays([pa.array(w, t) for w, t in zip(whole, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())), strict=True)], ["block", "ids", "slots", "units"])

    text = F.coalesce("text", F.lit(""))
    cut = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SEAM))
    return docs.select(F.col("doc_id").cast("long"), cut, F.octet_length(text)).mapInArrow(pack, "block long, ids array<long>, slots binary, units array<string>")


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers at .. at + size of each pair, one after the other."""
    total = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(at - total[:-1], size) + np.arange(total[-1])


def _parcels(batches):
    """Rows of units' results, sorted by home and slot, as one packed parcel for each home: slots, sound, how many groups and links, the groups' sizes, the tokens, the links."""

    def parcel(rows: list[pa.RecordBatch]) -> bytes:
        own = pa.Table.from_batches(rows).combine_chunks()
        lists = {c: own.column(c).combine_chunks() for c in _LISTS}
        lists = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in lists.items()}
        counts = [lists[c].value_lengths().to_numpy().astype(np.uint32) for c in ("n_a", "at_a")]
        slots, sound = own.column("slot").to_numpy(), own.column("sound").to_numpy()
        return kernel.pack(np.diff(slots, prepend=np.int32(0)).astype(np.uint32), sound.astype(np.uint8), *counts, *(lists[c].flatten().to_numpy().astype(np.uint32) for c in _LISTS))

    homes, parcels, held, home = [], [], [], None
    for batch in batches:
        own = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if held and home != int(own[x]):
                homes.append(home)
                parcels.append(parcel(held))
                held = []
            home = int(own[x])
            held.append(batch.slice(x, y - x))
        if parcels:
            yield pa.RecordBatch.from_arrays([pa.array(homes), pa.array(parcels, pa.binary())], ["home", "parcel"])
            homes, parcels = [], []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([parcel(held)], pa.binary())], ["home", "parcel"])


def _packed(batches):
    """``_parcels`` of rows (place, sound, and binaries for lists) sorted by place."""
    for_lists = [np.uint16 if c in "ab" else np.int32 for c in _LISTS]

    def rows(batch):
        place = batch.column(0).to_numpy()
        home, slot = pa.array(place >> SLOT_BITS), pa.array((place & ((1 << SLOT_BITS) - 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([home, slot, batch.column(1), *map(_lists, batch.columns[2:], for_lists)], ["home", "slot", "sound", *_LISTS])

    return _parcels(map(rows, batches))


class _Units:
    """The results of a block's units, by their slots, from parcels."""

    def __init__(self, parcels: list[bytes]):
        parts = [kernel.unpack(p) for p in parcels] or [[np.zeros(0, np.uint32)] * (4 + len(_LISTS))]
        slots = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts])
        held = {}
        for i, c in enumerate(("sound", "groups", "links", *_LISTS), 1):  # one after the other, so that a block's results are held once
            held[c] = np.concatenate([p[i] for p in parts])
            for p in parts:
                p[i] = None
        order = np.argsort(slots)
        groups, links = (held.pop(c).astype(np.int64) for c in ("groups", "links"))
        self.sound, self.n_groups, self.n_links = held.pop("sound")[order] > 0, groups[order], links[order]
        at = np.concatenate([[0], np.cumsum(groups)])
        own = _ranges(at[:-1][order], self.n_groups)
        self.sizes, self.n, self.tokens = {}, {}, {}
        for s in "ab":
            ends = np.concatenate([[0], np.cumsum(held[f"n_{s}"], dtype=np.int64)])
            self.sizes[s] = held.pop(f"n_{s}")[own]
            self.n[s] = np.diff(ends[at])[order]
            self.tokens[s] = held.pop(s)[_ranges(ends[at][:-1][order], self.n[s])]
        own = _ranges(np.concatenate([[0], np.cumsum(links)])[:-1][order], self.n_links)
        first = {s: np.repeat(np.cumsum(self.n[s]) - self.n[s], self.n_links) for s in "ab"}
        a, b = (self.tokens[s][first[s] + held.pop(f"at_{s}")[own]].astype(np.int64) for s in "ab")
        self.pairs = a << 32 | b

    def said(self) -> list[str]:
        """The groups of each unit as text."""
        listed = lambda sizes, values, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values), by)
        sides = [listed(self.sizes[s], pa.array(self.tokens[s]).cast(pa.string()), ",") for s in "ab"]
        return listed(self.n_groups, pc.binary_join_element_wise(*sides, "|"), ";").to_pylist()


def _composed(digest: bool):
    """For a block and the results of its units: the documents' rows, and the distinct pairs of each."""
    names = ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "docs", "ends", "at", "times"]

    def compose(key, blocks: pa.Table, found: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return OF_BLOCK.empty_table()
        ids = blocks.column("ids")[0].as_py()
        units = _Units(found.column("parcel").to_pylist())
        sizes, slots = kernel.unpack(blocks.column("slots")[0].as_py())
        sound, n_links, strings = units.sound, units.n_links, units.said()
        counts = {"n_a": units.n["a"], "n_b": units.n["b"], "n_groups": units.n_groups}
        starts = np.concatenate([[0], np.cumsum(n_links)])
        pairs, index = np.unique(units.pairs, return_inverse=True)
        index = index.astype(np.int32)
        del units
        first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[slots], dtype=np.int64)])[first])  # noqa: E731  (of each document)
        kept = (sizes > 0) & (summed(~sound) == 0)
        sums = [np.where(kept, summed(c), 0) for c in (*counts.values(), n_links)]
        texts = []
        for x, y, whole in zip(first[:-1].tolist(), first[1:].tolist(), kept.tolist(), strict=True):
            said = ";".join([strings[u] for u in slots[x:y].tolist()]) if whole else ""
            texts.append(hashlib.sha256(said.encode()).hexdigest() if digest and whole else said)
        del strings
        ends, ats, times = np.zeros(len(ids), np.int64), [], []
        linked, d = np.concatenate([[0], np.cumsum(sums[3])]), 0
        while d < len(ids):  # the links of some documents at a time, sorted by document and pair
            to = max(d + 1, int(np.searchsorted(linked, linked[d] + LINKS, "right")) - 1)
            own = slots[first[d] : first[to]][np.repeat(kept[d:to], sizes[d:to])]
            held = np.repeat(np.arange(to - d), sums[3][d:to]) << 32 | index[_ranges(starts[own], n_links[own])]
            held.sort()
            new = np.flatnonzero(np.diff(held, prepend=-1))
            ends[d:to] = np.bincount(held[new] >> 32, minlength=to - d)
            ats.append((held[new] & 0xFFFFFFFF).astype(np.int32))
            times.append(np.diff(np.append(new, len(held))).astype(np.int32))
            d = to
        at = np.concatenate(ats) if ats else np.zeros(0, np.int32)
        docs = np.bincount(at, minlength=len(pairs))
        seen = docs > 0  # units of texts without tokens have pairs that nothing holds
        place = np.cumsum(seen) - 1
        columns = [key[0].as_py(), ids, *sums, texts, pairs[seen], docs[seen], ends.tobytes(), place[at].astype(np.int32).tobytes(), (np.concatenate(times) if times else at).astype(np.int32).tobytes()]
        return pa.Table.from_arrays([pa.array([c], OF_BLOCK.field(n).type) for n, c in zip(names, columns, strict=True)], names)

    return compose


_LONGS = pa.list_(pa.int64())
#: Of a unit: tokens of each of its groups, the tokens, and the numbers in the unit of the tokens that each link joins.
_LISTS = ("n_a", "n_b", "a", "b", "at_a", "at_b")
OF_BLOCK = pa.schema([("block", pa.int64()), ("ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS), ("groups", pa.list_(pa.string())), ("pairs", _LONGS), ("docs", _LONGS), ("ends", pa.binary()), ("at", pa.binary()), ("times", pa.binary())])


def _scored(key, blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block with the sums of their links' counts."""
    if not blocks.num_rows:
        return _RESULT.empty_table()
    order = np.argsort(counts.column("slot").to_numpy())
    n, best = (counts.column(c).to_numpy()[order] for c in ("n", "best"))
    ends, at, times = (np.frombuffer(blocks.column(c)[0].as_py(), t).astype(np.int64) for c, t in (("ends", np.int64), ("at", np.int32), ("times", np.int32)))
    sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], np.cumsum(ends)])]) for v in (times * best[at], times * n[at])] if len(at) else [np.zeros(len(ends), np.int64)] * 2
    whole = [blocks.column(c)[0].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*whole, *map(pa.array, sums), blocks.column("groups")[0].values], _RESULT.names)


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align_tokens(docs: DataFrame, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every whole text: tokens of both tokenizers, groups between the bytes
    where both end, links of overlapping tokens, links whose pair is in as many documents as any of its first token, the sum of the
    links' document counts, and the groups as ``a1,a2|b1;a3|b2,b3`` (with ``digest`` their sha256).

    Texts are cut at seams, places where both tokenizers cut whatever stands around, and each distinct unit is encoded once. Units whose tokens
    have the same lengths are aligned once, by joins and windows on tokens (``align_shapes``, ``align_units``). Documents go in blocks of about ``block_bytes`` with the distinct units of each; a block
    gets its units' results, counts its distinct pairs, and gets the corpus-wide counts of these back. So a frequent unit or
    pair is one row a block, and tasks hold a block and its results.

    A null or empty text, and one that either tokenizer doesn't give back byte for byte, has zeros and ''. Null and equal ids and repeated
    rows each give their row, and count as documents of their own; no rows give none.
    """
    blocks = written(_packed_blocks(docs, block_bytes), "token-blocks")
    listed = blocks.select("block", F.posexplode("units").alias("slot", "unit"))
    places = F.collect_list(F.shiftleft("block", SLOT_BITS) + F.col("slot")).alias("places")  # one for each block that has the unit
    coded = written(encoded(listed.groupBy("unit").agg(places).select("unit", "places")), "units")
    spark = docs.sparkSession
    release(spark)
    sound = coded.where("sound")
    aligned = align_shapes(sound.select("shape").distinct())
    release(spark)
    joined = sound.join(aligned, "shape").select("places", "sound", *_LISTS)
    lost = coded.where("NOT sound").select("places", "sound", "a", "b", *[F.lit(b"").alias(c) for c in _LISTS if c not in "ab"])
    found = joined.unionByName(lost).select(F.explode("places").alias("place"), "sound", *_LISTS)
    parcels = written(found.sortWithinPartitions("place").mapInArrow(_packed, "home long, parcel binary"), "parcels")
    forget(spark, coded)
    forget(spark, aligned)
    release(spark)
    of_block = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, docs array<long>, ends binary, at binary, times binary"
    made = written(blocks.select("block", "ids", "slots").groupBy("block").cogroup(parcels.groupBy("home")).applyInArrow(_composed(digest), of_block), "composed")
    forget(spark, parcels)
    forget(spark, blocks)
    release(spark)
    kinds = made.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("slot", "x")).select("block", "slot", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counted = written(kinds.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    token = F.shiftright("pair", 32)
    highest = counted.groupBy(token.alias("token")).agg(F.max("n").alias("highest"))  # one row for each entry of the vocabulary, at most
    best = counted.join(F.broadcast(highest), token == F.col("token")).select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    told = kinds.select("block", "slot", "pair").join(best, "pair").select(F.col("block").alias("home"), "slot", "n", "best")
    return made.drop("pairs", "docs").groupBy("block").cogroup(told.groupBy("home")).applyInArrow(_scored, _RESULT_DDL)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a digest in place of the groups."""
    return align_tokens(documents(spark, sf_dir).select("doc_id", "text"), digest=True).withColumnRenamed("groups", "groups_sha256")
