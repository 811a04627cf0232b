"""Token alignment against whole texts through the tokenizers, token pair by token pair."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docforge.llm import alignment

from . import brute
from .test_operators import docs, empty, texts  # noqa: F401

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
ODD = ["  two  spaces ", " lead", "trail ", "\n\n a\tb\r\n c", "<|endoftext|> and <s> </s> <unk> <0x0A>", "日本語 のテキスト です。 漢字", "naïve café   x", "é ́x a ​b", "▁ block ▁a", "😀 😀😀 👨‍👩‍👧", "it's we'll 12 345 1,000.5", "a\x00b \x01 c", "мир и труд", "ﬁ ½ Ⅷ ①", "x" * 3000 + " y", " ", "\n", "don 't 's 's", "عربى نص", "\U0001d11e \U000e0041 t"]


def test_documents(spark, docs, texts):  # noqa: F811
    rows = [*texts, *((1000 + i, t) for i, t in enumerate(ODD)), *((2000 + i, ODD[0]) for i in range(9))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r for r in rows if r[0] >= 1000], "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(table, digest=True, block_bytes=4000).collect()}
    want = brute.alignment(rows)
    assert got == want
    plain = {r["doc_id"]: r["groups"] for r in alignment.align_tokens(table).collect()}
    assert all(brute.hashlib.sha256(plain[i].encode()).hexdigest() == w[-1] if w[0] else plain[i] == "" for i, w in want.items())


def test_edges(spark, empty):  # noqa: F811
    assert alignment.align_tokens(empty).count() == 0
    rows = spark.createDataFrame([(None, "one two", 1), (4, "one two", 2), (4, "one two", 2), (4, None, 3), (5, "", 4)], "doc_id long, text string, N_A int")
    got = sorted((tuple(r) for r in alignment.align_tokens(rows).collect()), key=repr)
    assert [r[0] for r in got] == [4, 4, 4, 5, None] and sorted(r[5] for r in got) == [0, 0, got[-1][4], got[-1][4], got[-1][4]]
    assert all(r[6] == 3 * r[4] for r in got if r[1])  # three rows hold each pair
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align_tokens(nothing).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_groups(spark):
    """A group that never ends makes pairs as its bytes, and each overlap once."""
    a = [(i, 7) for i in range(300)]
    b = [(1000 + i, 5) for i in range(420)]
    coded = spark.createDataFrame([(1, [n << alignment.ID_BITS | i for i, n in a], [3 << alignment.ID_BITS | 9, *(n << alignment.ID_BITS | i for i, n in b[:-1]), 2 << alignment.ID_BITS | 8])], "uid long, a array<int>, b array<int>")
    _, links = alignment.align_units(coded)
    ends = [np.cumsum([0, *(int(x) >> alignment.ID_BITS for x in coded.first()[s])]) for s in "ab"]
    spans = {s: list(zip(range(len(e) - 1), e, e[1:])) for s, e in zip("ab", ends)}
    want = {(p, q) for p, x, y in spans["a"] for q, v, w in spans["b"] if x < w and v < y}
    got = [(r["a_pos"], r["b_pos"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'aä1.")), max_size=40))
def test_seams_cut_where_both_tokenizers_do(text):
    import re

    whole = brute.tokenized(text)
    if whole is None or not text:
        return
    # the seams of the engine's pattern, by categories of this Python's Unicode
    import unicodedata

    solid = [unicodedata.category(c)[0] in "LNPS" for c in text]
    cuts = [m.start() for m in re.finditer("\x20", text) if 0 < m.start() < len(text) - 1 and solid[m.start() - 1] and solid[m.start() + 1]]
    units, at = [], 0
    for c in cuts:
        units.append(text[at:c])
        at = c + 1
    units.append(text[at:])
    parts = [brute.tokenized(u) for u in units]
    assert all(parts) or "" in units
    assert [[t for p in parts if p for t in p[s]] for s in (0, 1)] == [list(s) for s in whole]
    encode, _ = ENCODERS[0] if ENCODERS else ENCODERS.append(alignment._first_encoder()) or ENCODERS[0]
    assert [i for u in units for i in encode([u])[0]] == [i for i, _ in whole[0]]


ENCODERS = []


def test_blocks_and_parcels_are_small(spark):
    """A block's texts take no more than two bytes a unit, and units' results as parcels give back what was packed."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    block = alignment._packed_blocks(table.coalesce(1), 6 << 20).first()
    sizes, slots = alignment.kernel.unpack(bytes(block["slots"]))
    assert sizes.sum() == len(slots) > 10_000 and len(block["slots"]) <= 2 * len(slots)
    assert (np.diff(np.bincount(slots, minlength=len(block["units"]))) <= 0).all()
    import pyarrow as pa

    rows = [(5, 0, True, [1, 2], [1, 1], [7, 8, 9], [70, 90], [0, 1, 2], [0, 1, 1]), (5, 1, False, [], [], [], [], [], []), (5, 3, True, [1], [1], [4], [40], [0], [0]), (6, 0, True, [1], [2], [1], [10, 11], [0, 0], [0, 1])]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.list_(pa.int32())] * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["home", "slot", "sound", *alignment._LISTS])
    made = pa.Table.from_batches(alignment._parcels(iter([batch.slice(0, 1), batch.slice(1, 3)])))
    assert made.column("home").to_pylist() == [5, 6]
    units = alignment._Units(made.column("parcel").to_pylist()[:1])
    assert units.said() == ["7|70;8,9|90", "", "4|40"] and units.sound.tolist() == [True, False, True]
    assert [divmod(p, 1 << 32) for p in units.pairs.tolist()] == [(7, 70), (8, 90), (9, 90), (4, 40)] and units.n_links.tolist() == [3, 0, 1]
    assert alignment._Units([]).said() == []


def test_units_of_equal_lengths_share_an_alignment(spark, monkeypatch):
    """Joins and windows run over distinct lengths of tokens, not over units; a unit that isn't sound has no shape."""
    seen, plain = [], alignment.align_units
    monkeypatch.setattr(alignment, "align_units", lambda coded: (seen.append(coded.count()), plain(coded))[1])
    rows = spark.createDataFrame([(1, " ".join(f"{x}{y}" for x in "abcdefghijk" for y in "abcdefghijk")), (2, "a ▁x")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(rows, digest=True).collect()}
    assert got == brute.alignment([tuple(r) for r in rows.collect()])
    assert len(seen) == 1 and 0 < seen[0] < 20  # of 121 units
    units = spark.createDataFrame([("hello", [1]), ("world", [2]), ("▁x", [3])], "unit string, places array<long>")
    coded = {r["places"][0]: r for r in alignment.encoded(units).collect()}
    assert [bytes(coded[3][c]) for c in ("a", "b", "shape")] == [b""] * 3 and not coded[3]["sound"]
    assert bytes(coded[1]["shape"])[:4] == bytes([len(coded[1]["a"]) // 2, 0, 0, 0])


def test_binaries_as_lists():
    import pyarrow as pa

    column = alignment._binaries(np.arange(6, dtype=np.int32), np.array([2, 0, 3, 1]))
    assert alignment._lists(column, np.int32).to_pylist() == [[0, 1], [], [2, 3, 4], [5]]
    assert alignment._lists(column.slice(1, 2), np.int32).to_pylist() == [[], [2, 3, 4]]
    assert alignment._lists(pa.array([], pa.binary()), np.uint16).to_pylist() == []
