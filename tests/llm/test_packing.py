import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import packing as P
from quillgraph.llm.tables import table

FILE = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(FILE)
ENC = P.Encoder(FILE)


def plain_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check_ids(texts):
    ids, ends = ENC.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain_ids(t) for t in texts]


def test_odd_texts():
    check_ids(["", None, " ", "Don't  STOP!!\tit's 42nd 3.14  x y", "É é é K Å İ Σας ẞ Ÿ ªº² µ", "a<|endoftext|>b <|startoftext|> C", "\x1c\x85z", "日本語 テスト 👩‍👩‍👧 ok", "##$$%% &&& ---", "x" * 5000, "'s'T'RE 'llama"])


def test_slices_of_long_columns(spark, sf):
    texts = pa.array([r.text for r in table(spark, sf, "documents").collect()], pa.string())
    for a, b in P.slices(texts, 20_000):
        ids, ends = ENC.encode(texts.slice(a, b - a))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain_ids(t) for t in texts.slice(a, b - a).to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40) | st.text("aB é'. \n1!<|endoftext>", max_size=30), min_size=1, max_size=4))
def test_any_texts(texts):
    check_ids(texts)


def plain_best_fit(lengths, capacity):
    """Number of sequences of sequential best fit decreasing."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sequential_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([rng.randint(1, 64), rng.randint(1, 9), 5]) for _ in range(400)), reverse=True)
    fill = {}
    for n, sequence in zip(lengths, P.best_fit_decreasing(lengths, 64), strict=True):
        fill[sequence] = fill.get(sequence, 0) + n
    assert sorted(64 - v for v in fill.values()) == plain_best_fit(lengths, 64)


def plain_sweep(rows):
    """Pieces, longest first, take the smallest free slot that holds them."""
    free = [(size, k) for k, (size, kind) in enumerate(rows) if kind]
    out = set()
    for size, k in sorted(((size, k) for k, (size, kind) in enumerate(rows) if not kind), reverse=True):
        fit = [s for s in free if s[0] >= size]
        if fit:
            out.add((k, min(fit)[1]))
            free.remove(min(fit))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 1)), max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_sweep_equals_best_fit_of_slots(rows, cuts):
    """Swept at once, and in partitions whose rests are swept on."""
    rows = sorted(rows)
    kind = np.array([k for _, k in rows], np.int64)
    want = plain_sweep(rows)
    sizes = lambda pairs: sorted((rows[a], rows[b]) for a, b in pairs)  # noqa: E731  (equal pieces and slots may change places)
    pieces, slots, no_slot, no_piece = P.successor_sweep(kind)
    assert sizes(zip(pieces.tolist(), slots.tolist(), strict=True)) == sizes(want)
    assert len(no_slot) + len(pieces) == (kind == 0).sum() and len(no_piece) + len(slots) == (kind == 1).sum()
    edges = sorted({0, len(rows), *(min(c, len(rows)) for c in cuts)})
    got, left, rests = [], [], []
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        pieces, slots, no_slot, no_piece = (x + a for x in P.successor_sweep(kind[a:b]))
        got += zip(pieces.tolist(), slots.tolist(), strict=True)
        left.append((p, len(no_slot), len(no_piece)))
        rests.append((no_slot.tolist(), no_piece.tolist()))
    for q, first, p, at, n, _ in P.sweep_on(left):
        got += [(rests[q][0][first + n - 1 - i], rests[p][1][at + i]) for i in range(n)]
    assert sizes(got) == sizes(want)


def check_packing(got, docs, capacity):
    """got: rows; docs: [(id, text)]."""
    want = []
    for d, t in docs:
        ids = [*plain_ids(t), 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    flat = lambda x: sorted(x, key=str)
    assert flat([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]) == flat(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    best = len(plain_best_fit([w[3] for w in want], capacity))
    assert len(by) <= best + 1 + best // 100, (len(by), best)


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    check_packing(P.op10_best_fit_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


@pytest.mark.parametrize("kind", ["mixed", "one length", "long", "short"])
def test_rounds(spark, kind, monkeypatch):
    """Several partitions, few rounds, nearly as few sequences as sequential best fit decreasing."""
    monkeypatch.setattr(P, "TASK_ROWS", 700)
    rng = random.Random(kind)
    lengths = {"mixed": [rng.choice([rng.randint(1, 64), rng.randint(1, 256), 256, 70, 70]) for _ in range(4000)], "one length": [86] * 4000, "long": [rng.randint(100, 256) for _ in range(4000)], "short": [rng.randint(1, 12) for _ in range(4000)]}[kind]
    rounds = []
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k long, length long").repartition(5)
    rows = P.pack(df, 256, least_class=8, rounds=rounds).collect()
    assert sorted((r.k, r.length) for r in rows) == list(enumerate(lengths))
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 256
    best = len(plain_best_fit(lengths, 256))
    assert best <= len(fill) <= best + 1 + best // 50, (len(fill), best)
    assert sum(rounds) <= 40, rounds


def test_other_vocabularies():
    """Files of another kind go through their whole tokenizer."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["Hello World 123", "", "  a  b\n"]
    ids, ends = P.Encoder(path).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_beyond_memory():
    small = P.Encoder(FILE, words=3)
    for texts in (["a b c d e f", "(x), \"y\" z!"], ["b, c. a'b, 'c' d's", "q w e r t"]):
        ids, ends = small.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain_ids(t) for t in texts]


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "same text " * 9), (2, "same text " * 9), (3, "long " * 300), (None, "x")] + [(9, "tie")] * 40
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, sequence_id int, length string").repartition(5)
    check_packing(P.pack_documents(df, capacity=64).collect(), rows, 64)
    assert P.pack_documents(df.limit(0)).count() == 0
    with_ids = P.tokenize_pieces(df, capacity=64, with_ids=True).where("doc_id = 3").orderBy("piece").collect()
    assert sum((list(r.ids) for r in with_ids), []) == [*plain_ids("long " * 300), 1]
