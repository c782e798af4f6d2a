"""Tokenizing documents and packing the pieces into sequences, by bulk-synchronous best fit.

Lengths are taken in classes, each half as long as the one before, longest first. In a class, rounds are repeated until one matches nothing:

1. Every open sequence offers its gap: as many slots of the class's length as go into it, and what is left as one smaller slot.
2. Pieces and slots are range-sorted together by size. A successor sweep goes up through each partition: a slot takes the longest piece
   below it that has none. That is what best fit gives when each piece, longest first, takes its successor among the free slots; of the pieces that
   want one slot that of the highest rank wins. What a partition leaves is slots that found no piece below, then pieces that found no slot above.
3. The driver sees how many of each a partition leaves, two numbers a partition, and continues the sweep over them: it settles which ranks
   of one partition's pieces go to which ranks of another's slots. The rows meet in a join by the number of the match.
4. Gaps are reduced by the pieces that their slots took.

Pieces of a class that no gap holds open sequences: those of which q go into a sequence are ranked and dealt q by q; what makes no full q, less
than `capacity` * (1 + ln `capacity`) pieces whatever the input, is packed by sequential best fit in one task.

What the driver holds is bounded by the partitions and `capacity`: counts of lengths and of gaps, and the partitions' numbers.
No length, however frequent, is one task's: pieces are sorted by length and number.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.plans.cut import cut

CAPACITY = 4096
END_ID = 1
#: Bytes of text that are tokenized at once, and words whose ids a worker remembers.
SLICE_BYTES, WORDS = 2_000_000, 300_000
#: Lengths up to which pieces are one class, and rows that a task of a sweep sorts and holds, about.
LEAST_CLASS, TASK_ROWS = 32, 500_000


def vocabulary() -> str:
    """The path of the default vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


LETTER, MARK, SPACE = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~", r"[ \t\n\r\f\v]"


class Encoder:
    """The ids that a tokenizer file gives, with the ids of words kept.

    For a vocabulary whose pre-tokens never hold white space and end in a marked token, a text's ids are those of its
    words, one after the other. Marks between white space and a letter or digit are pre-tokens of their own, so they are taken for
    words. Distinct words are looked up among those known; of the new ones those of plain letters, digits and ASCII marks are cut into their
    pre-tokens here and go through the tokenizer's model, many at a time; all others go through the whole tokenizer, and so do
    texts with one of its special strings. With a vocabulary of another kind all texts go through the whole tokenizer.
    """

    SIMPLE = f"^[{LETTER}0-9{MARK}]+$"
    #: What a file must say for its words to be taken apart.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, words: int = WORDS) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.words = path, words
        said = json.loads(Path(path).read_text("utf-8"))
        cut_by = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": self.SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.by_words = said["normalizer"] == self.NORMALIZER and said["pre_tokenizer"] == cut_by and said["model"].get("end_of_word_suffix") == "</w>"
        del said
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.specials = [t.content for t in self.bare.get_added_tokens_decoder().values()]
        self.final = np.zeros(self.bare.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.bare.get_vocab(with_added_tokens=False).items():
            self.final[i] = token.endswith("</w>")
        self.forget()

    @cached_property
    def whole(self):
        """The tokenizer as the file has it, loaded when a word first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.start, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _wholly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))

    def _pre_tokens(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pre-tokens."""
        ids, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(runs), 4000):
            part = runs.slice(k, 4000).to_pylist()
            found = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            n = np.diff(np.flatnonzero(self.final[found]) + 1, prepend=0)
            if len(n) != len(part):
                found, n = self._wholly(part)
            ids.append(found)
            length.append(n)
        return np.concatenate(ids), np.concatenate(length)

    def _learn(self, new: pa.Array) -> None:
        low = pc.if_else(pc.match_substring_regex(new, "[À-ÖØ-Þ]"), pc.utf8_lower(new), new)
        simple = pc.match_substring_regex(low, self.SIMPLE)
        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(low.filter(simple), pattern=f"([{MARK}]+|[0-9])", replacement=r" \1 "))
        flat = runs.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ids, n = self._pre_tokens(flat.filter(pa.array(real)))
        row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))[real]
        other = new.filter(pc.invert(simple))
        more, length = self._wholly(other.to_pylist())
        length = np.concatenate([np.bincount(row, n, len(runs)).astype(np.int64), length])
        self.known = pa.concat_arrays([self.known, new.filter(simple), other])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids, more])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the ends of the texts in them. Null texts count as empty."""
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: ascii_lower misreads slices that begin within an array
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            ids, length = self._wholly(texts.to_pylist())
            return ids, np.cumsum(length)
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        low = pc.ascii_lower(pc.if_else(pa.array(special), pa.scalar("", pa.large_string()), texts) if special.any() else texts)
        low = pc.replace_substring_regex(low, pattern=f"([{LETTER}0-9])([{MARK}]+)({SPACE}|$)", replacement=r"\1 \2\3")
        low = pc.replace_substring_regex(low, pattern=f"({SPACE}|^)([{MARK}]+)([{LETTER}0-9])", replacement=r"\1\2 \3")
        words = pc.ascii_split_whitespace(low)
        coded = words.flatten().dictionary_encode()
        if len(self.known) > self.words:
            self.forget()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        if found.null_count:
            self._learn(coded.dictionary.filter(pc.is_null(found)))
            found = pc.index_in(coded.dictionary, value_set=self.known)
        slots = found.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
        length = self.length[slots]
        ends = np.cumsum(length)
        at = np.repeat(self.start[slots] - (ends - length), length)
        ids = self.ids[at + np.arange(len(at))]
        ends = np.concatenate([[0], ends])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        if special.any():
            parts, begin, out = [], 0, []
            for i, end in enumerate(ends.tolist()):
                parts.append(np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if special[i] else ids[begin:end])
                out.append(len(parts[-1]))
                begin = end
            ids, ends = np.concatenate(parts), np.cumsum(out)
        return ids, ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges with at most so many bytes of text each, or one row."""
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    begin, total = 0, 0.0
    for i, n in enumerate(size.tolist()):
        if total + n > most and i > begin:
            yield begin, i
            begin, total = i, 0.0
        total += n
    if begin < len(size):
        yield begin, len(size)


def _pieces(path: Callable[[], str], capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path())
        for batch in batches:
            texts = batch.column("_text")
            for a, b in slices(texts):
                ids, ends = enc.encode(texts.slice(a, b - a))
                own = np.insert(ids, ends, end_id)  # each text's ids and the id that ends it
                ends = ends + np.arange(1, len(ends) + 1)
                begins = np.concatenate([[0], ends[:-1]])
                n = -(-(ends - begins) // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begins)[row] - start)
                raw = own.astype("<u4").tobytes()
                at = (begins[row] + start).tolist()
                crc = [zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k in zip(at, length.tolist(), strict=True)]
                out = [batch.column("_id").slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([own[x : x + k].astype(np.int32) for x, k in zip(at, length.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                pa.default_memory_pool().release_unused()  # or an idle worker keeps it while others work beside it
        enc.forget()  # likewise

    return run


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and `end_id`, cut every `capacity` ids.

    `path` is the vocabulary file's on the executors; by default each takes that of its installed package.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return src.mapInArrow(_pieces((lambda: path) if path else vocabulary, capacity, end_id, with_ids), schema).withColumnRenamed("_id", id_col)


def classes(capacity: int, least: int = LEAST_CLASS) -> list[tuple[int, int]]:
    """(top, below): lengths in (below, top] are a class, longest first; the last one has all from `least` down."""
    out, top = [], capacity
    while top > least:
        out.append((top, top // 2))
        top //= 2
    return [*out, (top, 0)]


def successor_sweep(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, slots) that match and (pieces, slots) that are left, as row numbers, from rows sorted by size, pieces (0) before slots (1) of their size.

    Each slot takes the last piece before it that has none. Runs of pieces and of slots are taken at once: there are at most two a size.
    """
    edge = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)]]).tolist()
    open_: list[tuple[int, int]] = []
    pieces, slots, alone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a == b:
            continue
        if kind[a] == 0:
            open_.append((a, b))
            continue
        while a < b and open_:
            first, last = open_.pop()
            n = min(last - first, b - a)
            pieces.append(np.arange(last - 1, last - n - 1, -1))
            slots.append(np.arange(a, a + n))
            a += n
            if last - n > first:
                open_.append((first, last - n))
        alone.append(np.arange(a, b))
    return np.concatenate(pieces), np.concatenate(slots), np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in open_)]), np.concatenate(alone)


SWEPT = "uid long, sequence long, length int, pid int, at long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches have uid and sequence; a piece or slot that is left has one of them, and its number among the partition's of its kind.

    Three rows with neither say how many pieces (length 0) and slots (1) are left and how many match (2).
    """
    pid, held = TaskContext.get().partitionId(), list(batches)
    size, kind, id_ = (np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy(zero_copy_only=False) for b in held)]) for c in ("size", "kind", "id"))
    pieces, slots, no_slot, no_piece = successor_sweep(kind)
    n, a, b = len(pieces), len(no_slot), len(no_piece)
    none = lambda k: pa.nulls(k, pa.int64())
    columns = [
        pa.concat_arrays([pa.array(id_[pieces], pa.int64()), pa.array(id_[no_slot], pa.int64()), none(b)]),
        pa.concat_arrays([pa.array(id_[slots], pa.int64()), none(a), pa.array(id_[no_piece], pa.int64())]),
        pa.array(np.concatenate([size[pieces], size[no_slot], np.zeros(b, np.int64)]), pa.int32()),
        pa.array(np.full(n + a + b, pid, np.int32)),
        pa.array(np.concatenate([np.zeros(n, np.int64), np.arange(a), np.arange(b)])),
    ]
    names = ["uid", "sequence", "length", "pid", "at"]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for k in range(0, len(whole), 50_000):
        yield whole.slice(k, 50_000)
    if len(whole):
        yield pa.RecordBatch.from_arrays([none(3), none(3), pa.array([0, 1, 2], pa.int32()), pa.array(np.full(3, pid, np.int32)), pa.array([a, b, n], pa.int64())], names=names)


def sweep_on(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The sweep over what partitions left, (pid, pieces, slots) in order: (piece pid, first, slot pid, first, how many, number of the first match).

    Pieces of a span match in falling order, slots in rising order. There are at most two spans a partition.
    """
    open_: list[tuple[int, int, int]] = []
    spans, match = [], 0
    for pid, pieces, slots in left:
        at = 0
        while at < slots and open_:
            q, first, last = open_.pop()
            n = min(last - first, slots - at)
            spans.append((q, last - n, pid, at, n, match))
            match, at = match + n, at + n
            if last - n > first:
                open_.append((q, first, last - n))
        if pieces:
            open_.append((pid, 0, pieces))
    return spans


def _parts(rows: int) -> int:
    return 1 + rows // TASK_ROWS


def _slots(gaps: DataFrame, sizes: dict[int, int], top: int, below: int, pieces: int) -> tuple[DataFrame, int]:
    """(size, kind, id) of the slots that gaps offer, smallest gaps first and no more than about the pieces need, and about how many.

    `sizes` counts gaps. All slots of length `top` hold any piece of the class, so gaps beyond those that offer enough of them are not asked; those of the size
    at which it is enough share what is still wanted. There are at most as many slots as pieces, and two a gap.
    """
    wanted, most, share, n = pieces, 0, 0, 0
    for gap in sorted(g for g in sizes if g > below):
        each, most, share = gap // top, gap, gap // top
        n += sizes[gap] * (each + 1)
        if each and wanted <= sizes[gap] * each:
            share = -(-wanted // sizes[gap])
            break
        wanted -= sizes[gap] * each
    asked = gaps.where((F.col("gap") > below) & (F.col("gap") <= most))
    full = F.floor(F.col("gap") / top).cast("int")
    full = F.when(F.col("gap") == most, F.least(full, F.lit(share))).otherwise(full)
    rest = F.when(F.col("gap") % top > below, F.array((F.col("gap") % top).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    sizes_ = F.concat(F.array_repeat(F.lit(top), full), rest)
    return asked.select(F.explode(sizes_).alias("size"), F.lit(1).alias("kind"), F.col("sequence").alias("id")), n


def _match(pieces: DataFrame, n_pieces: int, slots: DataFrame, n_slots: int) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Matches (uid, sequence, length) of a round, the pieces (uid, length) that are left, and how many match."""
    parts = _parts(n_pieces + n_slots)
    both = pieces.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("uid").alias("id")).unionAll(slots)
    ordered = both.repartitionByRange(parts, "size", "kind", "id").sortWithinPartitions("size", "kind", "id")
    swept = cut(ordered.mapInArrow(_sweep, SWEPT))
    piece, slot = F.col("uid").isNotNull(), F.col("sequence").isNotNull()
    found, one, other = piece & slot, piece & ~slot, ~piece & slot
    left: dict[int, list[int]] = {}
    for r in swept.where(~piece & ~slot).collect():  # three rows a partition
        left.setdefault(r.pid, [0, 0, 0])[r.length] = r["at"]
    spans = sweep_on([(pid, a, b) for pid, (a, b, _) in sorted(left.items())])
    n = sum(x[2] for x in left.values())
    matched = [swept.where(found).select("uid", "sequence", "length")]
    open_ = swept.where(one).select("uid", "length", "pid", "at")
    if not spans:
        return matched, open_.select("uid", "length"), n
    table_ = F.broadcast(swept.sparkSession.createDataFrame(spans, "p int, p_at long, s int, s_at long, n long, match long"))  # at most two rows a partition
    mine = open_.join(table_, (F.col("pid") == F.col("p")) & (F.col("at") >= F.col("p_at")) & (F.col("at") < F.col("p_at") + F.col("n")), "left")
    mine = mine.select("uid", "length", (F.col("match") + F.col("p_at") + F.col("n") - 1 - F.col("at")).alias("m"))
    theirs = swept.where(other).join(table_, (F.col("pid") == F.col("s")) & (F.col("at") >= F.col("s_at")) & (F.col("at") < F.col("s_at") + F.col("n")))
    theirs = theirs.select(F.col("sequence"), (F.col("match") + F.col("at") - F.col("s_at")).alias("m"))
    more = sum(x[4] for x in spans)
    matched.append(cut(mine.where("m is not null").join(theirs, "m").select("uid", "sequence", "length")))
    return matched, mine.where("m is null").select("uid", "length"), n + more


def _rank(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the partition, how many such pieces (q) go into a sequence, and each row's rank among its rows of that number; rows come longest first.

        A row without uid for each q has their number as its rank.
        """
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        counts: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            q = capacity // batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.concatenate([[True], q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            rank[q == q[0]] += seen if q[0] == last else 0
            last, seen = q[-1], int(rank[-1]) + 1
            for x, k in zip(*np.unique(q, return_counts=True), strict=True):
                counts[int(x)] = counts.get(int(x), 0) + int(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(q), pid, np.int32)), pa.array(q), pa.array(rank)], names=["uid", "length", "pid", "q", "rank"])
        k = len(counts)
        if k:
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(np.full(k, pid, np.int32)), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["uid", "length", "pid", "q", "rank"])

    return run


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The sequence, from 0, of each piece, by sequential best fit over pieces in the order given (longest first)."""
    gaps: list[tuple[int, int]] = []  # sorted
    out, used = [], 0
    for n in lengths:
        k = bisect_left(gaps, (n, -1))
        if k < len(gaps):
            gap, sequence = gaps.pop(k)
        else:
            gap, sequence, used = capacity, used, used + 1
        if gap > n:
            insort(gaps, (gap - n, sequence))
        out.append(sequence)
    return out


def _pack_rest(first: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema({"uid": pa.int64(), "length": pa.int32()})).sort_by([("length", "descending"), ("uid", "ascending")])
        sequence = best_fit_decreasing(rows["length"].to_pylist(), capacity)
        yield from rows.add_column(1, "sequence", pa.array([first + s for s in sequence], pa.int64())).to_batches()

    return run


def _open(pieces: DataFrame, n_pieces: int, first: int, capacity: int) -> tuple[list[DataFrame], int]:
    """Places (uid, sequence, length) of pieces in new sequences, numbered from `first`, and the next number."""
    ordered = pieces.repartitionByRange(_parts(n_pieces), F.col("length").desc(), "uid").sortWithinPartitions(F.col("length").desc(), "uid")
    ranked = cut(ordered.mapInArrow(_rank(capacity), "uid long, length int, pid int, q long, rank long"))
    counts = sorted((r.q, r.pid, r["rank"]) for r in ranked.where("uid is null").collect())  # at most partitions + the class's lengths
    before: dict[int, int] = {}
    rows = []
    for q, pid, n in counts:
        rows.append((q, pid, before.get(q, 0)))
        before[q] = before.get(q, 0) + n
    starts, full = {}, first
    for q in sorted(before):
        starts[q] = full
        full += before[q] // q
    known = [(q, pid, b, starts[q], before[q] // q * q) for q, pid, b in rows]
    table_ = F.broadcast(ranked.sparkSession.createDataFrame(known, "q long, pid int, before long, start long, whole long"))
    placed = ranked.where("uid is not null").join(table_, ["q", "pid"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = [placed.where("rank < whole").select("uid", (F.col("start") + F.floor(F.col("rank") / F.col("q"))).alias("sequence"), "length")]
    if any(n % q for q, n in before.items()):
        rest = cut(placed.where("rank >= whole").select("uid", "length").repartition(1).mapInArrow(_pack_rest(full, capacity), "uid long, sequence long, length int"))
        out.append(rest)
        full = rest.agg(F.max("sequence")).first()[0] + 1
    return out, full


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY, least_class: int = LEAST_CLASS, rounds: list[int] | None = None) -> DataFrame:
    """(uid, sequence, length) for each piece (uid, length), by rounds of sweeps. `uid` is unique; numbers of rounds of the classes are appended to `rounds`."""
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in lengths):
        raise ValueError(f"a piece of length {min(lengths)} or {max(lengths)} doesn't go into {capacity}")
    places: list[DataFrame] = []
    gaps: DataFrame | None = None
    used = 0
    for top, below in classes(capacity, least_class):
        n_left = sum(n for x, n in lengths.items() if below < x <= top)
        if not n_left:
            continue
        least = min(x for x in lengths if x <= top)
        left = pieces.where((F.col("length") > below) & (F.col("length") <= top)).select("uid", "length")
        new: list[DataFrame] = []
        done = 0

        def updated(gaps: DataFrame | None, new: list[DataFrame], first_new: int) -> DataFrame:
            """One aggregate over what is there and what is taken; sequences from `first_new` on begin with `capacity`."""
            taken = _union(new).select("sequence", (-F.col("length")).cast("long").alias("x"))
            both = taken if gaps is None else gaps.select("sequence", F.col("gap").cast("long").alias("x")).unionAll(taken)
            left_over = F.sum("x") + F.when(F.col("sequence") >= first_new, capacity).otherwise(0)
            return cut(both.groupBy("sequence").agg(left_over.cast("int").alias("gap")).where(F.col("gap") >= least))

        while n_left and gaps is not None:
            sizes = {r.gap: r.n for r in gaps.groupBy("gap").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
            slots, n_slots = _slots(gaps, sizes, top, below, n_left)
            if not n_slots:
                break
            new, rest, found = _match(left, n_left, slots, n_slots)
            done += 1
            if not found:
                break
            places += new
            n_left, left = n_left - found, rest
            gaps = updated(gaps, new, used)
        if rounds is not None:
            rounds.append(done)
        if n_left:
            first_new = used
            new, used = _open(left, n_left, used, capacity)
            places += new
            gaps = updated(gaps, new, first_new)
    if not places:
        return pieces.select("uid", F.lit(0).cast("long").alias("sequence"), "length").limit(0)
    return _union(places).coalesce(max(2 * pieces.sparkSession.sparkContext.defaultParallelism, _parts(sum(lengths.values()))))  # many parts, most of them small


def pack(pieces: DataFrame, capacity: int = CAPACITY, least_class: int = LEAST_CLASS, rounds: list[int] | None = None) -> DataFrame:
    """`pieces` with (sequence_id, offset): sequences of at most `capacity`, by bulk-synchronous best fit.

    `pieces.length` is from 1 to `capacity`; `sequence_id`, `offset` and `uid` are not to be among its columns. Equal rows have a place each.
    An empty table gives an empty result.
    """
    rows = cut(pieces.withColumn("uid", F.monotonically_increasing_id()))
    places = place(rows.select("uid", F.col("length").cast("int").alias("length")), capacity, least_class, rounds)
    in_order = Window.partitionBy("sequence").orderBy(F.col("length").desc(), "uid")  # at most `capacity` rows a sequence
    offset = F.sum("length").over(in_order) - F.col("length")
    at = places.select("uid", F.col("sequence").alias("sequence_id"), offset.alias("offset"))
    return rows.join(at, "uid").drop("uid")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of `docs`.

    A null or empty text is the end id alone. Longer texts than a sequence are cut into full pieces and a rest; others stay whole.
    Null and repeated ids are carried along; rows that repeat are packed each. Other columns are not touched. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pack(tokenize_pieces(src, path=path, capacity=capacity, end_id=end_id), capacity).withColumnRenamed("doc_id", id_col)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places. Null texts are the end id alone; rows that repeat are packed each."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
