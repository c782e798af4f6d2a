"""SimHash fingerprints of word shingles and their near-duplicate groups, by anchor-point covering.

Two 64-bit fingerprints at most 3 bits apart differ by at most 1 bit in one of their 32-bit halves. Each half has a
covering code as its set of anchors: the perfect Hamming code of length 31 (covering radius 1), with the 32nd bit free.
A half is replicated to every anchor within covering radius + threshold = 2 bits, at most 17 of them. Two halves at most
1 bit apart therefore meet at the anchor that covers one of them, and no pair is missed. Fingerprints that meet are
compared in full.

What reaches an anchor are distinct fingerprints, so exact copies cost nothing; a group of near copies is searched
breadth first and gives as many links as it has members, never all its pairs. An anchor with more than `heavy`
fingerprints is split into pairs of blocks, which is exact, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.operators.components import star_edges
from quillgraph.plans.cut import cut

SHINGLE_WORDS = 3
HASH_SEED = 42
THRESHOLD = 3
#: Fingerprints at one anchor beyond which it is split into blocks of half as many.
HEAVY = 65_536
#: Hashes whose bits are counted at once.
VOTES = 65_536


def shingle_hashes(text: str | None, n: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of each run of `n` words, lower-cased in A-Z; of all words where there are fewer; nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII spaces, alone
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is in more than half the hashes; zero for none."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), VOTES):
        part = np.ascontiguousarray(hashes[k : k + VOTES], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in batch.column("_text")), np.uint64, batch.num_rows)
        rest = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps.view(np.int64))], names=[*rest, "_fp"])
        pa.default_memory_pool().release_unused()


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `_fp` (a signed long with the fingerprint's bits) for every row. A null text counts as empty."""
    src = docs.select(*(F.col(c) for c in keep), F.col(text).alias("_text"))
    schema = src.drop("_text").schema.add("_fp", "long")
    return src.mapInArrow(_fingerprints, schema)


def _half_masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the (31, 26) Hamming code, the masks that lead to all anchors within 2 bits, and how many.

    Bit i - 1 of a half has the number i, i = 1..31; the syndrome is the XOR of the numbers of its set bits.
    """
    bit = lambda i: np.uint32(1 << (i - 1)) if i else np.uint32(0)
    masks, n = np.zeros((32, 17), np.uint32), np.zeros(32, np.int64)
    for s in range(32):
        home = bit(s)
        found = [home, home | np.uint32(1 << 31)] + [bit(i) | bit(i ^ s) for i in range(1, 32) if s and i < (i ^ s)]
        masks[s, : len(found)], n[s] = found, len(found)
    return masks, n


MASKS, N_MASKS = _half_masks()
_NUMBERED = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within 2 bits of each 32-bit half."""
    half = half.astype(np.uint32)
    syndrome = np.zeros(len(half), np.int64)
    for k, numbered in enumerate(_NUMBERED):
        syndrome |= (np.bitwise_count(half & np.uint32(numbered)).astype(np.int64) & 1) << k
    n = N_MASKS[syndrome]
    row = np.repeat(np.arange(len(half)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, half[row] ^ MASKS[syndrome[row], at]


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 20_000):
            fp = whole.column("fp").slice(k, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                row, anchor = half_anchors(fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF))
                key = (anchor.astype(np.int64) << 1) | side
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])


def near_links(fp: np.ndarray, threshold: int = THRESHOLD, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what all pairs of `fp` within `threshold` bits connect: breadth first, one per member found."""
    left, found_a, found_b = fp.copy(), [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            ring, frontier = frontier, []
            for k in range(0, len(ring), chunk):
                part = ring[k : k + chunk]
                by = np.full(len(left), -1, np.int64)
                step = max(1, 4_000_000 // len(part))
                for j in range(0, len(left), step):
                    near = np.bitwise_count(part[:, None] ^ left[None, j : j + step]) <= threshold
                    hit = near.any(axis=0)
                    by[j : j + step][hit] = near[:, hit].argmax(axis=0)
                hit = by >= 0
                found_a.append(part[by[hit]])
                found_b.append(left[hit])
                frontier.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
            frontier = np.concatenate(frontier)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _small_links(key: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of equal keys, for short runs."""
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    at = np.arange(len(key))
    for d in range(1, len(key)):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= threshold]
        a.append(fp[hit])
        b.append(fp[hit + d])
    return np.concatenate(a), np.concatenate(b)


SHORT = 12


def _compare(threshold: int):
    """Links among the fingerprints of each anchor; rows come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.empty((0, 2), np.int64)
        fp = np.empty(0, np.uint64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            if len(fp) < 2:
                return None
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            run_of = np.cumsum(new) - 1
            size = np.bincount(run_of)
            in_run = size[run_of]
            few = (in_run > 1) & (in_run <= SHORT)
            a, b = _small_links(run_of[few], fp[few], threshold)
            more = [(a, b)]
            start = np.flatnonzero(new)
            for r in np.flatnonzero(size > SHORT):
                more.append(near_links(np.unique(fp[start[r] : start[r] + size[r]]), threshold))
            a, b = (np.concatenate([x[i] for x in more]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"]) if len(a) else None

        for batch in batches:
            new_key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "pair")], axis=1)
            key = np.concatenate([key, new_key])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key) or (key[0] == key[-1]).all():
                continue  # the run goes on
            cut_at = len(key) - int(np.argmax((key[::-1] != key[-1]).any(axis=1)))
            if (out := links(key[:cut_at], fp[:cut_at])) is not None:
                yield out
            key, fp = key[cut_at:], fp[cut_at:]
        if (out := links(key, fp)) is not None:
            yield out

    return run


def hamming_links(fps: DataFrame, threshold: int = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """(src, dst) links among the distinct longs `fps.fp`, which connect exactly what pairs within `threshold` <= 3 bits connect."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves with at most one differing bit in one of them cover up to 3 bits")
    replicas = fps.mapInArrow(_replicas, "anchor long, fp long")  # made again for the count below: it is cheaper than keeping 34 rows each
    full = cut(replicas.groupBy("anchor").count().where(F.col("count") > heavy).repartition(1))  # few rows, mostly none: one file, not one a partition
    if full.isEmpty():
        rows = replicas.withColumn("pair", F.lit(0).cast("long"))
    else:
        n = F.ceil(F.col("count") / (heavy // 2)).cast("long")
        known = replicas.join(full, "anchor", "left").withColumn("n", F.coalesce(n, F.lit(1).cast("long")))
        own = F.pmod(F.xxhash64("fp"), F.col("n"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
        rows = known.withColumn("own", own).withColumn("other", other).select("anchor", "fp", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).alias("pair"))
    dealt = rows.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")
    return dealt.mapInArrow(_compare(threshold), "src long, dst long")


def near_groups(prints: DataFrame, id_col: str = "doc_id", threshold: int = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """`id_col`, `_fp`, `label`, `component_id` for every row of `prints`: the smallest id reachable over links; null ids are never smallest.

    Repeated rows keep a row each. `component_id` is null only if no row of the component has an id.
    """
    each = cut(prints.groupBy("_fp").agg(F.min(id_col).alias("least")))
    links = cut(hamming_links(each.select(F.col("_fp").alias("fp")), threshold, heavy))  # or a task of the next step would need two Python workers, which stay
    stars = star_edges(links)
    labelled = each.join(stars, F.col("_fp") == F.col("u"), "left").select("_fp", "least", F.coalesce("v", "_fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = labelled.join(smallest, "label").select(F.col("_fp").alias("_f"), "label", "component_id")
    return prints.join(known, F.col("_fp") == F.col("_f"), "left").drop("_f")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`.

    Null and wordless texts have fingerprint zero and link like any other. Texts are read whole. Ids may be null or
    repeated: each row is returned, and null ids are never a component's id. Other columns are not touched. An empty
    table gives an empty result.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    found = near_groups(prints, threshold=threshold)
    return found.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, one of each group of near duplicates: that with the smallest id, null ids last.

    Of rows of a group that share this id, that with the least hash of its text stays (null last), and of rows that share that, too, the first by all columns as strings.
    Rows with one id and unlike texts are in different groups, each of which keeps one. All columns are kept, whatever their names; an empty table gives an empty result.
    Only ids and hashes are grouped; rows with texts move once, to meet the winners.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    id_, text = F.col(at[id_col]), F.col(at[text_col])
    hashed = F.coalesce(F.md5(text.cast("binary")), F.lit("z"))
    rows = rows.withColumn("_key", F.concat(hashed, F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.lit("n"))))
    prints = cut(fingerprints(rows.select(id_.alias("doc_id"), "_key", text.alias("text")), keep=("doc_id", "_key")))
    groups = near_groups(prints, threshold=threshold)
    won = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key")).alias("w")).select("w._key")
    kept = rows.join(won, "_key", "left_semi")
    first = Window.partitionBy("_key").orderBy(*(F.col(n).cast("string") for n in names))
    return kept.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*names).toDF(*docs.columns)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents. A null text has fingerprint zero."""
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
ORACLES: dict[str, str] = {}
