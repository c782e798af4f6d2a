"""A quality classifier: histogram gradient-boosted trees over statistics of a text.

Every document is reduced to a short vector of statistics where it lies. The trees are grown on the driver, on at most
`max_train` labelled rows (a bounded sample by hash, chosen the same way at every size), over histograms of binned
features. The forest is flattened into arrays, features, thresholds and leaf values of complete trees, and a batch of
documents goes down all trees at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillgraph.llm.tables import table
from quillgraph.plans.cut import cut

MAX_TRAIN = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "mean_word", "std_word", "longest_word", "upper", "digits", "punctuation", "symbols", "spaces", "beyond_ascii", "pipes", "bangs",
    "distinct_words", "top_word", "marked_words", "log_lines", "mean_line", "repeated_lines", "repeated_bytes", "entropy", "repeated_triples",
)


def _classes() -> np.ndarray:
    """Membership of each byte in: upper case, digits, punctuation, symbols, white space, beyond ASCII, |, !."""
    m = np.zeros((256, 8))
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b" \t\n\r\x0b\x0c")):
        m[list(chars), k] = 1
    m[128:, 5] = 1
    m[ord("|"), 6] = m[ord("!"), 7] = 1
    return m


CLASSES = _classes()


def statistics(text: str | None) -> np.ndarray:
    """The features of a text; zeros where it has no bytes or, for those of words and lines, none of these."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    some = share[share > 0]
    out[0] = np.log1p(len(raw))
    out[5:13] = share @ CLASSES
    out[20] = -(some * np.log2(some)).sum()
    words = raw.split()
    if words:
        size = np.fromiter(map(len, words), np.int64, len(words))
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        triples = set(zip(words, words[1:], words[2:], strict=False))
        n3 = max(len(words) - 2, 0)
        out[1:5] = np.log1p(len(words)), size.mean(), size.std(), np.log1p(size.max())
        out[13:16] = len(seen) / len(words), max(seen.values()) / len(words), CLASSES[last, 3].mean() + CLASSES[last, 7].mean()
        out[21] = 1 - len(triples) / n3 if n3 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if lines:
        kept = set(lines)
        out[16:20] = np.log1p(len(lines)), np.log1p(sum(map(len, lines)) / len(lines)), 1 - len(kept) / len(lines), 1 - sum(map(len, kept)) / sum(map(len, lines))
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([statistics(t.as_py()) for t in batch.column("_text")]).reshape(batch.num_rows, len(FEATURES))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(FEATURES)), pa.int32()), pa.array(values.ravel()))
        rest = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), flat], names=[*rest, "_features"])


def document_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `_features` for every row."""
    src = docs.select(*(F.col(c) for c in keep), F.col(text_col).alias("_text"))
    return src.mapInArrow(_statistics, src.drop("_text").schema.add("_features", ArrayType(DoubleType())))


@dataclass
class Forest:
    """Complete trees of one depth: node i has children 2 i + 1 and 2 i + 2, and goes right where feature > threshold."""

    feature: np.ndarray  # trees x (2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Boosted trees for logistic loss. Without rows of both labels, no trees: the base score alone (0.5 for no rows)."""
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # bin b: cuts[b - 1] < v <= cuts[b]
    n, d = x.shape
    margin = np.full(n, base)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for f in range(d):
                cell = at * bins + binned[:, f]
                gs, hs = (np.bincount(cell, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < least) | (ha - hs < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                b = gain.argmax(axis=1)
                better = gain[np.arange(width), b] > best
                best[better] = gain[np.arange(width), b][better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cuts[f][np.minimum(b, len(cuts[f]) - 1)][better]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[at]
        found.append((feature, threshold, leaf))
    return Forest(*(np.stack(v) for v in zip(*found, strict=True)), base)


def held_out(id_col: str | Column) -> Column:
    """Whether a row is not to be learnt from: crc32 of the id as text is divisible by 5. A null id counts as an empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_train: int = MAX_TRAIN, **how) -> Forest:
    """A forest from `stats` (id, _features) and labels 0 or 1, on at most `max_train` ids with the least hash.

    Held-out ids, null ids and null labels are not learnt from; an id with several labels takes the largest, one with several rows the least
    statistics.
    """
    known = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")).where(F.col("_i").isNotNull() & F.col("_y").isNotNull() & ~held_out("_i"))
    known = known.groupBy("_i").agg(F.max("_y").alias("_y"))
    ids = stats.select(F.col(id_col).alias("_i"), F.col("_features"))
    present = known.join(ids.select("_i").distinct(), "_i", "left_semi")
    sample = present.orderBy(F.xxhash64("_i"), "_i").limit(max_train)
    rows = ids.join(sample, "_i").groupBy("_i", "_y").agg(F.min("_features").alias("_f")).orderBy("_i").collect()
    x = np.array([r._f for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r._y for r in rows], float).clip(0, 1), **how)


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            scores = np.concatenate([forest.score(x[k : k + 2000]) for k in range(0, len(x), 2000)]) if len(x) else np.zeros(0)
            rest = [c for c in batch.schema.names if c != "_features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(scores)], names=[*rest, "_score"])

    return run


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """`stats` with `_score` for `_features`."""
    return stats.mapInArrow(_score(forest), stats.drop("_features").schema.add("_score", "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`.

    A null text scores as an empty one does. Equal texts have equal scores. Rows with null or repeated ids are each scored. Without usable labels all
    scores are 0.5. An empty table gives an empty result.
    """
    stats = cut(document_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    forest = train(stats, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality")), max_train=max_train)
    s = F.col("_score")
    return with_scores(stats, forest).select(F.col("doc_id").alias(id_col), held_out("doc_id").alias("held_out"), s.alias("score"), (s >= threshold).cast("int").alias("predicted"))


def _filter(forest: Forest, text: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(text)]).reshape(batch.num_rows, len(FEATURES))
            keep = np.concatenate([forest.score(x[k : k + 2000]) for k in range(0, len(x), 2000)] or [np.zeros(0)]) >= threshold
            yield batch.filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, with all their columns, in one narrow pass after training.

    Only labelled documents are read to train, so no statistics of the others are kept.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
    present = known.join(rows.select(F.col(at[id_col]).alias("doc_id")), "doc_id", "left_semi").select("doc_id").distinct()
    sample = cut(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    some = rows.select(F.col(at[id_col]).alias("doc_id"), F.col(at[text_col]).alias("text")).join(sample, "doc_id", "left_semi")
    forest = train(cut(document_statistics(some)), known, max_train=max_train)
    return rows.mapInArrow(_filter(forest, at[text_col], threshold), rows.schema).toDF(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels. A null text scores as an empty one."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
