"""Quality of documents by gradient-boosted trees over their statistics.

The statistics are Column expressions over whole texts. Trees are grown level by level on histograms of binned statistics
(logistic loss, second order) from at most MAX_LABELS labelled documents (a fixed sample by hash, one text of each). They
are kept as flat arrays: node i of a complete tree has children 2i + 1 and 2i + 2, so all rows walk a tree together.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; a text of any length is measured
whole; a null doc_id is not held out and not learnt from; repeated labels of a document count as their maximum; of several
texts of a labelled document one is learnt from; without both labels every score is the share of label 1 (0.5 without any);
repeated rows are each scored; ties of the sample go by doc_id, ties of splits by the first statistic; other columns of any
name play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, UPPER, whole
from attesta.llm.quality_rules import measured
from attesta.llm.toxicity import fold, labelled

FOLDS, HELD_OUT = 4, 2
MAX_LABELS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, MIN_HESSIAN = 100, 4, 64, 0.12, 1.0, 1.0
NAMES = (
    "chars words word_length symbols pipes upper digits bangs stops commas lines dup_lines repeat distinct longest short line_chars other_marks"
).split()


def statistics(docs: DataFrame) -> DataFrame:
    """Adds the statistics NAMES (double): logarithms of sizes, and shares of characters, words or lines."""
    df = measured(docs.withColumn("text", whole("text")), keep="_v")
    # what is counted is none of these, so the counts go over the little that is left of a text
    df = df.withColumn("_rest", F.translate("text", LOWER + " ", ""))
    count = lambda chars: F.length("_rest") - F.length(F.translate("_rest", chars, ""))
    n, w, k = F.length("text"), F.col("n_words"), F.size(F.split("text", "\n", -1))
    df = df.withColumns({"_n": n.cast("double"), "_k": k.cast("double"), "_lens": F.transform("_v", F.length)})
    chars, words, lines = F.greatest(F.col("_n"), F.lit(1.0)), F.greatest(w.cast("double"), F.lit(1.0)), F.col("_k")
    share = {
        "chars": F.log1p("_n"), "words": F.log1p(w), "word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "pipes": count("|") / words,
        "upper": count(UPPER) / chars, "digits": count("0123456789") / chars, "bangs": count("!") / words, "stops": count(".") / words, "commas": count(",") / words,
        "lines": lines / words, "dup_lines": F.col("n_dup_lines") / lines, "repeat": F.col("n_repeat_words") / words, "distinct": F.size(F.array_distinct("_v")) / words,
        "longest": F.coalesce(F.array_max("_lens"), F.lit(0)).cast("double"), "short": F.size(F.filter("_lens", lambda x: x <= 3)) / words,
        "line_chars": F.log1p(F.col("_n") / lines), "other_marks": count("()[]{}\"'/\\@=_~^`:;?") / words,
    }
    return df.withColumns({f"s_{c}": share[c].cast("double") for c in NAMES})


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees from statistics x and labels y (0 or 1)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    flat = binned + np.arange(width) * BINS
    margin, out = np.full(n, base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, size = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            hist = lambda v: np.bincount(where, np.repeat(v, width), size * width * BINS).reshape(size, width, BINS).cumsum(axis=2)  # noqa: B023, E731
            left_g, left_h = hist(g), hist(h)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < MIN_HESSIAN) | (right_h < MIN_HESSIAN)] = -1
            best = gain.reshape(size, -1).argmax(axis=1)
            for k in range(size):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + RIDGE)
        margin += leaf[leaf_of]
        for kept, new in zip(out, (feature, threshold, leaf), strict=True):
            kept.append(new)
    return Trees(base, *(np.array(a) for a in out))


def learn(docs: DataFrame, labels: DataFrame) -> Trees:
    train = labelled(docs.select("doc_id", "text"), labels, "quality", FOLDS, HELD_OUT, MAX_LABELS)
    rows = statistics(train).select("y", *(f"s_{c}" for c in NAMES)).toPandas()
    return grow(rows[[f"s_{c}" for c in NAMES]].to_numpy(dtype=float), (rows["y"].to_numpy() > 0).astype(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of docs."""
    trees = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"s_{c}").to_numpy(zero_copy_only=False) for c in NAMES])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(trees.scores(x), pa.float64())})

    scored = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *(f"s_{c}" for c in NAMES)).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
