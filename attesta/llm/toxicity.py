"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed. Those of targets, negation and reported speech follow the words of a clause and multiply
what is marked in their reach. Those of insults and threats pick one marked word of the clause: they end at once with the
weight that it has without a target (a threat has none), and if no target came before, they wait for one that follows within reach
and then add the difference to the weight with a target. A clause's score is the sum over all paths of the composition
from its start to its end, so a target counts on either side, and each mark is weighed on its own. The composition is a
pair of matrices for each word class, and a clause is one pass of vector times matrix; clauses without a mark are skipped.

Insults are seed words and word stems learnt from the labels: stems that many toxic documents have and hardly any clean
one. A logistic function of the scores of a document's clauses gives the result; it is fitted on at most MAX_LABELS
labelled documents (a fixed sample by hash, one text of each). The lexicon has every stem of the sample that passes, so
it is bounded by the sample and does not grow with the corpus.

Defined cases: a null or empty text scores as a text without a matched clause; a text of any length is scored whole; a
null doc_id is not held out and not learnt from; repeated labels of a document count as their maximum; of several texts
of a labelled document one is learnt from; without both labels the seeds and fixed coefficients apply; repeated rows are
each scored; ties of the sample go by doc_id; other columns of any name play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import whole, written

FOLDS, HELD_OUT = 5, 0
#: Labelled documents to learn from at most.
MAX_LABELS = 20_000
#: A learnt stem is in so many toxic documents, and its share of them so many times its share of clean ones.
MIN_TOXIC, MIN_ODDS = 3, 20.0
STEMS = (4, 5, 6)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Seeds of the grammar.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers trash scum worthless pathetic disgusting clown imbecile dumbass vermin abschaum versager dummkopf crétin ordure estúpido imbécil",
    THREAT: "kill hurt destroy strangle stab shoot beat töten tuer matar",
    TARGET: "you your yours u he she him her they them these those du dich euch ihr tu toi vous usted ustedes",
    NEGATION: "not never no nobody isn't aren't don't nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says reported reportedly quoted quote wrote claimed according sagte schrieb dit écrit dijo escribió",
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
FEATURES = 5
#: Tokens between a target and what it belongs to at most, counting the latter.
REACH = 5


class Context:
    """A transducer that counts tokens since its trigger and multiplies the marks within reach; open to the clause's end if it latches."""

    def __init__(self, trigger: int, reach: int, factors: dict[int, float] | None = None, latch: bool = False):
        self.trigger, self.reach, self.factors, self.latch, self.states = trigger, reach, factors or {}, latch, reach + 1

    def step(self, state: int, cls: int) -> int:
        if cls == END:
            return 0
        return self.reach if cls == self.trigger else state if self.latch else max(0, state - 1)

    def factor(self, state: int, cls: int) -> float:
        return self.factors.get(cls, 1.0) if state else 1.0


class Mark:
    """A transducer that picks one word of its class: its weight without and with a target within reach."""

    def __init__(self, cls: int, far: float, near: float):
        self.cls, self.far, self.near = cls, far, near


def compose(target: Context, others: list[Context], marks: list[Mark]) -> tuple[np.ndarray, np.ndarray]:
    """(stay, pick): by word class, the matrices over composed states of reading a word, and of picking it as the path's mark.

    States: every combination of the contexts, no mark picked yet; for each mark the tokens that it still waits; the end.
    """
    contexts = [target, *others]
    sizes = [c.states for c in contexts]
    open_states = int(np.prod(sizes))
    waiting = {m.cls: open_states + i * target.reach - 1 for i, m in enumerate(marks)}
    end = open_states + len(marks) * target.reach
    stay, pick = np.zeros((END + 1, end + 1, end + 1)), np.zeros((END + 1, end + 1, end + 1))
    for cls in range(END + 1):
        stay[cls, end, end] = 1
        for first in waiting.values():
            for left in range(1, target.reach + 1):
                if cls == target.trigger:
                    stay[cls, first + left, end] = 1
                elif left > 1 and cls != END:
                    stay[cls, first + left, first + left - 1] = 1
        for state in range(open_states):
            own = np.unravel_index(state, sizes)
            after = np.ravel_multi_index([c.step(int(s), cls) for c, s in zip(contexts, own, strict=True)], sizes)
            stay[cls, state, after] = 1
            for m in marks:
                if m.cls == cls:
                    factor = float(np.prod([c.factor(int(s), cls) for c, s in zip(others, own[1:], strict=True)]))
                    pick[cls, state, end] += factor * (m.near if own[0] else m.far)
                    if not own[0]:
                        pick[cls, state, waiting[cls] + target.reach] += factor * (m.near - m.far)
    return stay, pick


STAY, PICK = compose(
    Context(TARGET, REACH),
    [Context(NEGATION, 3, {INSULT: 0.5, THREAT: 0.25}), Context(REPORT, 1, {INSULT: 0.6, THREAT: 0.4}, latch=True)],
    [Mark(INSULT, 1.0, 1.25), Mark(THREAT, 0.0, 1.0)],
)
#: Runs of other words: beyond the longest reach nothing changes any more.
RUNS = [np.linalg.matrix_power(STAY[OTHER], n) for n in range(REACH + 2)]


def stems_of(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


class Lexicon(dict):
    """word -> class, filled as words come up; .weight has the weights of insults."""

    LIMIT = 500_000

    def __init__(self, learnt: dict[str, float]):
        super().__init__()
        self.learnt, self.weight = learnt, {}
        self.fixed = {w: c for c, ws in SEEDS.items() for w in ws.split()} | dict.fromkeys(".!?;\n", END)
        self.update(self.fixed)

    def trim(self) -> None:
        """Forget the words beyond the limit; between texts only, as a text's weights are read after its classes."""
        if len(self) > self.LIMIT:
            self.clear()
            self.update(self.fixed)
            self.weight.clear()

    def __missing__(self, word: str) -> int:
        found = max((self.learnt.get(s, 0.0) for s in stems_of(word)), default=0.0)
        self[word] = INSULT if found else OTHER
        if found:
            self.weight[word] = found
        return self[word]


def clause_score(classes: list[int], weights: list[float]) -> float:
    """The sum over all paths through a clause; weights count for insults alone."""
    state, run = np.zeros(len(STAY[OTHER])), 0
    state[0] = 1
    for cls, weight in zip(classes, weights, strict=True):
        if cls == OTHER:
            run += 1
            continue
        if run:
            state, run = state @ RUNS[min(run, len(RUNS) - 1)], 0
        after = state @ STAY[cls]
        if cls in (INSULT, THREAT):
            after += weight * (state @ PICK[cls])
        state = after
    return float(state[-1])


def clause_scores(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """The scores of the clauses that have any, in order, and the number of clauses with a word."""
    lexicon.trim()
    words = TOKEN.findall(text.lower())
    classes = np.frombuffer(bytes(map(lexicon.__getitem__, words)), dtype=np.uint8)
    ends = np.flatnonzero(np.append(classes, END) == END)
    starts = np.append(0, ends[:-1] + 1)
    marks = np.flatnonzero((classes == INSULT) | (classes == THREAT))
    out = []
    for k in np.unique(np.searchsorted(ends, marks)).tolist():
        a, b = int(starts[k]), int(ends[k])
        own = classes[a:b].tolist()
        score = clause_score(own, [lexicon.weight.get(w, 1.0) if c == INSULT else 1.0 for w, c in zip(words[a:b], own, strict=True)])
        if score > 0:
            out.append(score)
    return out, int((ends > starts).sum())


def clause_features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """log of the total, largest score, log of matched clauses, log of the total per 100 clauses, log of the total of the three largest."""
    scores, clauses = clause_scores(text, lexicon)
    if not scores:
        return (0.0,) * FEATURES
    total = sum(scores)
    return np.log1p(total), max(scores), np.log1p(len(scores)), np.log1p(100 * total / (clauses + 5)), np.log1p(sum(sorted(scores)[-3:]))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """doc_id, text, y of at most `limit` labelled documents outside the held-out fold: those of the smallest hashes of doc_id, one text of each."""
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = written(known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")), "labels")
    # hashes are even, so the smallest `limit` of them lie below this; tasks send little more than that to be ordered
    share = min(1.0, (1.2 * limit + 100) / max(1, known.count()))
    below = F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))
    sample = written(known.where(F.col("h") <= below).orderBy("h", "doc_id").limit(limit).select("doc_id", "y"), "sample")
    # at most `limit` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("y").alias("y"))
    return one.select("doc_id", "t.text", "y")


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_pydict({"stem": pa.array(names, pa.string()), "clean": pa.array([counts[0][s] for s in names], pa.int64()), "toxic": pa.array([counts[1][s] for s in names], pa.int64())})

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            seen = {w for w in TOKEN.findall((text or "").lower()) if w[0].isalpha()}
            counts[1 if y else 0].update({s for w in seen for s in stems_of(w)})
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield out()
            counts[0].clear()
            counts[1].clear()
    yield out()


def learn_stems(train: DataFrame) -> dict[str, float]:
    """stem -> weight up to 1; counts cover every training row, and every stem that passes is kept."""
    sizes = {int(r["y"] > 0): r["count"] for r in train.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    counts = train.select("text", "y").mapInArrow(_stem_counts, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    kept = counts.where((F.col("toxic") >= MIN_TOXIC) & (odds >= MIN_ODDS)).select("stem", F.log(odds).alias("lo"))
    return {r["stem"]: min(1.0, r["lo"] / 6) for r in kept.orderBy("stem").collect()}


def _features(learnt: Broadcast, extra: str, kind: pa.DataType):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learnt.value)
        for batch in batches:
            found = [clause_features(t or "", lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({extra: batch.column(extra).cast(kind)} | {f"f{k}": pa.array([float(r[k]) for r in found], pa.float64()) for k in range(FEATURES)})

    return run


FEATURE_DDL = ", ".join(f"f{k} double" for k in range(FEATURES))
#: For tables without both labels: intercept, then a weight for each feature.
FALLBACK = np.array([-3.0, 1.0, 1.0, 0.5, 0.5, 1.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    train = written(labelled(docs.select("doc_id", "text"), labels, "toxic", FOLDS, HELD_OUT, MAX_LABELS).select("text", F.col("y").cast("int").alias("y")), "train")
    stems = learn_stems(train)
    # as large as the lexicon, which the sample bounds
    rows = train.mapInArrow(_features(docs.sparkSession.sparkContext.broadcast(stems), "y", pa.int32()), f"y int, {FEATURE_DDL}").toPandas()
    y = (rows["y"].to_numpy() > 0).astype(float) if len(rows) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return stems, FALLBACK
    return stems, fit_logistic(rows[[f"f{k}" for k in range(FEATURES)]].to_numpy(), y)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and clause_score (the largest), one row for each row of docs."""
    stems, w = learn(docs, labels)
    scored = docs.select("doc_id", whole("text").alias("text")).mapInArrow(_features(docs.sparkSession.sparkContext.broadcast(stems), "doc_id", pa.int64()), f"doc_id long, {FEATURE_DDL}")
    logit = sum((F.lit(float(w[k + 1])) * F.col(f"f{k}") for k in range(FEATURES)), F.lit(float(w[0])))
    out = scored.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("f1").alias("clause_score"))
