"""Phrase collocation mining: contiguous phrases of two and three words that their words do not explain.

Texts are read once, in blocks. A block numbers its distinct words and holds its texts as those numbers, with 0 between
pieces; both are written. Words are counted over all blocks, and the frequent ones of each language get ids from 1 on: only they can
be in a phrase that is frequent itself. Each block gets the ids of its own words back by a join on (lang, word), so no task
holds the dictionary; words without an id break pieces as marks do.

Phrases are keys of fixed width, three ids of 32 bits behind one another, 0 where there is no third word. A block radix-sorts its keys (by
digits of 16 bits, the last first), counts them by run length, and writes them in compressed chunks. First keys of chunks, a sample of
SAMPLE at most that only balances the work, give the bounds of ranges; chunks are cut there, and each range is sorted and counted
once more over all blocks. So a frequent phrase is one key for each block, and a range holds about RANGE_KEYS keys however
keys are spread.

What is left has at least `least` occurrences each. Every cut of a candidate is a row that finds its two parts by joins on keys.

Arithmetic is exact: counts are 64-bit integers, scores are computed in decimals of 38 digits.

Defined cases: a null or empty text has no words; a null language is `und`, as a language of that name; doc_id plays no part and each
row counts, repeated ones too; a text of any length is one block at most and whole; ties of scores go by count, then by the bytes
of the phrase; other columns of any name play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import written

LEAST, TOP, WITHIN = 10, 2000, 50
SCALE = 1_000_000
#: Bytes of text that a block holds at most, unless a single text is longer; keys of a chunk and of a range; first keys that bounds are taken from.
BLOCK_BYTES, CHUNK_KEYS, RANGE_KEYS, SAMPLE = 6_000_000, 4096, 800_000, 50_000
#: Word numbers of a row: a Parquet page holds a hundred rows at least, so rows of megabytes make pages, and buffers, of hundreds.
PIECE = 16_384
#: A-Z lower; marks and line ends to \n, tabs to blanks.
_TEXT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BLOCKS = pa.schema([("block", pa.string()), ("lang", pa.string()), ("word", pa.binary()), ("no", pa.int32()), ("n", pa.int64()), ("codes", pa.binary())])
_CHUNKS = pa.schema([("first", pa.binary()), ("size", pa.int64()), ("blob", pa.binary())])
_RANGED = pa.schema([("range", pa.int64()), ("blob", pa.binary())])
_FOUND = pa.schema([("i1", pa.int64()), ("i2", pa.int64()), ("i3", pa.int64()), ("a", pa.int64())])


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, compressed: the bytes of each by place, the lowest first, as high ones are mostly 0."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _spread(blob: bytes, size: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    width = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=size * sum(width), codec="zstd", asbytes=True), dtype=np.uint8)
    ends = np.cumsum(width) * size
    return [np.ascontiguousarray(raw[e - w * size : e].reshape(w, size).T).view(k).ravel() for k, w, e in zip(kinds, width, ends.tolist(), strict=True)]


_KEY = ("<u8", "<u4", "<u4")


def _chunk(head: np.ndarray, tail: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys (head: two ids, tail: the third) with counts below 2**32, heads by their differences."""
    return len(head).to_bytes(4, "little") + _squeezed(np.diff(head, prepend=np.uint64(0)).astype("<u8"), tail.astype("<u4"), n.astype("<u4"))


def _keys(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, tail, n = _spread(blob[4:], int.from_bytes(blob[:4], "little"), _KEY)
    return np.cumsum(step, dtype=np.uint64), tail, n.astype(np.int64)


def radix_order(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The order of fixed-width keys, digit by digit from the last; digits that all keys share are passed over."""
    order = None
    for column, shifts in ((tail, (0, 16)), (head, (0, 16, 32, 48))):
        for shift in shifts:
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() == digit.max():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(head)) if order is None else order


def counted(head: np.ndarray, tail: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts: radix sort, then run lengths (sums of n, if given)."""
    if not len(head):
        return head, tail, np.zeros(0, dtype=np.int64)
    order = radix_order(head, tail)
    head, tail = head[order], tail[order]
    starts = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))))
    runs = np.diff(np.append(starts, len(head))) if n is None else np.add.reduceat(n[order], starts)
    return head[starts], tail[starts], runs


def _numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """lang, text (binary) -> for each block its texts as word numbers, and its words with their numbers and counts."""
    task, serial = TaskContext.get().partitionId(), 0
    codes: list[np.ndarray] = []
    words: list[tuple[str, bytes]] = []
    by_lang: dict[str, _Numbers] = {}
    size = 0

    def block() -> Iterator[pa.RecordBatch]:
        name, flat = f"{task}-{serial}", np.concatenate(codes)
        n = np.bincount(flat, minlength=len(words) + 1)[1:]
        for at in range(0, len(flat), PIECE):
            part = flat[at : at + PIECE]
            text = len(part).to_bytes(4, "little") + _squeezed(part.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([at // PIECE], pa.int32()), pa.nulls(1, pa.int64()), pa.array([text], pa.binary())], schema=_BLOCKS)
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            own = pa.array(range(at + 1, at + 1 + len(part)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(part)), pa.array([w[0] for w in part]), pa.array([w[1] for w in part], pa.binary()), own, pa.array(n[at : at + len(part)], pa.int64()), pa.nulls(len(part), pa.binary()),
            ], schema=_BLOCKS)

    for batch in batches:
        for lang, raw in zip(*batch.columns, strict=True):
            lang, text = lang.as_py(), raw.as_py()
            if codes and size + len(text) > most:
                yield from block()
                codes, words, by_lang, size, serial = [], [], {}, 0, serial + 1
            found: list[bytes] = []
            for piece in text.translate(_TEXT).split(b"\n"):
                found += piece.split()
                found.append(b"\n")
            if lang not in by_lang:
                by_lang[lang] = _Numbers(lang, words)
            codes.append(np.fromiter(map(by_lang[lang].__getitem__, found), dtype=np.int64, count=len(found)))
            size += len(text)
    if codes:
        yield from block()


class _Numbers(dict):
    """Numbers of a language's words in a block, given as words are met; the mark between pieces has 0."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b"\n": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = n = len(self.words)
        return n


def _phrases(texts: pa.Table, ids: pa.Table, chunk: int) -> pa.Table:
    """The phrases of a block, in chunks of sorted keys; texts: its pieces by no; ids: no, id of its frequent words."""
    out: list[tuple[bytes, int, bytes]] = []
    if texts.num_rows:
        pieces = texts.sort_by("no")["codes"].to_pylist()
        codes = np.concatenate([_spread(b[4:], int.from_bytes(b[:4], "little"), ("<u4",))[0] for b in pieces])
        table = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.uint64)
        table[ids["no"].to_numpy()] = ids["id"].to_numpy()
        seq = table[codes]
        two = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
        pair = (seq[two] << np.uint64(32)) | seq[two + 1]
        third = np.concatenate((seq, np.zeros(2, dtype=np.uint64)))[two + 2]
        more = third > 0
        head = np.concatenate((pair, pair[more]))
        tail = np.concatenate((np.zeros(len(pair), dtype=np.uint32), third[more].astype(np.uint32)))
        head, tail, n = counted(head, tail)
        for at in range(0, len(head), chunk):
            part = slice(at, at + chunk)
            out.append((_bound(head[at], tail[at]), len(head[part]), _chunk(head[part], tail[part], n[part])))
    return pa.table({f.name: pa.array([r[i] for r in out], f.type) for i, f in enumerate(_CHUNKS)}, schema=_CHUNKS)


def _bound(head: np.uint64, tail: np.uint32) -> bytes:
    """A key as bytes that sort as keys do."""
    return int(head).to_bytes(8, "big") + int(tail).to_bytes(4, "big")


def _cut(bounds: list[bytes]) -> Callable:
    """Chunks -> their parts by range; a range begins at its bound."""
    kind = np.dtype([("head", ">u8"), ("tail", ">u4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array([int.from_bytes(b, "big") for b in bounds], dtype=object)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                head, tail, n = _keys(blob)
                low, high = ((int(head[i]) << 32) | int(tail[i]) for i in (0, -1))
                a, b = int(np.searchsorted(first, low, side="right")), int(np.searchsorted(first, high, side="right"))
                ends = [0]
                keys = np.rec.fromarrays([head, tail], dtype=kind) if a < b else None
                for k in range(a, b):
                    ends.append(int(np.searchsorted(keys, np.array((int(first[k]) >> 32, int(first[k]) & 0xFFFFFFFF), dtype=kind))))
                ends.append(len(head))
                parts = [(a + i, _chunk(head[x:y], tail[x:y], n[x:y])) for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if x < y]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], f.type) for i, f in enumerate(_RANGED)], schema=_RANGED)

    return run


def _merged(least: int) -> Callable:
    """A range -> its keys that occur often enough, counted over all blocks."""

    def run(chunks: pa.Table) -> pa.Table:
        parts = [_keys(b) for b in chunks["blob"].to_pylist()]
        head, tail, n = counted(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        often = n >= least
        head, tail, n = head[often], tail[often], n[often]
        columns = (head >> np.uint64(32), head & np.uint64(0xFFFFFFFF), tail, n)
        return pa.table({f.name: pa.array(c.astype(np.int64)) for f, c in zip(_FOUND, columns, strict=True)}, schema=_FOUND)

    return run


def _dictionary(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id: the frequent words, numbered from 1 on without gaps."""
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    often = written(often.withColumn("at", F.monotonically_increasing_id()), "frequent_words")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = often.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    # one row for each shuffle partition
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    numbered = often.withColumn("part", part).join(F.broadcast(starts), "part").select("lang", "word", "f", (F.col("start") + row + 1).alias("id"))
    return written(numbered.withColumn("id", F.when(F.col("id") < 2**32, F.col("id")).otherwise(F.raise_error(F.lit("more frequent words than 32 bits can number")))), "dictionary")


def _bounds(chunks: DataFrame, size: int) -> list[bytes]:
    """First keys at which ranges begin, so that each has about `size` keys; a bounded sample, which only balances."""
    told = chunks.agg(F.count("*").alias("chunks"), F.sum("size").alias("keys")).first()
    ranges = -(-(told["keys"] or 0) // size)
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE / told["chunks"])
    firsts = sorted(r["first"] for r in chunks.select("first").sample(share, seed=1).limit(2 * SAMPLE).collect())
    return sorted({bytes(firsts[len(firsts) * k // ranges]) for k in range(1, ranges)}) if firsts else []


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(l)} * {wide(r)})").cast("long")


def phrases(
    docs: DataFrame, least: int = LEAST, top: int = TOP, within: int = WITHIN, block_bytes: int = BLOCK_BYTES, chunk_keys: int = CHUNK_KEYS, range_keys: int = RANGE_KEYS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    blocks = written(rows.mapInArrow(lambda batches: _numbered(batches, block_bytes), "block string, lang string, word binary, no int, n long, codes binary"), "blocks")
    words = blocks.where("word is not null")
    known = _dictionary(words.select("lang", "word", "n"), least)
    ids = words.select("block", "lang", "word", "no").join(known.select("lang", "word", "id"), ["lang", "word"]).select("block", "no", "id")
    texts = blocks.where("codes is not null").select("block", "no", "codes")
    chunks = written(texts.groupBy("block").cogroup(ids.toDF(*ids.columns).groupBy("block")).applyInArrow(lambda texts, ids: _phrases(texts, ids, chunk_keys), "first binary, size long, blob binary"), "phrase_chunks")
    ranged = chunks.select("blob").mapInArrow(_cut(_bounds(chunks, range_keys)), "range long, blob binary")
    found = written(ranged.groupBy("range").applyInArrow(_merged(least), "i1 long, i2 long, i3 long, a long"), "frequent_phrases")

    nothing = F.lit(0).cast("long")
    counts = known.select(F.col("id").alias("i1"), nothing.alias("i2"), nothing.alias("i3"), F.col("f").alias("a"), "lang").unionByName(found.withColumn("lang", F.lit(None).cast("string")))
    part = lambda df, side, value: df.select(*(F.col(f"i{i}").alias(f"{side}{i}") for i in (1, 2, 3)), F.col("a").alias(value), F.col("lang").alias(f"{side}_lang"))
    keys = lambda k, left, right: F.struct(F.lit(k).alias("k"), *(c.alias(f"{s}{i}") for s, side in (("x", left), ("y", right)) for i, c in enumerate(side, 1)))
    i1, i2, i3 = F.col("i1"), F.col("i2"), F.col("i3")
    one, two = keys(1, (i1, nothing, nothing), (i2, i3, nothing)), keys(2, (i1, i2, nothing), (i3, nothing, nothing))
    cuts = found.select("*", F.explode(F.when(i3 > 0, F.array(one, two)).otherwise(F.array(one))).alias("cut")).select("i1", "i2", "i3", "a", "cut.*")
    cuts = cuts.join(part(counts, "x", "l"), ["x1", "x2", "x3"]).join(part(counts, "y", "r"), ["y1", "y2", "y3"])
    scored = cuts.groupBy("i1", "i2", "i3", "a").agg(F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r")).alias("cut"), F.max(F.coalesce("x_lang", "y_lang")).alias("lang"))
    # pairs inside a longer candidate
    longer = found.where("i3 > 0").select(F.explode(F.array(F.struct(i1.alias("i1"), i2.alias("i2")), F.struct(i2.alias("i1"), i3.alias("i2")))).alias("p"), "a").groupBy("p.i1", "p.i2").agg(F.max("a").alias("most"))
    kept = scored.join(longer.withColumn("i3", nothing), ["i1", "i2", "i3"], "left").where(F.col("most").isNull() | (100 * F.col("most") < within * F.col("a")))

    # as many as can be among the first, ties at the end included, get their words
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = kept.select("i1", "i2", "i3", "a", "lang", "cut.*").withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
    for i in (1, 2, 3):
        first = first.join(known.select(F.col("id").alias(f"i{i}"), F.col("word").cast("string").alias(f"w{i}")), f"i{i}", "left")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    named = first.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
