"""Source divergence audit: how far the sources of a language are apart in their terms, and what each says more than its language.

Terms are counted by (lang, source, term), within batches first, so a hot source or term is a few rows by the time of the
shuffle. Each language keeps the terms of MIN_DOCS documents. A kept term has a sparse vector, its counts by source.
Terms with the same vector give the same shares in every source, so vectors are grouped, each distinct one is
evaluated once for every pair of sources, and counts with its multiplicity: a task takes a part of a language's distinct
vectors as the columns of a matrix, one row for each source, and adds up the differences of all pairs of rows. Sources are
taken in blocks, so that no matrix has more rows than two blocks; a vector goes to those pairs of blocks that it has a count
in. Where neither source has a count, the difference is that of their shares of nothing, which is known without a vector:
sums start with it for all terms, and vectors add what they differ from it.

Terms are ranked as they were, from their own counts: the first TOP of a group by a window whose limit Spark takes before the shuffle.

Arithmetic is exact: shares by integer division (decimals of 38 digits in columns; in tasks three divisions of 1000 each, for sums of
counts below 9e15), their differences and sums as 64-bit integers.

Defined cases: null text, lang and source count as ''; each row is a document, so repeated rows count each, whatever their doc_id;
a text of any length is counted whole; a group without terms, or a language without kept ones, has value 0 for every pair; ties
go by the item's bytes; other columns of any name play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import written

MIN_DOCS, TOP = 30, 50
#: The share of a term: 1 + floor(SCALE * (count + ADD) / (all + ADD * terms)).
SCALE, ADD = 1_000_000_000, 5
#: Terms of groups that a worker holds before it hands them over; sources of a block; distinct vectors of a part; cells of a step.
HELD, BLOCK, PART, CELLS = 300_000, 256, 20_000, 2_000_000
#: Everything but letters, upper letters become lower ones; bytes from 0x80 on belong to letters.
_TERM = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text (binary) -> occurrences and documents of each term, added up for as many rows as HELD allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            if size:
                names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, dtype=np.int32)), pa.array([x], pa.string())).dictionary_decode() for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(n, pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], schema=_COUNTS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.translate(_TERM).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
            if len(n) > HELD // 16 and sum(len(c) for c, _ in held.values()) > HELD:
                yield from flushed()
    yield from flushed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n, docs: the occurrences and documents of each term of each group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + ADD) / (total + ADD * terms)) of columns, exact for any long; null where there are no terms."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + ({SCALE} * ({wide(n)} + {ADD})) div nullif({wide(total)} + {ADD} * {wide(terms)}, 0)")


def shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same of arrays; below = total + ADD * terms, above 0 and under 9e15."""
    out, rest = np.zeros(np.broadcast(counts, below).shape, dtype=np.int64), counts + ADD
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def _apart(key: tuple, vectors: pa.Table, sources: pa.Table, block: int) -> pa.Table:
    """A part of a language's distinct vectors, for the pairs of two blocks of sources (or one): what they add to each pair's sum."""
    first, second, part = (key[i].as_py() for i in (1, 2, 3))
    sources = sources.sort_by("idx")
    idx, names = sources["idx"].to_numpy(), sources["source"].to_pylist()
    terms = sources["terms"][0].as_py()
    below = sources["total"].to_numpy() + ADD * terms
    none = shares(np.zeros(len(idx), dtype=np.int64), np.maximum(below, 1)) if terms else np.zeros(len(idx), dtype=np.int64)
    sums = np.zeros((len(idx), len(idx)), dtype=np.int64)
    vid, col = np.unique(vectors["vid"].to_numpy(), return_inverse=True)
    row, n, m = np.searchsorted(idx, vectors["idx"].to_numpy()), vectors["n"].to_numpy(), vectors["m"].to_numpy()
    order = np.argsort(col, kind="stable")
    row, col, n, m = row[order], col[order], n[order], m[order]
    step = max(1, CELLS // len(idx))
    # the second block's rows begin where the first block's end; within one block each row meets those after it
    border = int(np.searchsorted(idx, second * block)) if first < second else 0
    for at in range(0, len(vid), step):
        a, b = np.searchsorted(col, [at, at + step])
        cells = np.repeat(none[:, None], min(step, len(vid) - at), axis=1)
        cells[row[a:b], col[a:b] - at] = shares(n[a:b], below[row[a:b]])
        times = np.zeros(cells.shape[1], dtype=np.int64)
        times[col[a:b] - at] = m[a:b]
        for i in range(border or len(idx) - 1):
            rest = slice(border or i + 1, None)
            sums[i, rest] += np.abs(cells[rest] - cells[i]) @ times - np.abs(none[rest] - none[i]) * times.sum()
    if part == 0:
        sums += terms * np.abs(none[:, None] - none)
    i, j = np.triu_indices(len(idx), 1)
    if border:
        i, j = (x.ravel() for x in np.meshgrid(np.arange(border), np.arange(border, len(idx)), indexing="ij"))
    pick = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "source": pick.take(pa.array(i)), "item": pick.take(pa.array(j)), "value": pa.array(sums[i, j], pa.int64())})


def _block_pairs(block: str) -> Column:
    """Each pair of blocks that a block is part of, the lower one first."""
    return F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda y: F.struct(F.least(block, y).alias("first"), F.greatest(block, y).alias("second")))).alias("blocks_of")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each pair of sources of a language, and the terms that each source says more often."""
    terms = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_all"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    kept = written(terms.where(F.col("docs") >= min_docs).select("lang", "term", "n_all", "vector"), "kept_terms")
    vectors = written(kept.groupBy("lang", "vector").agg(F.count("*").alias("m")).select("lang", "vector", "m", F.monotonically_increasing_id().alias("vid")), "vectors")

    # one row for each group, and what its language has
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(blank("lang"), blank("source")).distinct()
    totals = vectors.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", "e.source").agg(F.sum(F.col("e.n") * F.col("m")).alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_all").alias("lang_total")).join(vectors.groupBy("lang").agg(F.count("*").alias("n_vectors")), "lang")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("total", "terms", "lang_total", "n_vectors")))
    own = Window.partitionBy("lang")
    groups = groups.withColumns({
        "idx": F.row_number().over(own.orderBy("source")).cast("long") - 1, "blocks": F.ceil(F.count("*").over(own) / F.lit(block)).cast("long"), "parts": F.greatest(F.ceil(F.col("n_vectors") / F.lit(PART)), F.lit(1)).cast("long"),
    })
    groups = written(groups, "source_groups")

    own_block = F.expr(f"idx div {block}")
    places = vectors.select("lang", "vid", "m", F.explode("vector").alias("e")).select("lang", "vid", "m", "e.source", "e.n").join(groups.select("lang", "source", "idx", "blocks", "parts"), ["lang", "source"])
    places = places.withColumns({"block": own_block, "part": F.pmod(F.xxhash64("vid"), F.col("parts"))}).select("lang", "vid", "m", "n", "idx", "part", _block_pairs("block"))
    sides = groups.toDF(*groups.columns).withColumn("block", own_block).select("lang", "source", "idx", "total", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block", "blocks")
    sides = sides.select("lang", "source", "idx", "total", "terms", "part", _block_pairs("block"))
    key = ["lang", "first", "second", "part"]
    flat = lambda df: df.select(*(c for c in df.columns if c != "blocks_of"), "blocks_of.*")
    apart = flat(places).groupBy(*key).cogroup(flat(sides).groupBy(*key)).applyInArrow(lambda key, vectors, sources: _apart(key, vectors, sources, block), "lang string, source string, item string, value long")
    apart = written(apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "apart")
    pairs = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    said = kept.select("lang", "term", "n_all", F.explode("vector").alias("e")).select("lang", "term", "n_all", "e.source", "e.n").join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    said = said.select("lang", "source", F.col("term").cast("string").alias("item"), (share("n", "total", "terms") - share("n_all", "lang_total", "terms")).cast("long").alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(said, "term").where(F.col("rank") <= top))
