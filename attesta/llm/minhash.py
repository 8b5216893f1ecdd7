"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation, components.

Signatures. HASHES minima per document. All of them give one bit each (the sketch, which estimates the similarity of a
pair); the first CHUNKS * WIDTH give 16-bit symbols (the signature, which finds pairs).

Join. The signature is split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols differ in at most ERRORS = 1 symbols of some chunk, so a chunk is keyed once for each
symbol left out, and every such pair shares a key. At a similarity of 0.85 a pair misses all keys with a probability of
about 2e-8, at 0.8 of about 3e-6.

Links. Documents with equal shingle sets are one class from the start, and each class is read from one row. In each key the
member that shares most with others is the hub, and members are compared with hubs only, so a group of near copies costs
rows in proportion to its size. Keys whose other members are then in several components stay open, and each of their members is compared with
the hub of the key. Let x add a shingles to a hub of n and lack r of it, and y add a' and lack r'. At a similarity of s or
more they share (r + s a - (1 - s) n + r' + s a') / (1 + s) or more of what they add or lack. They share no more than r' of
what they lack and a' of what they add, so with need = (r + s a - (1 - s) n) / (1 + s), which is above 0 unless x is
linked with the hub, they share at least need - s (r' - a') / (1 + s) added shingles, and at least
need + (r' - a') / (1 + s) lacking ones. One of the two is above 0. So all pairs left are found by a join on
(hub, added shingle), or (hub, lacking shingle) where no added one need be shared, in which both sides leave out as many
of their most frequent shingles as they share for sure, less one: pages of one template that differ enough share none of
what is left, and don't meet. The extremes of r' - a' among a hub's members tell before the join which shingles of a member
no pair needs; only the others are shuffled for it. Every link is confirmed on the full sets. Components come from alternating large-star and
small-star steps.

Defined cases: a null, empty or wordless text has no set and is its own component; fewer words than a shingle are one
shingle; a text of any length is used whole; rows that share a doc_id are one document, linked with whatever any of its
texts is linked with; repeated rows share a component and are each returned; a null doc_id counts as the smallest; other
columns of any name pass through keep_first and play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import NO_ID, apart, ascii_lower, parted, restored, scope, whole, words, written

#: The operator's own defaults: words in a shingle, and the least similarity of a link in percent.
SHINGLE = 5
PERCENT = 80
HASHES, CHUNKS, WIDTH = 512, 12, 6
SKETCH = [f"b{i}" for i in range(HASHES // 64)]
#: Rows that a worker takes up at a time.
SLICE = 256


def most_bits(percent: int) -> int:
    """Sketch bits that may differ: half of the hashes that differ at this similarity, and five standard deviations more."""
    p = (1 - percent / 100) / 2
    return math.ceil(HASHES * p + 5 * math.sqrt(HASHES * p * (1 - p)))


def with_shingles(df: DataFrame, text: str, out: str, size: int) -> DataFrame:
    """Adds the distinct hashed shingles of a text; its words have a column of their own, so that they are found once."""
    n = F.size("_w")
    many = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*(F.element_at("_w", i + k) for k in range(size))))
    found = F.array_distinct(F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.col("_w")))).otherwise(F.expr("cast(array() as array<bigint>)")))
    return df.withColumn("_w", words(ascii_lower(F.col(text)))).withColumn(out, found).drop("_w")


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        seeds = _mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _MIX[2])
    low = (seeds >> np.uint64(32)).astype(np.uint32)
    return (low[:HASHES] | np.uint32(1))[:, None], low[HASHES:][:, None]


def minima(values: np.ndarray) -> np.ndarray:
    """The HASHES minima of a non-empty set of 64-bit hashes; works through long sets in pieces."""
    a, b = _multipliers_once()
    x = np.ascontiguousarray(values.view(np.uint32)[::2])
    out = None
    for at in range(0, len(x), 4096):
        part = ((x[at : at + 4096][None, :] ^ b) * a).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


_cached: list[tuple[np.ndarray, np.ndarray]] = []


def _multipliers_once() -> tuple[np.ndarray, np.ndarray]:
    if not _cached:
        _cached.append(_multipliers())
    return _cached[0]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, s (list of long) -> _id, n, s1, s2, symbols (binary) and sketch words; SLICE rows at a time."""
    for whole_batch in batches:
        for at in range(0, len(whole_batch), SLICE):
            batch = whole_batch.slice(at, SLICE)
            lists = batch.column("s")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            mins = np.zeros((len(batch), HASHES), dtype=np.uint64)
            for i in range(len(batch)):
                if offsets[i + 1] > offsets[i]:
                    mins[i] = minima(values[offsets[i] : offsets[i + 1]])
            with np.errstate(over="ignore"):
                mixed = _mixed(mins * _MIX[2])
                symbols = (mixed[:, : CHUNKS * WIDTH] & np.uint64(0xFFFF)).astype("<u2")
            bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("_id", "_th", "n", "s1", "s2")}
                | {"symbols": pa.array([s.tobytes() for s in symbols], pa.binary())}
                | {c: pa.array(bits[:, k], pa.int64()) for k, c in enumerate(SKETCH)}
            )


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row for each row of docs (_id, _th, text): n, the set's 128-bit hash, symbols and sketch."""
    df = with_shingles(docs.select("_id", "_th", "text"), "text", "s", size).withColumn("_o", F.sort_array("s"))
    df = df.select("_id", "_th", F.size("s").cast("long").alias("n"), F.xxhash64(F.lit(1), "_o").alias("s1"), F.xxhash64(F.lit(2), "_o").alias("s2"), "s")
    return df.mapInArrow(_signed, "_id long, _th long, n long, s1 long, s2 long, symbols binary, " + ", ".join(f"{c} long" for c in SKETCH))


def _placed(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each symbol and its place; sums of them stand for chunks."""
    place = np.arange(CHUNKS * WIDTH, dtype=np.uint64)
    return _mixed((symbols.astype(np.uint64) + (place << np.uint64(16)) + np.uint64(1)) * _MIX[2])


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, symbols -> (key, cid) for every chunk and every symbol of it left out."""
    place = np.arange(CHUNKS * WIDTH, dtype=np.uint64)
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), dtype="<u2").reshape(len(batch), -1)
        with np.errstate(over="ignore"):
            each = _placed(raw).reshape(len(batch), CHUNKS, WIDTH)
            rest = each.sum(axis=2, keepdims=True, dtype=np.uint64) - each
            keys = _mixed(rest.reshape(len(batch), -1) + place * _MIX[2]).view(np.int64)
        cid = np.repeat(batch.column("cid").to_numpy(), CHUNKS * WIDTH)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel(), pa.int64()), "cid": pa.array(cid, pa.int64())})


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, cid, members) for the keys that at least two classes share; members are the classes that have the key.

    Counts combine on the map side and are written first, so both sides of the join are bare exchanges and nothing after it asks
    for its partitioning: a key that a third of all classes share is split by adaptive execution.
    """
    rows = classes.select("cid", "symbols").mapInArrow(_chunk_keys, "key long, cid long")
    counts = written(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key_counts")
    # most keys are of one class and go no further; one plan for every size: neither side of this join is small where it matters
    return parted(rows, counts, "key")[0].join(counts.hint("merge"), "key")


def alike(a: str, b: str, percent: int) -> Column:
    """The filter before confirmation: sizes and sketches (columns {a}n, {a}b0, ...) allow the similarity asked for."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCH), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= most_bits(percent))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def compared(pairs: DataFrame, texts: DataFrame, size: int, percent: int, name: str, added: bool = False) -> DataFrame:
    """pairs (a, b, ...) with linked (the full sets are similar enough) and, if asked for, how a differs from b: added, lacking, need, less.

    Written, as a filter on linked would be pushed down to the words and evaluate them for every shingle.
    """
    # one exchange serves both sides, and holds the texts of pairs only
    texts = parted(texts, pairs.select(F.explode(F.array("a", "b")).alias("cid")), "cid")[0]
    left, right = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    df = pairs.join(left, "a").join(right, "b")
    df = with_shingles(with_shingles(df, "ta", "sa", size), "tb", "sb", size).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    linked = 100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))
    more = []
    if added:
        gone, new = F.size("sb") - F.col("both"), F.size("sa") - F.col("both")
        need = (100 * gone + percent * new - (100 - percent) * F.size("sb")) / (100 + percent)
        more = [F.array_except("sa", "sb").alias("added"), F.array_except("sb", "sa").alias("lacking"), need.alias("need"), (gone - new).alias("less")]
    return written(df.select(*pairs.columns, linked.alias("linked"), *more), name)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of edges (a, b), but for the roots; large-star and small-star in turn."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(below.select("u", F.col("m").alias("v")))
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _plausible(pairs: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that alike() lets pass."""
    return pairs.join(_prefixed(slim, "x_"), F.col("a") == F.col("x_cid")).join(_prefixed(slim, "y_"), F.col("b") == F.col("y_cid")).where(alike("x_", "y_", percent)).select("a", "b")


def spokes(keys: DataFrame, hubs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, root: the members of open keys with the hub of their key, and the components that they are in."""
    placed = keys.join(hubs, "key").where("cid <> hub").join(roots, F.col("cid") == F.col("node"), "left").select("key", "cid", "hub", F.coalesce("root", "cid").alias("root"))
    still = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return placed.join(still, "key").select(F.col("cid").alias("a"), F.col("hub").alias("b"), "root").distinct()


def beside_hubs(edits: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that may share enough of how they differ from their hub; edits as compared() gives them.

    What a member must share at least with any other of its hub, by the extremes of less there, tells shingles of it that no pair needs.
    Shingles travel as a hash with hub and side, beside the ids of their member; what else is known of it is joined to them.
    """
    f, g = -percent / (100 + percent), 100 / (100 + percent)
    edits = edits.withColumnsRenamed({"b": "hub", "a": "cid"})
    slim = edits.select("hub", "cid", "root", "linked", "need", "less")
    slim = slim.join(slim.groupBy("hub").agg(F.min("less").alias("low"), F.max("less").alias("high")), "hub")
    # both are at most what shared() gives below for any pair of the member
    slim = slim.select("hub", "cid", "root", "linked", "need", "less", (F.col("need") + f * F.col("high") - 1e-9).alias("adding"), (F.col("need") + g * F.col("low") - 1e-9).alias("lacking"))
    slim = written(slim, "members")
    sides = F.array(F.struct(F.lit(True).alias("adds"), F.col("added").alias("l")), F.struct(F.lit(False).alias("adds"), F.when(F.col("adding") <= 0, F.col("l")).alias("l")))
    rows = edits.select("hub", "cid", "added", F.col("lacking").alias("l")).join(slim.select("hub", "cid", "root", "adding"), ["hub", "cid"])
    rows = rows.select("hub", "cid", "root", F.explode(sides).alias("part")).select("hub", "cid", "root", "part.adds", F.explode("part.l").alias("token"))
    rows = rows.select("hub", "cid", "root", "adds", F.xxhash64("hub", "adds", "token").alias("key"))
    # shingles of several components; counts and extremes combine on the map side
    common = rows.groupBy("key").agg(F.count("*").alias("df"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "df")
    rows = rows.select("hub", "cid", "adds", "key").join(common, "key").join(slim, ["hub", "cid"])
    own = Window.partitionBy("hub", "adds", "cid")
    rows = rows.withColumn("rank", F.count("*").over(own) - F.row_number().over(own.orderBy("df", "key")) + 1)
    rows = rows.where(F.col("rank") >= F.when(F.col("adds"), F.col("adding")).otherwise(F.col("lacking")))
    rows = written(rows.select("key", "cid", "adds", "root", "linked", "need", "less", "rank"), "edit_shingles")
    # both sides read one exchange, so no condition of one side alone goes below it
    x, y = rows.alias("x"), rows.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
    once = F.when(F.col("y.linked"), ~F.col("x.linked")).otherwise(~F.col("x.linked") & (F.col("x.cid") < F.col("y.cid")))
    shared = lambda c: F.greatest(F.col("x.need") + c * F.col("y.less"), F.col("y.need") + c * F.col("x.less")) - 1e-9
    adding, lacking = shared(f), shared(g)
    least = F.when(F.col("x.adds") & F.col("y.adds"), F.when(adding > 0, adding)).otherwise(F.when(adding <= 0, lacking))
    far = (F.col("x.rank") >= least) & (F.col("y.rank") >= least)
    return _ordered(x.join(y, met & once & far), "x.cid", "y.cid")


def class_links(classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root for the classes that are linked with others; classes as near_groups() makes them, rows (_id, _th, text)."""
    with scope(rows.sparkSession, keep=("roots",)):
        keys = written(shared_keys(classes), "keys")
        slim = written(classes.select("cid", "_id", "_th", "n", *SKETCH).join(keys.select("cid").distinct(), "cid", "left_semi"), "sketches")
        # one text for each class, however often its row repeats
        texts = parted(rows, slim)[0].join(slim.select("cid", "_id", "_th").hint("merge"), ["_id", "_th"]).dropDuplicates(["_id", "_th", "cid"]).select("cid", "text")
        texts = written(texts, "texts")
        shared = keys.join(keys.groupBy("cid").agg(F.sum("members").alias("rank")), "cid")
        hubs = shared.groupBy("key").agg(F.max(F.struct("rank", (-F.col("cid")).alias("no"))).alias("top")).select("key", (-F.col("top.no")).alias("hub"))
        hubs = written(hubs, "hubs")
        pairs = written(_plausible(keys.join(hubs, "key").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), slim, percent), "hub_pairs")
        links = compared(pairs, texts, size, percent, "with_hubs").where("linked").select("a", "b")
        roots = written(components(links), "hub_roots")
        edits = compared(written(spokes(keys, hubs, roots), "spokes"), texts, size, percent, "open_members", added=True)
        known = _ordered(pairs, "a", "b").union(_ordered(edits, "a", "b")).distinct()
        more = _plausible(beside_hubs(edits, percent), slim, percent).join(written(known, "known"), ["a", "b"], "left_anti")
        last = compared(written(more, "more_pairs"), texts, size, percent, "beside_hubs")
        links = links.union(edits.where("linked").select("a", "b")).union(last.where("linked").select("a", "b"))
        return written(components(links), "roots")


def document_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: the classes that rows of one document fall into, each with the smallest of them."""
    sets = signed.where("n > 0").select("_id", F.struct("s1", "s2", "n").alias("set"))
    several = sets.groupBy("_id").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x <> y").select("_id")
    own = sets.join(several.hint("merge"), "_id").select("_id", "set.*").join(classes.select("s1", "s2", "n", "cid"), ["s1", "s2", "n"]).select("_id", "cid")
    least = own.groupBy("_id").agg(F.min("cid").alias("a"))
    return own.join(least, "_id").select("a", F.col("cid").alias("b")).where("a <> b").distinct()


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, _id, _th, n_shingles, component_id and kept, one row for each row of docs (doc_id, text)."""
    with scope(docs.sparkSession, keep=("signatures", "names")):
        rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(whole("text")).alias("_th"), whole("text").alias("text"))
        signed = written(signatures(rows, size), "signatures")
        # equal sets collapse on the map side; a written number names each
        first = F.min(F.struct("_id", "_th", "symbols", *SKETCH)).alias("f")
        classes = signed.where("n > 0").groupBy("s1", "s2", "n").agg(first).select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n", "f.*")
        classes = written(classes, "classes")
        roots = class_links(classes, rows.select("_id", "_th", "text"), size, percent)
        joint = written(document_links(signed, classes), "document_links")
        if not joint.isEmpty():
            roots = written(components(roots.toDF("a", "b").union(joint)), "joint_roots")
        nodes = roots.union(roots.select("root", "root").distinct())
        linked = classes.select("cid", "_id").join(nodes, F.col("cid") == F.col("node"))
        least = linked.groupBy("root").agg(F.min("_id").alias("c"))
        names = classes.select("s1", "s2", "n", "cid", "_id").join(linked.join(least, "root").select("cid", "c"), "cid", "left")
        names = written(names.select("s1", "s2", "n", F.coalesce("c", "_id").alias("root")), "names")
    out = signed.select("_id", "_th", "n", "s1", "s2").join(names, ["s1", "s2", "n"], "left").withColumn("c", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("_id")))
    plain = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(plain("_id").alias("doc_id"), "_id", "_th", F.col("n").alias("n_shingles"), plain("c").alias("component_id"), (F.col("_id") == F.col("c")).alias("kept"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept."""
    return near_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents of the smallest doc_id of each group, in the columns of docs."""
    gone = written(near_groups(docs, size, percent).where(~F.col("kept")).select("_id", "_th").distinct(), "near_copies")
    some, rest = parted(apart(docs).drop("text"), gone)
    return restored(some.join(gone.hint("merge"), ["_id", "_th"], "left_anti"), docs.columns).union(restored(rest, docs.columns))
