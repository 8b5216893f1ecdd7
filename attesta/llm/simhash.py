"""SimHash fingerprints of 128 bits, and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words; longer pairs weigh more. Each term votes with its weight on each bit. Votes are
counted four bits to a long: 16-bit lanes, summed in chunks of CHUNK terms so that no lane can overflow, then unpacked
and summed over the chunks.

Defined cases: a null text is empty; a text without words has fingerprint 0 and is unlike any other; a single word is
its own term; a text of any length is used whole; repeated rows (equal doc_id and text) are one document in the order, and
each of them is returned; rows of one doc_id with different texts are each kept, in the order of their text's hash; a null
doc_id comes first (-2**63 counts as null); the only document of a table is its own next; other columns of any name play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import keyed, words, written

BITS = 128
#: Terms counted together: 10,000 of weight 3 stay below 2**15, so the highest lane keeps its sign.
CHUNK = 10_000
LANES = 0x0001000100010001
#: Near copies: 99 % of 293 measured pairs of sf0.1 with a 5-word Jaccard of 0.8 or more, but unequal, lie within it.
RADIUS = 20
#: Fingerprints of one block value that one task holds.
HOT = 20_000
#: Tables of the search at most; 7 blocks of 18 or 19 bits need two errors each for 20 bits.
BLOCKS = 7


def terms(w: str) -> Column:
    """Hashes of the terms of the word array w, each with its weight (1 to 3) in its two low bits."""
    size = F.size(w)
    pair = lambda i: (F.element_at(w, i), F.element_at(w, i + 1))
    weight = lambda n: F.when(n > 14, 3).when(n > 8, 2).otherwise(1).cast("long")
    mark = lambda h, n: h.bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(weight(n))
    two = F.transform(F.sequence(F.lit(1), size - 1), lambda i: mark(F.xxhash64(*pair(i)), F.length(pair(i)[0]) + F.length(pair(i)[1])))
    one = F.transform(F.col(w), lambda x: mark(F.xxhash64(x), F.length(x)))
    return F.when(size >= 2, two).otherwise(one)


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, f1, f2 (the bits), blank (no term) and copies, one row for each key; map tasks send one row for each row and chunk.

    Repeats of a row are counted apart from one another, so no lane holds more than one text's chunk, and collapse in the end.
    """
    df = df.select(*keys, F.monotonically_increasing_id().alias("_r"), words(F.col(text)).alias("_w")).select(*keys, "_r", F.posexplode_outer(terms("_w")).alias("_at", "_a"))
    df = df.select(*keys, "_r", F.floor(F.col("_at") / CHUNK).cast("int").alias("_c"), "_a", F.xxhash64("_a").alias("_b"), F.col("_a").bitwiseAND(F.lit(3).cast("long")).alias("_v"))
    lane = lambda h, k: F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(LANES)) * F.col("_v"))
    packed = df.groupBy(*keys, "_r", "_c").agg(F.sum("_v").alias("_v"), *(lane(h, k).alias(f"{h}{k}") for h in ("_a", "_b") for k in range(16)))
    count = lambda h, j: F.sum(F.shiftrightunsigned(F.col(f"{h}{j % 16}"), 16 * (j // 16)).bitwiseAND(F.lit(0xFFFF).cast("long")))
    votes = packed.groupBy(*keys, "_r").agg(F.sum("_v").alias("_v"), *(count(h, j).alias(f"{h}{j}") for h in ("_a", "_b") for j in range(64)))

    def word(h: str) -> Column:
        bits = [F.when(2 * F.col(f"{h}{j}") > F.col("_v"), F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0)) for j in range(64)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    one = votes.select(*keys, word("_a").alias("f1"), word("_b").alias("f2"), F.col("_v").isNull().alias("blank"))
    return one.groupBy(*keys).agg(F.max("f1").alias("f1"), F.max("f2").alias("f2"), F.max("blank").alias("blank"), F.count("*").cast("int").alias("copies"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def likeness(a: DataFrame | str, b: str) -> Column:
    """The cosine that the angle between two fingerprints stands for, 0 where it is obtuse; columns {a}f1, {b}f1, ..."""
    d = distance((F.col(f"{a}f1"), F.col(f"{a}f2")), (F.col(f"{b}f1"), F.col(f"{b}f2")))
    estimate = F.when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * d / BITS)))
    return F.when(F.col(f"{a}blank") != F.col(f"{b}blank"), 0.0).otherwise(estimate)


def hexed(prefix: str = "") -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(f"{prefix}f2")), 16, "0"), F.lpad(F.hex(F.col(f"{prefix}f1")), 16, "0")))


def blocks(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bit after the last, errors allowed) of the blocks that the bits are cut into.

    The allowed errors plus one sum to radius + 1. A pair with more errors than allowed in every block is beyond the
    radius, so each pair within it meets the bound of some block. A block that allows -1 isn't needed.
    """
    n = max(3, min(BLOCKS, radius + 1))
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi, (radius + 1 + i) // n - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]


def bits(f: tuple[Column, Column], lo: int, hi: int) -> Column:
    """Bits lo to hi (43 at most) of a fingerprint as a long."""
    out = F.lit(0).cast("long")
    for x, base in zip(f, (0, 64), strict=True):
        a, b = max(lo, base) - base, min(hi, base + 64) - base
        if a < b:
            part = F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(part, base + a - lo))
    return out


def masks(size: int, errors: int) -> list[int]:
    """Every choice of at most so many bits of a block."""
    return [sum(1 << i for i in chosen) for k in range(errors + 1) for chosen in combinations(range(size), k)]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (q1, q2, f1, f2) of a distinct query fingerprint and a distinct index fingerprint within the radius.

    An index fingerprint is keyed once for each block, a query by every value that a block may have with the errors it
    allows. Equal fingerprints count once on either side, so groups of copies collapse first. A pair that meets the bounds
    of several blocks comes from the first of them only. A block value of more than HOT fingerprints is dealt into parts of that
    many, which its queries all meet. Counts of pairs combine where they are found, so no pair is sent on.
    """
    cut = [(t, *c) for t, c in enumerate(blocks(radius)) if c[2] >= 0]
    key = lambda f, t, lo, hi: F.shiftleft(bits(f, lo, hi), 3).bitwiseOR(F.lit(t).cast("long"))
    own, asked = (F.col("f1"), F.col("f2")), (F.col("q1"), F.col("q2"))
    x = index.select("f1", "f2").distinct().select("f1", "f2", F.explode(F.array(*(key(own, t, lo, hi) for t, lo, hi, _ in cut))).alias("_k"))
    q = queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct()
    probes = q.select("q1", "q2", F.explode(F.array(*(F.struct(key(asked, t, lo, hi).alias("k"), F.lit(t).alias("t")) for t, lo, hi, _ in cut))).alias("_b"))
    flips = F.array(*(F.array(*(F.lit(m << 3).cast("long") for m in masks(hi - lo, e))) for _, lo, hi, e in cut))
    probes = probes.select("q1", "q2", F.col("_b.k").alias("_own"), F.explode(F.element_at(flips, F.col("_b.t") - cut[0][0] + 1)).alias("_flip"))
    probes = probes.select("q1", "q2", F.col("_own").bitwiseXOR(F.col("_flip")).alias("_k"))
    apart = tuple(a.bitwiseXOR(b) for a, b in zip(asked, own, strict=True))
    first = reduce(lambda rest, c: F.when(F.bit_count(bits(apart, c[1], c[2])) <= c[3], c[0]).otherwise(rest), reversed(cut), F.lit(-1))
    # the queries' keys are many times the queries, which size estimates don't know
    hot = written(x.groupBy("_k").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("_k", F.ceil(F.col("n") / HOT).alias("_parts")), "hot_blocks")
    x = x.join(hot, "_k", "left").select("f1", "f2", "_k", F.coalesce(F.pmod(F.xxhash64("f1", "f2"), "_parts"), F.lit(0)).alias("_part"))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1)
    probes = probes.join(hot, "_k", "left").select("q1", "q2", "_k", F.explode(every).alias("_part"))
    pairs = probes.join(x.hint("merge"), ["_k", "_part"]).where(distance(asked, own) <= radius)
    return pairs.where(first == F.col("_k").bitwiseAND(F.lit(7).cast("long"))).select("q1", "q2", "f1", "f2")


def successors(rows: DataFrame) -> DataFrame:
    """_id, _th, n_chars with the key of the next row (next_id, next_th); after the last comes the first.

    Keys are dealt into ranges; within a range the next row is a lead(), and across ranges one row per range is enough.
    """
    ids = written(
        rows.select("_id", "_th", "n_chars").distinct().repartitionByRange("_id", "_th").withColumn("_p", F.spark_partition_id()), "ranges"
    )
    w = Window.partitionBy("_p").orderBy("_id", "_th")
    firsts = ids.groupBy("_p").agg(F.min(F.struct("_id", "_th")).alias("first"))
    # as many rows as there are ranges
    order = Window.partitionBy(F.lit(0)).orderBy("_p")
    every = Window.partitionBy(F.lit(0))
    after = firsts.select("_p", F.coalesce(F.lead("first").over(order), F.min("first").over(every)).alias("after"))
    led = ids.withColumns({"next_id": F.lead("_id").over(w), "next_th": F.lead("_th").over(w)})
    return led.join(F.broadcast(after), "_p").select(
        "_id", "_th", "n_chars", F.coalesce("next_id", "after._id").alias("next_id"), F.coalesce("next_th", "after._th").alias("next_th")
    )


def edited(rows: DataFrame, links: DataFrame) -> DataFrame:
    """_id, _th, edited: the text with its last half replaced by the start of the next text."""
    back = links.select(F.col("next_id").alias("_id"), F.col("next_th").alias("_th"), F.col("_id").alias("p_id"), F.col("_th").alias("p_th"), F.col("n_chars").alias("p_n"))
    # both sides read the same exchange of the texts
    texts = rows.select("_id", "_th", "text").dropDuplicates(["_id", "_th"])
    heads = texts.join(back, ["_id", "_th"]).select(F.col("p_id").alias("_id"), F.col("p_th").alias("_th"), F.expr("left(text, cast(p_n div 2 as int))").alias("head"))
    half = F.expr("left(text, cast(length(text) - length(text) div 2 as int))")
    return texts.join(heads, ["_id", "_th"]).select("_id", "_th", F.concat(half, "head").alias("edited"))


def simhash(docs: DataFrame) -> DataFrame:
    """The query's columns, and n_near: for every row whose doc_id is divisible by 50, the distinct fingerprints of all rows within RADIUS, its own included."""
    rows = keyed(docs).withColumn("n_chars", F.length("text").cast("long"))
    keys = ["_id", "_th"]
    own = written(fingerprints(rows, keys), "fingerprints")
    links = written(successors(rows), "links")
    texts = edited(rows, links)
    changed = fingerprints(texts.withColumn("sha", F.sha2(F.encode("edited", "UTF-8"), 256)), [*keys, "sha"], "edited")
    changed = changed.select(*keys, "sha", *(F.col(c).alias(f"e_{c}") for c in ("f1", "f2", "blank")))
    asked = own.where(F.col("_id") % 50 == 0)
    near = within_radius(asked, own).groupBy(F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg(F.count("*").alias("n_near"))
    counts = asked.join(near, ["f1", "f2"]).select(*keys, "n_near")
    after = own.select(F.col("_id").alias("next_id"), F.col("_th").alias("next_th"), *(F.col(c).alias(f"n_{c}") for c in ("f1", "f2", "blank")))
    out = links.join(own, keys).join(changed, keys).join(after, ["next_id", "next_th"]).join(counts, keys, "left")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.nullif("_id", F.lit(-(2**63))).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), hexed().alias("fingerprint"), hexed("e_").alias("edited_fingerprint"),
        likeness("", "e_").alias("near_edited"), likeness("", "n_").alias("near_next"), "n_near",
    )
