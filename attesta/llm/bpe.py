"""Byte-level BPE of a corpus, with each distinct word encoded once.

Words are the matches of the split pattern. A task takes its rows in blocks of BLOCK_CHARS (more where there are many
shards, so that a block has words enough for each), numbers the distinct
words of a block and writes each text as word numbers, in order: its positions. One exchange then carries both the
numbered texts (to a place of the block) and the distinct words (to the shard of their hash). A shard encodes every
distinct word once for all blocks, and its ids are joined back to the blocks, which look their numbers up. So no
occurrence crosses the network as a row of its own, and a frequent word costs a block one entry.

Only blocks are read as groups, each with the replies to it; the words of a shard stream through its task.

Decoding joins ids with the token-byte table, which is as large as the vocabulary file and no larger: a map-side join whose
build side every worker holds, and whose rows stay in the order of their positions.

Defined cases: a null or empty text has no ids; repeated rows are each encoded; any doc_id passes through, null too; a text of any
length is encoded whole, also one endless word; other columns of any name play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import tokens

#: Text that one block holds at most, unless a single text is longer: so much for each SHARDS_A_BLOCK shards, up to MOST_BLOCKS times as much.
BLOCK_CHARS, SHARDS_A_BLOCK, MOST_BLOCKS = 4_000_000, 200, 16
#: Words that a shard keeps the ids of; beyond, it starts anew, and a word may be encoded once more.
KNOWN = 2_000_000
_KEYED = pa.schema([("key", pa.string()), ("block", pa.string()), ("blob", pa.binary())])
_KEYED_DDL = "key string, block string, blob binary"


def _pack(columns: dict[str, pa.Array]) -> bytes:
    """A compressed record batch with one row; each column holds an array."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict({k: pa.array([v]) if isinstance(v, bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in columns.items()})
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as source:
        batch = source.read_next_batch()
    return {n: c.flatten() if pa.types.is_list(c.type) else c[0].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all low bytes first: small numbers are common, so the rest compresses well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pattern():  # noqa: ANN202
    import regex

    return regex.compile(tokens.SPLIT)


def block_chars(shards: int) -> int:
    return BLOCK_CHARS * min(MOST_BLOCKS, max(1, shards // SHARDS_A_BLOCK))


def _numbered(shards: int, most: int) -> Callable:
    """doc_id, text -> for each block its numbered texts, and for each of its shards the distinct words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, serial = _pattern().findall, TaskContext.get().partitionId(), 0
        ids: list = []
        codes: list[np.ndarray] = []
        number, chars = _Numbered(), 0

        def block() -> Iterator[pa.RecordBatch]:
            name = f"{task}-{serial}"
            sizes = np.array([len(c) for c in codes], dtype=np.uint32)
            texts = _pack({"doc_id": pa.array(ids, pa.int64()), "words": pa.array(sizes), "codes": _planes(np.concatenate(codes))})
            by_shard: dict[int, list[bytes]] = {}
            own: dict[int, list[int]] = {}
            for word, n in number.items():
                raw = word.encode()
                k = zlib.crc32(raw) % shards
                by_shard.setdefault(k, []).append(raw)
                own.setdefault(k, []).append(n)
            blobs = [_pack({"word": pa.array(ws, pa.binary()), "step": pa.array(np.diff(np.array(own[k], dtype=np.uint32), prepend=np.uint32(0)))}) for k, ws in by_shard.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f"b{name}"]), pa.array([name]), pa.array([texts], pa.binary())], schema=_KEYED)
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array([f"s{k}" for k in by_shard]), pa.array([name] * len(blobs)), pa.array(blobs, pa.binary())], schema=_KEYED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and chars + len(text) > most:
                    yield from block()
                    ids, codes, number, chars, serial = [], [], _Numbered(), 0, serial + 1
                ids.append(doc_id)
                codes.append(np.fromiter(map(number.__getitem__, split(text)), dtype=np.uint32))
                chars += len(text)
        if ids:
            yield from block()

    return run


def _encoded(ranks) -> Callable:  # noqa: ANN001
    """Words of a shard -> their ids, for the block that sent them; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoding(ranks)._encode_single_piece
        known: dict[bytes, tuple[int, ...]] = {}
        kind = np.uint16 if len(ranks.value) <= 1 << 16 else np.uint32
        for batch in batches:
            for key, block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key[0] != "s":
                    continue
                sent = _unpack(blob)
                if len(known) > KNOWN:
                    known.clear()
                flat, sizes = [], []
                for w in sent["word"].to_pylist():
                    found = known.get(w)
                    if found is None:
                        found = known[w] = tuple(encode(w))
                    flat.extend(found)
                    sizes.append(len(found))
                reply = _pack({"step": sent["step"], "size": pa.array(np.array(sizes, dtype=np.uint32)), "ids": pa.array(np.array(flat, dtype=kind))})
                yield pa.RecordBatch.from_arrays([pa.array([f"b{block}"]), pa.array([block]), pa.array([reply], pa.binary())], schema=_KEYED)

    return run


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] to starts[i] + sizes[i] for all i, in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _rebuilt(ranks, finish: Callable, schema: pa.Schema) -> Callable:  # noqa: ANN001
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        table, rows = ranks.value, []
        if texts.num_rows and texts.column("key")[0].as_py()[0] != "b":
            raise RuntimeError("a shard's words came as a block")
        for blob in texts.column("blob"):
            held = _unpack(blob.as_py())
            codes = _numbers(held["codes"])
            n = int(codes.max()) + 1 if len(codes) else 0
            size, start, parts, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [], 0
            told = 0
            for reply in replies.column("blob"):
                r = _unpack(reply.as_py())
                own, lens, ids = np.cumsum(r["step"].to_numpy().astype(np.int64)), r["size"].to_numpy().astype(np.int64), r["ids"].to_numpy()
                size[own], start[own] = lens, at + np.cumsum(lens) - lens
                parts.append(ids)
                at += len(ids)
                told += len(own)
            if told != n:
                raise RuntimeError(f"{told} of {n} words came back for a block")
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)
            ends = np.cumsum(held["words"].to_numpy().astype(np.int64))
            for doc_id, a, b in zip(held["doc_id"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                c = codes[a:b]
                rows.append(finish(doc_id, flat[_spread(start[c], size[c])].astype("<u4"), table))
        return pa.Table.from_pydict({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema)

    return run


def _over_blocks(docs: DataFrame, path: str | None, shards: int | None, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    spark = docs.sparkSession
    ranks = tokens.shared(spark, tokens.ranks_of_tiktoken(path or tokens.default_path("byte_bpe_50k.tiktoken")))
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbered once: both branches read this exchange, where a block's texts meet its ids by key
    sent = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_numbered(parts, block_chars(parts)), _KEYED_DDL).repartition(parts, "key")
    replies = sent.mapInArrow(_encoded(ranks), _KEYED_DDL)
    # blocks alone form groups: a shard's words of all blocks would be one that grows with the corpus. A condition that isn't
    # deterministic stays behind the exchange, which both branches go on sharing
    blocks = sent.where(F.col("key").startswith("b") | (F.spark_partition_id() < 0))
    return blocks.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(_rebuilt(ranks, finish, schema), ddl)


def encode(docs: DataFrame, path: str | None = None, shards: int | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _over_blocks(docs, path, shards, lambda d, ids, _: (d, ids.astype(np.int32)), schema, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes that ids (array of int) stand for."""
    ranks = tokens.shared(coded.sparkSession, tokens.ranks_of_tiktoken(path or tokens.default_path("byte_bpe_50k.tiktoken")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for batch in batches:
            raw = [None if ids is None else b"".join(map(table.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bytes": pa.array(raw, pa.binary())})

    return coded.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _digest(doc_id: int | None, ids: np.ndarray, table: list[bytes]) -> tuple:
    decoded = b"".join(map(table.__getitem__, ids.tolist()))
    return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def round_trip(docs: DataFrame, path: str | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _over_blocks(docs, path, shards, _digest, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
