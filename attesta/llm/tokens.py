"""Byte-pair vocabularies: read once on the driver, sent to executors as a broadcast of fixed size."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import cache

from pyspark import Broadcast
from pyspark.sql import SparkSession

SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of_tiktoken(path: str) -> list[bytes]:
    """The bytes of each id, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(token) for token, rank in sorted(pairs, key=lambda p: int(p[1]))]


def byte_letters() -> dict[str, int]:
    """Byte-level files write each byte as a letter: printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def ranks_of_json(path: str) -> list[bytes]:
    """The same from a `tokenizers` file; its merges stand in the order of their ids, its special tokens at the end."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    letters = byte_letters()
    vocab = sorted((i, token) for token, i in spec["model"]["vocab"].items() if i not in special)
    if [i for i, _ in vocab] != list(range(len(vocab))):
        raise ValueError(f"{path}: ids have gaps")
    return [bytes(letters[c] for c in token) for _, token in vocab]


def spec_of_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared(spark: SparkSession, tokens: list[bytes]) -> Broadcast:
    """At most a few MB: the vocabulary is a file of fixed size."""
    return spark.sparkContext.broadcast(tokens)


@cache
def _encoding(key: int, size: int):  # noqa: ANN202
    import tiktoken

    return tiktoken.Encoding(f"ranks-{key}-{size}", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(_held[key])}, special_tokens={})


_held: dict[int, list[bytes]] = {}


def encoding(tokens: Broadcast):  # noqa: ANN201
    """The encoder of a vocabulary, one for each worker process."""
    import zlib

    value = tokens.value
    key = zlib.crc32(b"\0".join(value))
    _held[key] = value
    return _encoding(key, len(value))


def library_ids(tokens: Broadcast, spec: Broadcast) -> Callable[[str], list[int]]:
    """text -> the ids that the `tokenizers` library gives with add_special_tokens=False, added tokens in the text included."""
    added = [t["content"] for t in json.loads(spec.value).get("added_tokens", []) if t["content"]]
    plain = encoding(tokens).encode_ordinary
    if not added:
        return plain
    held = re.compile("|".join(map(re.escape, added))).search
    library: list = []

    def encode(text: str) -> list[int]:
        if held(text) is None:
            return plain(text)
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_str(spec.value))
        return library[0].encode(text, add_special_tokens=False).ids

    return encode
