"""Token counts of whole texts by rank-synchronous merging.

A task takes its texts in batches. Their pre-tokens are numbered, so each distinct one is merged once: all new pre-tokens of a
batch stand behind one another in one array of symbols, ragged by a start for each. A round finds the lowest rank among the
pairs of each pre-token and merges every pair of that rank in it, in all pre-tokens at the same time, until none has a pair
left; what survives is counted, and a text's count is the sum over its pre-tokens. A vocabulary in which every merge comes
after those that make its parts gives the same by single merges, lowest rank first; others are refused.

A pre-token longer than LONG symbols goes through the same rounds in sparse form: pairs are held by rank, and a round touches
the pairs of its rank only, so that a word without end costs n log n.

Normalising and splitting are the library's own for every text with a character outside COMMON; within it both are stated here
by the pattern of the file, which the tests hold against the library for every such character.

Nothing is shuffled; a worker holds one batch, KNOWN counts at most and one text, whatever its length.

Defined cases: a null or empty text has no bytes and no tokens; an added token's characters in a text are one token, as the
library has them by default; repeated rows are each counted; any doc_id passes through, null too; a text of any length is counted
whole, also one endless word; other columns of any name play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm import tokens

MAX_TOKENS = 2048
#: Characters of the texts that are counted together; pre-tokens whose counts a worker keeps; symbols of a dense pre-token.
BATCH_CHARS, KNOWN, LONG = 2_000_000, 400_000, 256
#: Ranges of characters that no normal form changes, with their small letters, and whose classes are the same in every library.
COMMON = "\x00-\u017f\u2010-\u2027\u2030-\u205e\u20ac"
#: The steps before the merges that COMMON is stated for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
NO_PAIR = np.iinfo(np.int32).max
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Merges:
    """The merges of a word-end BPE file: symbols of bytes, and rank and result of each pair."""

    def __init__(self, spec: dict):
        model = spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("unk_token"):
            raise ValueError(f"no plain BPE file: {model['type']} {odd}")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = tokens.byte_letters()
        self.inner, self.last = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.inner[byte], self.last[byte] = vocab[letter], vocab[letter + end]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if a + b in made:
                raise ValueError(f"two merges make {a + b}")
            if any(len(x.removesuffix(end) if x != end else x) > 1 and x not in made for x in (a, b)):
                raise ValueError(f"the merge {a} {b} comes before its parts")
            made[a + b] = rank
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.size = max(vocab.values()) + 1
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.by_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def symbols(self, word: bytes) -> np.ndarray:
        out = self.inner[np.frombuffer(word, dtype=np.uint8)]
        out[-1:] = self.last[word[-1]] if word else 0
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair, NO_PAIR where no merge has it."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NO_PAIR)

    def dense(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive in each of the words (none of them empty)."""
        out = np.zeros(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        own = np.arange(len(words))
        rank = np.full(len(sym), NO_PAIR, dtype=np.int64)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = NO_PAIR
        while len(own):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_PAIR
            if done.any():
                out[own[done]] = sizes[done]
                stay = np.repeat(~done, sizes)
                own, sizes, least, sym, rank = own[~done], sizes[~done], least[~done], sym[stay], rank[stay]
                if not len(own):
                    break
            hit = rank == np.repeat(least, sizes)
            # of overlapping pairs (x x x) every second one, from the left; they can't reach into the next word
            at = np.flatnonzero(hit)
            begins = np.concatenate(([True], np.diff(at) > 1))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            word = np.repeat(np.arange(len(own)), sizes)
            sizes = sizes - np.bincount(word[at], minlength=len(own))
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            changed = np.zeros(len(sym), dtype=bool)
            changed[at] = True
            sym, rank, changed = sym[stay], rank[stay], changed[stay]
            # the pairs that a merged symbol is part of; the array's last symbol begins none
            redo = np.flatnonzero(changed[:-1] | changed[1:])
            rank[redo] = self.ranks(sym[redo], sym[redo + 1])
            rank[np.cumsum(sizes) - 1] = NO_PAIR
        return out

    def sparse(self, word: bytes) -> int:
        """The same for one long word: rounds over the pairs of the lowest rank, held by rank and by place."""
        sym = self.symbols(word).tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        places: dict[int, list[int]] = {}
        todo: list[int] = []

        def note(i: int) -> None:
            if i >= 0 and after[i] < len(sym):
                rank = self.by_pair.get(sym[i] * self.size + sym[after[i]])
                if rank is not None:
                    if rank not in places:
                        places[rank] = []
                        heapq.heappush(todo, rank)
                    places[rank].append(i)

        for i in range(len(sym) - 1):
            note(i)
        left = len(sym)
        while todo:
            rank = heapq.heappop(todo)
            for i in sorted(set(places.pop(rank))):
                j = after[i]
                # a place may have been merged away, or hold another pair by now
                if sym[i] < 0 or j >= len(sym) or self.by_pair.get(sym[i] * self.size + sym[j]) != rank:
                    continue
                sym[i], sym[j], after[i] = int(self.merged[rank]), -1, after[j]
                if after[i] < len(sym):
                    before[after[i]] = i
                left -= 1
                note(before[i])
                note(i)
        return left

    def counts(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        if short:
            out[short] = self.dense([words[i] for i in short])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.sparse(w)
        return out


def _class(kind: str) -> str:
    """The COMMON characters whose general category begins with kind, for a bracket expression."""
    common = re.compile(f"[{COMMON}]")
    found = [c for c in map(chr, range(0x2100)) if common.match(c) and unicodedata.category(c).startswith(kind)]
    return "".join(map(re.escape, found))


class Splitter:
    """text -> its pre-tokens, as the library's normaliser and pre-tokeniser give them, and how many added tokens it has."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.library = Tokenizer.from_str(text)
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take more than their characters are not known here")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = steps[0] if steps else {}
        known = [s.get("type") for s in steps] == ["Split", "ByteLevel"] and split.get("behavior") == "Removed" and split.get("invert") and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        if not known:
            raise ValueError("the file splits texts by other steps than a pattern and bytes")
        self.common = None
        if (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS:
            space = "".join(map(re.escape, "\t\n\x0b\x0c\r \x85\xa0"))
            pattern = split["pattern"]["Regex"].replace(r"\s", space).replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N"))
            self.words = re.compile(pattern).findall
            self.common = re.compile(f"[^{COMMON}]").search
        self.letters = tokens.byte_letters()

    def _by_library(self, text: str) -> list[str]:
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text) if self.library.normalizer else text)
        return [bytes(map(self.letters.__getitem__, w)).decode() for w, _ in found]

    def __call__(self, text: str) -> tuple[list[str], int]:
        parts = self.added.split(text) if self.added else [text]
        out: list[str] = []
        for part in parts:
            if self.common is None or not part.isascii() and self.common(part):
                out += self._by_library(part)
            else:
                out += self.words(part.lower())
        return out, len(parts) - 1


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Counter:
    """texts -> their token counts; keeps the counts of pre-tokens that it has met, KNOWN of them and one batch more at most."""

    def __init__(self, spec: str):
        self.merges, self.split = Merges(json.loads(spec)), Splitter(spec)
        self.number, self.found = _Numbered(), np.zeros(0, dtype=np.int64)

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):
            codes, more, chars = [], [], 0
            while at < len(texts) and (not codes or chars + len(texts[at]) <= BATCH_CHARS):
                words, n = self.split(texts[at])
                codes.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.uint32, count=len(words)))
                more.append(n)
                chars += len(texts[at])
                at += 1
            new = list(islice(self.number, len(self.found), None))
            self.found = np.concatenate((self.found, self.merges.counts([w.encode() for w in new])))
            out += [int(self.found[c].sum()) + n for c, n in zip(codes, more, strict=True)]
            if len(self.number) > KNOWN:
                self.number, self.found = _Numbered(), np.zeros(0, dtype=np.int64)
        return out


@cache
def counter(spec: str) -> Counter:
    """One for each worker process."""
    return Counter(spec)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every row of docs (doc_id, text)."""
    # a file of fixed size, as the vocabulary
    spec = docs.sparkSession.sparkContext.broadcast(tokens.spec_of_json(path or tokens.default_path("word_bpe_49k.json")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sys.intern(spec.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = count(texts)
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
