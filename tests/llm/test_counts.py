"""Token counts, source divergence and phrases, against the library or plain versions."""

import json
import random
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import divergence, phrases, token_counts
from tests.llm.test_operators import DOCS, ODD, docs, rows_of, some, words

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def count():
    return token_counts.Counter(SPEC)


def test_common_characters_count_as_in_the_library(count):
    common = re.compile(f"[{token_counts.COMMON}]")
    texts = [f"a{c}b1{c}{c}!{c} {c}'s'{c} I{c}'LL" for c in map(chr, range(0x2100)) if common.match(c)]
    assert count(texts) == library(texts)


SIGNS = "abcdefghe '\"!.#1234  \n\tÀéñßçœüİſΣσςа日本かが́̈ﬁ①👍🏽\x1c\x1f\xa0 \u0085​<|>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(SIGNS, max_size=80), st.text(max_size=40)), min_size=1, max_size=8))
def test_any_text_counts_as_in_the_library(texts):
    count = token_counts.counter(SPEC)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert count(texts) == library(texts)


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000 + "c", "the" * 4000, "é" * 999, "aaaa" * 70, "".join(random.Random(3).choices("etaoinshrdlu", k=20_000))])
def test_long_words(count, word):
    merges = count.merges
    raw = word.encode()
    assert count([word, f"{word} x"]) == library([word, f"{word} x"])
    assert merges.sparse(raw[:600]) == merges.dense([raw[:600]])[0]


def test_added_tokens_in_texts(count):
    texts = ["<|endoftext|>a<|startoftext|><|endoftext|> b <|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext|", "x<|endoftext|>y"]
    assert count(texts) == library(texts)


def test_other_files_are_refused():
    spec = json.loads(SPEC)
    merges = spec["model"]["merges"]
    for change in ({"dropout": 0.1}, {"type": "WordPiece"}, {"merges": merges[::-1]}, {"merges": [*merges, merges[0]]}):
        with pytest.raises(ValueError):
            token_counts.Merges({"model": spec["model"] | change})
    with pytest.raises(ValueError):
        token_counts.Splitter(json.dumps(spec | {"pre_tokenizer": None}))


def test_counts_do_not_depend_on_batches(monkeypatch):
    texts = [t or "" for _, t in ODD]
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 100)
    monkeypatch.setattr(token_counts, "KNOWN", 5)
    assert token_counts.Counter(SPEC)(texts) == library(texts)


def test_token_counts(spark):
    rows = [*ODD, (None, "<|endoftext|>"), (60, "日本 か゛ " * 300), (61, "word " * 2049), (62, "word " * 2048)]
    n = library([t for _, t in rows])
    want = [(d, len((t or "").encode()), k, k > 2048) for (d, t), k in zip(rows, n, strict=True)]
    got = token_counts.token_counts(docs(spark, rows))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and some(rows_of(got)) == some(want)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def plain_divergence(rows, least, top):
    """rows: lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall(lower(text))
        n[lang, source].update(terms)
        n[lang].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, d in held[lang].items() if d >= least]
        sources = {r[1] for r in rows if r[0] == lang}

        def shares(key, kept=kept):
            total = sum(n[key][t] for t in kept)
            return {t: 1 + 10**9 * (n[key][t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, all_ = {s: shares((lang, s)) for s in sources}, shares(lang)
        for s in sources:
            pairs = [(x, sum(abs(own[s][t] - own[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, own[s][t] - all_[t]) for t in kept if n[lang, s][t] and own[s][t] > all_[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(islice(items, most), 1)]
    return out


def labelled(spark, rows):
    """lang, source, text as documents; doc_ids repeat and are null."""
    return spark.createDataFrame([(i % 3 or None, t, lang, source, 0, 7, "w", "k", 0.5, 1, "key", "h", "r") for i, (lang, source, t) in enumerate(rows)], DOCS)


def spoken(n, seed, langs=("en", "de", None), sources=("a", "b", "é", None, "c")):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lang, source = r.choice(langs), r.choice(sources)
        vocabulary = ["The", "the", "of", "and", "x" * r.randint(1, 4), "Ärger", "ärger", "日本", f"{source}word", "one-two", "a1b", "\x80q"]
        out.append((lang, source, r.choice([" ", "\n", ", "]).join(r.choices(vocabulary, k=r.randint(0, 25)))))
    return [*out, ("lone", "only", "the the"), ("none", "p", None), ("none", "q", ""), ("", "empty lang", "the"), ("en", "silent", "1 2 3"), ("de", "long", "The " * 50_000)]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 50), (2, 30, 3), (3, 1, 2)])
def test_divergence(spark, seed, least, top):
    rows = spoken(150, seed)
    got = divergence.divergence(labelled(spark, rows), min_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(rows_of(got)) == sorted(plain_divergence(rows, least, top))


def test_divergence_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART", 2)
    rows = spoken(200, 7, sources=tuple(f"s{i}" for i in range(23)))
    got = divergence.divergence(labelled(spark, rows), min_docs=2, block=4)
    assert sorted(rows_of(got)) == sorted(plain_divergence(rows, 2, 50))


def test_divergence_of_repeated_rows(spark):
    rows = spoken(40, 9) * 3
    assert sorted(rows_of(divergence.divergence(labelled(spark, rows), min_docs=6))) == sorted(plain_divergence(rows, 6, 50))


def test_shares_are_exact():
    n, below = np.array([0, 1, 10**12, 8 * 10**15 - 5, 5]), np.array([1, 7, 9 * 10**15 - 1, 8 * 10**15, 10**6])
    n = np.minimum(n, below - 5).clip(0)
    assert divergence.shares(n, below).tolist() == [1 + 10**9 * (a + 5) // b for a, b in zip(n.tolist(), below.tolist(), strict=True)]


def test_wide_shares_in_columns(spark):
    df = spark.sql("select 3000000000000000 as n, 9000000000000000000 as total, 1000 as v").select(divergence.share("n", "total", "v").alias("p"))
    assert df.first()["p"] == 1 + 10**9 * (3 * 10**15 + 5) // (9 * 10**18 + 5000)


def plain_phrases(rows, least, top):
    """rows: lang, source, text."""
    f, total = defaultdict(Counter), Counter()
    for lang, _, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside[q], a)
        scored = []
        for p, a in cands.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 50 * a:
                scored.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], total[lang], score))
        scored.sort(key=lambda s: (-s[5], -s[1], s[0].encode()))
        out += [(lang, rank, *s) for rank, s in enumerate(scored[:top], 1)]
    return out


def said(n, seed):
    r = random.Random(seed)
    vocabulary = ["New", "york", "NEW", "city", "the", "The", "of", "é", "日本", "a\x0bb", "x\xa0y", "q\x1cr", *"abcdefgh"]
    texts = [r.choice([" ", "  ", "\t", " \t "]).join(r.choice([w, w, w, w + ".", "new york city", w + ",x"]) for w in r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(n)]
    rows = [(r.choice(["en", "en", "de", None, "und"]), "s", t) for t in texts]
    return [*rows, ("en", "s", None), ("en", "s", ""), ("fr", "s", " \t. "), ("de", "s", "over and over " * 20_000), ("de", "s", "a " * 9 + "a")]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 10, 2000), (2, 2, 2000), (3, 3, 7)])
def test_phrases(spark, seed, least, top):
    rows = said(120, seed)
    got = phrases.phrases(labelled(spark, rows), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(rows_of(got)) == sorted(plain_phrases(rows, least, top))


def test_phrases_in_many_blocks_and_ranges(spark):
    rows = said(150, 5)
    got = phrases.phrases(labelled(spark, rows), least=2, block_bytes=500, chunk_keys=7, range_keys=40)
    assert sorted(rows_of(got)) == sorted(plain_phrases(rows, 2, 2000))


def test_phrases_of_one_third_in_one_pair(spark):
    """A pair with a third of all occurrences is one key of each block."""
    rows = [("en", "s", " ".join(["hot pair"] * 30) + " " + words(30, i)) for i in range(60)]
    got = phrases.phrases(labelled(spark, rows), least=10, block_bytes=2000, chunk_keys=20, range_keys=60)
    assert sorted(rows_of(got)) == sorted(plain_phrases(rows, 10, 2000))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**32 - 1)), max_size=80))
def test_radix_sort(keys):
    keys += keys[:3]
    head, tail, n = phrases.counted(np.array([k[0] for k in keys], dtype=np.uint64), np.array([k[1] for k in keys], dtype=np.uint32))
    assert list(zip(head.tolist(), tail.tolist(), n.tolist(), strict=True)) == sorted((*k, c) for k, c in Counter(keys).items())
    if keys:
        back = phrases._keys(phrases._chunk(head, tail, n))
        assert [x.tolist() for x in back] == [head.tolist(), tail.tolist(), n.tolist()]


def test_scores_of_long_counts(spark):
    a, l, r = 9 * 10**12, 10**13, 3 * 10**13  # noqa: E741
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s"))
    assert df.first()["s"] == 10**6 * a * a // (l * r)


@pytest.mark.parametrize("f", [token_counts.token_counts, divergence.divergence, phrases.phrases], ids=lambda f: f.__name__)
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).count() == 0


@pytest.mark.parametrize("f", [divergence.divergence, phrases.phrases], ids=lambda f: f.__name__)
def test_odd_rows(spark, f):
    plain = plain_divergence if f is divergence.divergence else plain_phrases
    rows = [("en", "s", t) for _, t in ODD]
    least, top = (30, 50) if f is divergence.divergence else (10, 2000)
    assert sorted(rows_of(f(docs(spark, ODD)))) == sorted(plain(rows, least, top))
