"""Brute-force versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def measures(text):
    t = text or ""
    ws = WORD.findall(t)
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def lines_kept(docs, least=40, docs_at_least=5):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc_id, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least and doc_id is not None:
                holders.setdefault(key(x), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        ls = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= docs_at_least and doc_id != max(holders[key(x)]) for x in ls]
        out.append((doc_id, len(ls), sum(gone), sha("\n".join(x for x, g in zip(ls, gone, strict=True) if not g))))
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    t = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [s for *_, s in sorted(found)], [sum(k == i for _, k, _ in found) for i in range(3)]


def shingles(text, size):
    ws = WORD.findall(lower(text or ""))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()


def components(docs, size, percent):
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d, _ in docs}


def maximal(convs):
    """convs: id -> list of (role, text). The smallest id of each conversation that no longer one begins with."""
    out = {}
    for c, said in convs.items():
        if not any(len(o) > len(said) and o[: len(said)] == said for o in convs.values()):
            out.setdefault(tuple(said), []).append(c)
    return {min(cs): len(cs) for cs in out.values()}


def stems(train):
    """Stems of (text, toxic) pairs by their counts in documents."""
    import math

    from attesta.llm import toxicity as t

    seen = [{x for w in t.TOKEN.findall((text or "").lower()) if w[0].isalpha() for x in [w + "$", *(w[:n] for n in t.STEMS if len(w) >= n)]} for text, _ in train]
    sizes = [sum(y == v for _, y in train) for v in (0, 1)]
    out = {}
    for stem in set().union(*seen):
        clean, toxic = (sum(stem in s for s, (_, y) in zip(seen, train, strict=True) if y == v) for v in (0, 1))
        odds = ((toxic + 0.5) / (sizes[1] + 1)) / ((clean + 0.5) / (sizes[0] + 1))
        if toxic >= t.MIN_TOXIC and odds >= t.MIN_ODDS:
            out[stem] = min(1.0, math.log(odds) / 6)
    return out


def clauses(text, learnt):
    """The score of each clause with a word: every insult and threat is weighed by what stands around it."""
    from attesta.llm import toxicity as t

    def kind(word):
        return next((c for c, ws in t.SEEDS.items() if word in ws.split()), None) or (t.INSULT if learning(word) else t.OTHER)

    def learning(word):
        return max((v for k, v in learnt.items() if word + "$" == k or (len(k) in t.STEMS and word.startswith(k))), default=0.0)

    out = []
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        if not words:
            continue
        ks, total = [kind(w) for w in words], 0.0
        for i, k in enumerate(ks):
            aimed = any(x == t.TARGET for x in ks[max(0, i - 5) : i + 6])
            denied, told = t.NEGATION in ks[max(0, i - 3) : i], t.REPORT in ks[:i]
            if k == t.INSULT:
                seed = any(words[i] in ws.split() for ws in t.SEEDS.values())
                total += (1.0 if seed else learning(words[i])) * (1.25 if aimed else 1) * (0.5 if denied else 1) * (0.6 if told else 1)
            elif k == t.THREAT and aimed:
                total += (0.25 if denied else 1) * (0.4 if told else 1)
        out.append(total)
    return out


def toxic_score(text, learnt, w):
    import math

    scores = clauses(text, learnt)
    hit = sorted(s for s in scores if s > 0)
    f = [math.log1p(sum(hit)), hit[-1], math.log1p(len(hit)), math.log1p(100 * sum(hit) / (len(scores) + 5)), math.log1p(sum(hit[-3:]))] if hit else [0.0] * 5
    return 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(w[1:], f, strict=True)))))


def spark_hash(text):
    """The engine's 64-bit hash of a string, as a signed number."""
    import xxhash

    return signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text):
    """128 bits, and whether there is no term: every term's weight counts for or against each bit."""
    import xxhash

    hash64 = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed=seed)
    ws = WORD.findall(text or "")
    terms = [(hash64(b.encode(), hash64(a.encode(), 42)), len(a) + len(b)) for a, b in zip(ws, ws[1:])] if len(ws) > 1 else [(hash64(w.encode(), 42), len(w)) for w in ws]  # noqa: B905
    votes, total = [0] * 128, 0
    for h, n in terms:
        weight = 3 if n > 14 else 2 if n > 8 else 1
        a = (h & ~3) | weight
        b = hash64(a.to_bytes(8, "little"), 42)
        total += weight
        for i in range(64):
            votes[i] += weight * (a >> i & 1)
            votes[64 + i] += weight * (b >> i & 1)
    return sum(1 << i for i, v in enumerate(votes) if 2 * v > total), not terms


def like(a, b):
    import math

    d = (a[0] ^ b[0]).bit_count()
    return 0.0 if a[1] != b[1] else 1.0 if d == 0 else max(0.0, math.cos(math.pi * d / 128))


def simhash(rows):
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of each row."""
    order = sorted({(d is not None, d or 0, spark_hash(t or ""), t or "") for d, t in rows})
    made = {}
    for i, (known, d, _, t) in enumerate(order):
        after = order[(i + 1) % len(order)][3]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, beside = fingerprint(t), fingerprint(edited), fingerprint(after)
        made[(d if known else None, t)] = (d if known else None, len(t), sha(edited), f"{own[0]:032x}", f"{changed[0]:032x}", round(like(own, changed), 9), round(like(own, beside), 9))
    return [made[(d, t or "")] for d, t in rows]


def statistics(text):
    """What the trees look at, in the order of their names."""
    import math

    t = text or ""
    n_words, word_chars, symbols, dups, repeats, _ = measures(t)
    ws, ks, n = WORD.findall(t), len(t.split("\n")), len(t)
    w, c = max(n_words, 1), max(n, 1)
    count = lambda chars: sum(x in chars for x in t)
    return [
        math.log1p(n), math.log1p(n_words), word_chars / w, symbols / w, count("|") / w, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, count("0123456789") / c, count("!") / w, count(".") / w,
        count(",") / w, ks / w, dups / ks, repeats / w, len(set(ws)) / w, max(map(len, ws), default=0), sum(len(x) <= 3 for x in ws) / w, math.log1p(n / ks), count("()[]{}\"'/\\@=_~^`:;?") / w,
    ]


def walked(trees, x):
    """The score of one row, each tree walked from its root by its children's places."""
    import math

    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-total))
