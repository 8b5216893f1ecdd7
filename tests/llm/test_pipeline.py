import importlib
import json
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np

import corpus_pipeline
from attesta.llm import tokens
from tests.llm import plain

TOP = Path(__file__).resolve().parents[2]
SHARED = "a licence line that a good many of the documents have in common"


def words(n, r):
    return " ".join("".join(r.choices("abcdefghijklm", k=6)) for _ in range(n))


def made():
    r = random.Random(3)
    out = []
    for i in range(40):
        t = words(40, r) + "\n" + (SHARED if i % 3 else words(9, r)) + "\n" + words(12, r)
        out.append((i, t))
    out += [(50, out[4][1]), (51, out[4][1].replace(" ", "  ", 1)), (52, " ".join([*out[7][1].split(" ")[:-1], "changed"])), (60, "short"), (61, None), (62, words(6, r) * 1 + " again and again" * 20)]
    out += [(70, words(30, r) + ' password="hunter2222" ' + words(5, r)), (71, words(30, r) + " " + "0f" * 20)]
    return out


def masked(text):
    cuts, out, at = [tuple(map(int, s.split(":")[1:])) for s in plain.secrets(text)[0]], "", 0
    for a, b in sorted(cuts):
        if b > at:
            out += text[at : max(a, at)] + "[redacted]"
            at = b
    return out + text[at:]


def test_against_plain_version(spark, tmp_path):
    rows = made()
    spark.createDataFrame([(d, t, "en", f"s{d % 3}", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(d, t) for d, t in rows if not plain.measures(t)[-1]]
    dropped = {d: g for d, _, g, _ in plain.lines_kept(kept)}
    assert sum(dropped.values()) > 20
    lines = lambda d, t: "\n".join(x for x in t.split("\n") if not (dropped[d] and x == SHARED))
    kept = [(d, lines(d, t)) for d, t in kept]
    roots = plain.components(kept, 5, 80)
    kept = [(d, masked(t)) for d, t in kept if roots[d] == d]
    assert {50, 51, 60, 61, 62}.isdisjoint(d for d, _ in kept)
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=tokens.SPLIT, mergeable_ranks={t: i for i, t in enumerate(tokens.ranks_of_tiktoken(tokens.default_path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {d for d, _ in kept}
    for d, t in kept:
        ids, at = np.array([*library.encode_ordinary(t), 0], dtype="<u4"), 0
        for r in sorted(got[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) == r["doc_tokens"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    r = random.Random(8)
    long, plain_text = words(60_000, r), words(40, r)
    clash = "n_words long, _w string, kept string, key string, host string, _row string, _id long, gone string, cid long, linked boolean"
    rows = [(1, plain_text), (1, plain_text), (2, plain_text), (None, words(30, r)), (None, words(30, r)), (3, long), (4, None), (5, ""), (6, words(30, r) + " secret=abcdefgh")]
    full = [(d, t, "en", None if d == 3 else "s", None if t is None else len(t), 1, "w", "k", "key", "h", "row", 7, "g", 9, True) for d, t in rows]
    spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {clash}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    # repeated rows both stay, as they are one document; the null ids are one document too
    assert sorted(((d is not None, d or 0) for d in [x["doc_id"] for x in docs.select("doc_id").collect()])) == [(False, 0), (False, 0), (True, 1), (True, 1), (True, 3), (True, 6)]
    assert [x["text"] for x in docs.where("doc_id = 6").collect()][0].endswith("[redacted]")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == {None, 1, 3, 6} and sum(x["length"] for x in got if x["doc_id"] == 3) == next(x["doc_tokens"] for x in got if x["doc_id"] == 3) > 60_000


def test_stages_leave_nothing_behind(spark, tmp_path):
    from attesta.plans.tables import shared_dir

    base = Path(shared_dir(spark).removeprefix("file://"), "tables")
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in made()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(base.glob("*/*")) if base.exists() else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {p.name for p in set(base.glob("*/*")) - before} == {"packing"} and out.count() > 0


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, words(20, random.Random(1)), "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "secret_scan", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 1


def test_entry_without_the_subpackage(tmp_path):
    """Without the folder and the pipeline the entry still imports and has the other queries."""
    for name in ("attesta", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(TOP / name) if name.endswith(".py") else None
    (tmp_path / "attesta").mkdir()
    for p in (TOP / "attesta").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "attesta" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    queries, sql = json.loads(said.stdout)
    assert "delta_findings" in queries and not any(n.startswith("op") or n == "pipeline" for n in [*queries, *sql])
    entry = importlib.import_module("__spark_entry__")
    assert {n for n in entry.queries() if n.startswith("op")} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
