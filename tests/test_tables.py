from pathlib import Path

from attesta.plans import tables


def test_scope_drops_what_nobody_reads_any_more(spark):
    base = Path(tables.shared_dir(spark).removeprefix("file://"), "tables")
    before = set(base.glob("*/*")) if base.exists() else set()
    with tables.scope(spark):
        with tables.scope(spark, keep=("out",)):
            inner = tables.written(spark.range(5), "inner")
            out = tables.written(inner.where("id > 2"), "out")
        assert {p.name for p in set(base.glob("*/*")) - before} == {"out"} and out.count() == 2
    assert set(base.glob("*/*")) == before
    kept = tables.written(spark.range(3), "free")
    assert kept.count() == 3 and {p.name for p in set(base.glob("*/*")) - before} == {"free"}
