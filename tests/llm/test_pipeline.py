"""The pipeline on a small corpus: each stage against what it must do to its own input."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as corpus_queries
from ledgerloom.llm.quality import measure

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, frames = docs.columns, [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(f.columns == held for f in frames[:-1])
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:-1]]
    assert set(texts[1]) == {i for i, t in texts[0].items() if measure(t)[6]}
    assert set(texts[2]) <= set(texts[1]) and set(texts[3]) == set(texts[2]) and set(texts[4]) <= set(texts[3])
    assert not any("@" in t and ".example" in t.split("@")[1].split(" ")[0] for t in texts[3].values())
    packed = frames[-1]
    assert packed.select("doc_id").distinct().count() == len(texts[4])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(corpus_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    other = con.execute(corpus_queries.oracle_sql()[name])
    columns = [d[0] for d in other.description]
    mine = corpus_queries.queries()[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, mine.select(*columns).collect()), key=repr) == sorted(map(plain, other.fetchall()), key=repr)


NAMES = ("document", "quality", "skey", "dealt", "rep", "content", "digest", "extra", "epochs", "salt", "__size", "key", "c", "root", "kind", "start")


def case(spark, rows):
    """Documents of these rows (doc_id, text, source) with columns named as the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("n_chars", F.char_length("text")).withColumns({n: F.lit(n) for n in NAMES})


@pytest.mark.parametrize("name", ["mixed", "empty", "null"])
def test_stages_on_unusual_tables(spark, name):
    """Nulls in any column, empty and very long texts, repeated rows, ties, an empty table, clashing names."""
    import random

    pipeline = importlib.import_module("corpus_pipeline")
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long, one, two = prose(60_000), prose(80), prose(90)
    rows = {
        "mixed": [(1, one, "a"), (1, one, "a"), (2, one.upper(), "b"), (None, two, None), (None, two, None), (3, None, "a"), (4, "", None), (5, long, "b"), (6, prose(70) + " mail me@site.example.org", "a"), (1, prose(75), "a")],
        "empty": [],
        "null": [(None, None, None), (None, None, None), (7, None, None)],
    }[name]
    docs = case(spark, rows)
    stages = dict(pipeline.STAGES)
    good = stages["quality rules"](spark, docs, "")
    assert good.columns == docs.columns and sorted((r.doc_id, r.text) for r in good.collect() if r.doc_id) == sorted((i, t) for i, t, _ in rows if i and t and len(t.split()) >= 20)
    kept = stages["SimHash near-dedup"](spark, docs, "").select("doc_id", "text").collect()
    texts = {(t or "").lower() for _, t, _ in rows}
    assert len(kept) == len(texts) and {(r.text or "").lower() for r in kept} == texts
    clean = stages["PII"](spark, docs, "")
    assert clean.columns == docs.columns and sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(((i, t and t.replace("me@site.example.org", "[EMAIL]")) for i, t, _ in rows), key=repr)
    mixed = stages["mixing"](spark, docs, "")
    taken = mixed.collect()
    assert mixed.columns == docs.columns and all(r.text for r in taken) and {r.n_chars for r in taken} <= {len(t) for _, t, _ in rows if t}
    packed = stages["best-fit packing"](spark, docs, "").collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and all(r.offset + r.length <= 1024 for r in packed)
