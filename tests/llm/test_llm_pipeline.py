"""The pipeline's stages on a small table against what each operator says, and the registered queries' SQL."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as catalogue
import corpus_pipeline
from plumbline.llm import exact_dedup, queries, secret_scan, simhash_dedup
from plumbline.plans.common import TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["river", "quiet", "stone", "bread", "letter", "walks", "under", "green", "the", "of"]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 90))) + "." for _ in range(500)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(600 + i, "spam " * 60, "en", "s0", 300) for i in range(60)]
    rows += [(700 + i, texts[i], "en", "s1", len(texts[i])) for i in range(40)]  # exact copies
    rows += [(800 + i, texts[i] + " stone", "en", "s1", len(texts[i]) + 6) for i in range(20)]
    rows += [(900, " ".join(rng.choices(words, k=70)) + " password=hunter2hunter2 end", "en", "s2", 1), (901, None, None, None, None), (None, texts[91] + " lost", "en", "s2", 3)]
    labels = [(i, int(i < 600), 0) for i in [*range(0, 500, 2), *range(600, 660)]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "secrets", "packing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
        ids = sorted((r.doc_id for r in docs.select("doc_id").distinct().collect()), key=str)
        if name == "quality":
            assert not any(i is not None and 600 <= i < 660 for i in ids) and sum(i is not None and i < 500 for i in ids) >= 495
        elif name == "exact_dedup":
            kept = exact_dedup.exact_dedup(before, "largest").where("kept").collect()
            assert ids == sorted((r.doc_id for r in kept), key=str) and 0 not in ids and 700 in ids
        elif name == "simhash_dedup":
            found = simhash_dedup.near_duplicates(before).collect()
            assert ids == sorted({r.component_id for r in found}, key=str)
        elif name == "secrets":
            assert docs.count() == before.count()
            text = {r.doc_id: r for r in docs.collect()}
            assert "[SECRET]" in text[900].text and "hunter2" not in text[900].text and text[900].n_chars == len(text[900].text)
            assert not any(re.search(secret_scan.RULES[0].pattern, r.text or "") for r in text.values())
            assert {r.doc_id: r.text for r in before.where("doc_id <> 900").collect()} == {i: r.text for i, r in text.items() if i not in (900, None)}
        else:
            assert ids == sorted((r.doc_id for r in before.select("doc_id").collect()), key=str)
    run = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, run.select(columns).collect())) == sorted(map(str, seen["packing"].select(columns).collect()))


def test_all_eleven_are_registered():
    names = catalogue.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
