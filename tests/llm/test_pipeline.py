"""The pipeline on a small corpus, each stage against a plain version of its own input."""

import corpus_pipeline
import duckdb
import pytest
from test_llm_operators import plain_components, plain_lines

from graphloom.llm import quality_classifier
from graphloom.llm.decontam import normal_words
from graphloom.llm.sql import OP7


@pytest.fixture
def corpus(spark, docs_of, prose, tmp_path):
    item = prose(900, 14)
    rows = [(i, prose(i, 90), f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, prose(i, 90).upper(), "s0") for i in range(20)]  # bad
    rows += [(200, prose(3, 90), "s1"), (201, prose(4, 90) + " tail", "s2"), (202, prose(901, 30) + " " + item.upper().replace("É", "é").replace("Ü", "ü"), "s1"), (203, prose(902, 40) + "\n" + prose(5, 90).split("\n")[0], None)]
    rows += [(300, None, "s0"), (301, "", "s1")]
    docs_of(rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), item


def test_stages(spark, corpus):
    where, item = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, where).cache()
        seen[name] = docs
        if name != "mix":
            assert docs.columns == before.columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            kept = quality_classifier.score(before, spark.read.parquet(f"{where}/labels.parquet")).where("_posterior < 0.5").collect()  # posteriors: test_odd_inputs
            assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == sorted((i, t) for i, t in got.items() if t)
            assert not any(100 <= i < 120 for i in got) and all(i in got for i in [*range(80), 200, 201, 202, 203])
        elif name == "lines":
            want, _ = plain_lines(rows)
            texts = dict(rows)
            assert got == {i: (t if texts[i] is not None else None) for i, t in want.items() if (t or "").split() or t == (texts[i] or "")}
        elif name == "near_duplicates":
            assert sorted(got) == sorted(i for i, c in plain_components(rows).items() if i == c)
        elif name == "decontamination":
            windows = {tuple(normal_words(item)[i : i + 10]) for i in range(5)}
            hit = lambda t: any(tuple(normal_words(t)[i : i + 10]) in windows for i in range(len(normal_words(t))))
            assert sorted(got) == sorted(i for i, t in rows if not hit(t)) and 202 not in got
    mixed = docs.groupBy("doc_id").count().collect()
    assert all(1 <= r["count"] <= 3 for r in mixed)
    documents = before.toPandas()  # noqa: F841  DuckDB reads it by name
    want = {i: taken // size for i, size, taken in duckdb.sql(f"SELECT doc_id, size, taken FROM ({OP7})").fetchall() if taken}
    assert {r["doc_id"]: r["count"] for r in mixed if r["doc_id"] not in (300, 301)} == want  # those two have no words to take
    again = sorted((r["doc_id"], r["copy"]) for r in corpus_pipeline.run(spark, where).collect())
    assert again == sorted((r["doc_id"], r["copy"]) for r in docs.collect())
