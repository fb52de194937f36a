"""The pipeline's stages, each on its own input, on a small corpus with planted cases."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_operators import ODD, SF, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    item = prose(777, 40)
    rows = [(k, prose(k, 80) + (" grobnak vilthud grobnak snargle" if k % 5 == 0 else ""), "en", "s", 0) for k in range(100, 300)]
    rows += [(400, prose(400, 80) + " " + item + " " + prose(401, 80), "en", "s", 0), (401, item, "en", "s", 0)]
    rows += [(500, prose(101, 80), "en", "s", 0), (501, prose(501, 50) + ' token = "0123456789abcdef0123456789abcdef"', "en", "s", 0)]
    spark.createDataFrame(rows + ODD, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100, 280)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == docs.columns
            out = corpus_pipeline.written(out, name)
        seen[name], docs = out, out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = ids(seen["toxicity"])
    assert not {k for k in range(100, 300) if k % 5 == 0} & kept and {k for k in range(100, 300) if k % 5} <= kept
    near = ids(seen["near_duplicates"])
    assert 101 in near and 500 not in near and 400 in near
    clean = seen["decontamination"]
    assert 401 not in ids(clean) and prose(777, 40)[:60] not in clean.filter("doc_id = 400").first().text
    assert "[assign]" in seen["secrets"].filter("doc_id = 501").first().text
    assert seen["packing"].select(F.countDistinct("doc_id")).first()[0] == seen["secrets"].select(F.countDistinct("doc_id")).first()[0]


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"
