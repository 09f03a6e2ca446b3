"""The pipeline's stages one after another on small fixtures with known answers."""

import corpus_pipeline
import pytest


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    ran = corpus_pipeline.run(spark, sf)
    digest = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert digest(packed) == digest(ran)
    assert {d for d, *_ in digest(ran)} == {r.doc_id for r in docs.collect()}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "A plain sentence of some words, which any reader can follow without trouble. " * 4


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    """Nulls, empty and long texts, repeats and clashing columns, and tables without rows."""
    leak = "what is the sum of all the numbers from one to one hundred taken together"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, GOOD, "en", "s", 9), (4, GOOD, "en", "s", 9), (4, GOOD, "en", "s", 9), (5, GOOD * 300, "en", None, 1), (None, GOOD, "en", "s", 1), (6, f"{GOOD}{leak} and more {GOOD}", "en", "s", 1)]
    docs = spark.createDataFrame([] if empty else rows, DOCS).selectExpr("*", "1 AS tid", "2 AS key", "'x' AS _drop", "3 AS _doc")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(3, 1, 0), (4, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        stages[name] = sorted((r.doc_id or 0) for r in kept.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(packed[packed.piece == 0].doc_id.fillna(0).astype(int)) == stages["benchmark_decontamination"]
    if empty:
        assert not len(packed)
    else:
        near = stages["minhash_near_dedup"]
        assert near.count(4) == 0 and 6 in near and 6 not in stages["benchmark_decontamination"] and {0, 3} <= set(near)
