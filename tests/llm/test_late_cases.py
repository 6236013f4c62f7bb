"""The newest operators and the pipeline's stages over empty tables and columns with clashing names."""

import corpus_pipeline
from voxtally.llm import jaccard, search, spelling


def test_pipeline_over_empty_tables_and_clashing_columns(spark, tmp_path):
    for rows in (0, 6):
        base = str(tmp_path / f"sf{rows}")
        docs = spark.range(rows).selectExpr("id AS doc_id", "concat('some words of text number ', id, ' and more') AS text", "'en' AS lang", "concat('s', id % 2) AS source", "id AS n_chars", "id AS tie", "'x' AS fp", "1 AS size")
        docs.write.parquet(f"{base}/documents.parquet")
        spark.range(0).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic").write.parquet(f"{base}/labels.parquet")
        spark.range(0).selectExpr("id AS item_id", "'' AS text").write.parquet(f"{base}/benchmark.parquet")
        out = corpus_pipeline.run(spark, base).collect()
        assert {x.doc_id for x in out} <= set(range(rows)) and bool(out) == bool(rows)


def test_new_operators_over_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, "a", 1, 2)] * 3, "doc_id long, text string, word string, n long, unit long")
    items = spark.createDataFrame([(None, None, 1)] * 2, "item_id long, text string, item long")
    assert spelling.variants(docs).count() == 0 and search.search(docs, items).count() == 0
    assert [tuple(x) for x in jaccard.near_duplicates(docs).collect()] == [(None, 0, None)] * 3
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
