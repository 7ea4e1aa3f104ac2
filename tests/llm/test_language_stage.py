import corpus_pipeline


def test_texts_in_no_learned_language_go(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。", "!!! *** 12 x ### 99 %%",
           "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "xqzv kjwq zzxv qqpw vbnk wxqz"]
    more = spark.createDataFrame([(10_000 + k, t, None, "src0", len(t)) for k, t in enumerate(odd)], source.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, source.unionByName(more), "").collect()}
    clean = {r.doc_id for r in source.filter("text IS NOT NULL AND lower(text) <> upper(text)").collect()}
    assert kept == clean
