from pyspark.sql import functions as F


def test_stages_match_their_operators(spark, tiny):
    import corpus_pipeline
    from lodestitch.llm import minhash_neardup, quality_classifier, quality_rules
    from lodestitch.llm._common import stored
    from lodestitch.llm.queries import table, trusted

    docs = stored(table(spark, tiny, "documents"))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "minhash_neardup", "best_fit_packing"]

    first = stored(corpus_pipeline.classify(spark, docs, tiny))
    scored = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, table(spark, tiny, "labels")).collect()}
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {i for i, p in scored.items() if p}

    second = stored(corpus_pipeline.rules(spark, first, tiny))
    kept = {r.doc_id for r in quality_rules.quality(first, trusted(spark, tiny)).where("kept").collect()}
    assert second.columns == columns and {r.doc_id for r in second.collect()} == kept and kept

    third = stored(corpus_pipeline.dedup(spark, second, tiny))
    kept = {r.doc_id for r in minhash_neardup.near_duplicates(second).where("kept").collect()}
    assert third.columns == columns and {r.doc_id for r in third.collect()} == kept

    last = corpus_pipeline.pack(spark, third, tiny)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == kept


def test_stages_take_nulls_empty_texts_and_repeats(spark, tiny):
    import corpus_pipeline
    from lodestitch.llm._common import stored
    from lodestitch.llm.queries import table

    docs = table(spark, tiny, "documents")
    good = docs.where("text is not null").orderBy("doc_id").limit(60)
    kinds = dict(docs.dtypes)
    odd = spark.createDataFrame([(None, None), (900_001, None), (900_002, ""), (900_003, " \n "), (900_004, "one two three")], "doc_id long, text string")
    odd = odd.select(*[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(kinds[c]).alias(c) for c in docs.columns])
    rows = stored(good.unionByName(good).unionByName(odd))
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, rows, tiny))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            ids = [r.doc_id for r in out.where("doc_id < 900000").collect()]
            assert ids
        if name == "minhash_neardup":
            assert len(ids) == len(set(ids))
        if name == "quality_rules":
            assert out.where("doc_id is null or doc_id > 900000").count() == 0
    assert out.count() >= rows.count()


def test_stages_take_an_empty_table(spark, tiny):
    import corpus_pipeline
    from lodestitch.llm.queries import table

    none = table(spark, tiny, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tiny).count() == 0
