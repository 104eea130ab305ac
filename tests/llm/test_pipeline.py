import corpus_pipeline
from corroba.llm import decontaminate, langid, minhash, packing, secrets
from corroba.llm._common import materialise


def test_stages_take_effect_one_after_another(spark, sf_dir):
    """Each stage against what its operator tells of the same documents."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf_dir), name)
        before = {r.doc_id: r.text for r in docs.collect()}
        if name != "packing":
            assert out.dtypes == docs.dtypes
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            models = langid.fit(docs, F.lit(True))
            gone = {r.i for r in langid.identify(docs, models).filter("rejected").select(F.col("doc.doc_id").alias("i")).collect()}
            assert set(after) == set(before) - gone and len(after) > 0.95 * len(before)
        elif name == "near_dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(docs).filter("kept").collect()}
            assert set(after) == kept and len(after) < len(before)
        elif name == "decontamination":
            found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert set(after) == {r.i for r in found.filter("n_hit = 0").select(F.col("doc.doc_id").alias("i")).collect()} and len(after) < len(before)
        elif name == "secret_scan":
            found = {r.i: len(r.secrets) for r in secrets.find_secrets(docs).select(F.col("doc.doc_id").alias("i"), "secrets").collect()}
            assert set(after) == set(before) and all((after[i] != before[i]) == (n > 0) for i, n in found.items())
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(F.col("n") > packing.SEQUENCE).count() == 0
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_odd_rows(spark, sf_dir, odd, nothing):
    """Nulls in any column, blank and very long texts, repeated rows, clashing columns, no rows."""
    from pyspark.sql import functions as F

    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, nothing, sf_dir).count() == 0
        if name != "packing":
            assert stage(spark, odd, sf_dir).dtypes == odd.dtypes
    # without a label nothing is told and all stay
    assert stages["language_id"](spark, odd.withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == 10
    told = [r.doc_id for r in stages["language_id"](spark, odd, sf_dir).collect()]
    assert not {1, 2, 3} & set(told) and {4, 5, 6} <= set(told)
    assert sorted(r.doc_id or 0 for r in stages["near_dedup"](spark, odd, sf_dir).collect()) == [0, 1, 2, 3, 4, 6, 6, 7, 8]
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    leaky = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.lit(leak)).otherwise(F.col("text")))
    assert sorted(r.doc_id or 0 for r in stages["decontamination"](spark, leaky, sf_dir).collect()) == [0, 1, 2, 3, 4, 5, 6, 6, 8]
    secret = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.lit("password: abcdef1")).otherwise(F.col("text"))).withColumn("n_chars", F.lit(17).cast("long"))
    after = {r.doc_id: (r.text, r.n_chars) for r in stages["secret_scan"](spark, secret, sf_dir).collect()}
    assert after[7] == ("[assign]", 8) and after[1] == (None, 17)
    assert sorted(r.doc_id or 0 for r in stages["packing"](spark, odd.filter("n_chars IS NULL AND doc_id NOT IN (4, 5)"), sf_dir).collect()) == [1, 2, 3, 6, 6, 7, 8]
