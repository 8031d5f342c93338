"""The pipeline's stages, each against the operator's verdict on its own input."""

import corpus_pipeline
from tests.conftest import SF
from tremolo.llm import decontam, mixing, near, quality
from tremolo.llm.common import stage


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    steps = dict(corpus_pipeline.STAGES)
    good = stage(steps["quality"](spark, docs, SF), "t")
    assert ids(good) == ids(quality.score_documents(docs, quality.fitted(spark, SF)).where("predicted = 1"))
    one = stage(steps["near_duplicates"](spark, good, SF), "t")
    assert ids(one) == sorted({r["class_id"] for r in near.near_classes(good).collect()})
    clean = stage(steps["decontamination"](spark, one, SF), "t")
    assert ids(clean) == ids(decontam.contamination(one, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated"))
    mix = stage(steps["mixing"](spark, clean, SF), "t")
    assert ids(mix) == sorted(r["doc_id"] for r in mixing.mix_counts(clean).collect() for _ in range(r["copies"]))
    assert good.columns == one.columns == clean.columns == mix.columns == docs.columns
    last = steps["token_ids"](spark, mix, SF)
    assert ids(last) == ids(mix)
