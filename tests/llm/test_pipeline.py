"""The pipeline against brute force stages over the smallest documents."""

import os
import shutil

import corpus_pipeline
from pyspark.sql import functions as F

from evigrain.llm import pii

from .test_dedup import brute
from .test_operators import WORD_BPE, crc, ids, leaks


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000).orderBy("doc_id").limit(70)
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 !!"), (10**6 + 2, "mail me at a@b.org please friend")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    bench = "/root/testdata/sf0.001/benchmark.parquet"
    os.makedirs(f"{tmp_path}/sf")
    docs.coalesce(2).write.parquet(f"{tmp_path}/sf/documents.parquet")
    shutil.copy(bench, f"{tmp_path}/sf/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lettered = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    classes = brute(lettered, 5, 80)
    once = [(d, t) for d, t in lettered if classes[d][2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(bench).collect()]
    clean = [(d, t) for d, t in once if not next(iter(leaks([(d, t)], items, 10)))[5]]
    model = pii.trained()
    want = {}
    for d, t in clean:
        own = [*ids(WORD_BPE, pii.redact(t, pii.all_spans(t, model)[1])), 0]
        for k, s in enumerate(range(0, len(own), 2048)):
            want[d, k] = (s, len(own[s : s + 2048]), crc(own[s : s + 2048]))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()}
    assert got == want
