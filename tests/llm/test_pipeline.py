"""The pipeline's stages, one after another, against plain versions of what each decides."""

import re

import corpus_pipeline as pipeline
from test_neardup import expected

from tallywing.session import work_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        path = work_dir(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = before.collect(), docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    given, left = kept["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r for r in given if labels.get(r.doc_id) == 1]
    assert set(left) <= set(given) and len(set(good) & set(left)) >= 0.95 * len(good)
    given, left = kept["minhash near-dedup"]
    parts = expected([(r.doc_id, r.text) for r in given], 5)
    assert {r.doc_id for r in left} == {d for d, _, c in parts if d == c} and set(left) <= set(given)
    given, left = kept["benchmark decontamination"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in given if any(i in " ".join(r.text.lower().split()) for i in items)}
    gone = {r.doc_id for r in given} - {r.doc_id for r in left}
    assert whole <= gone and len(gone) <= len(whole) + 2
    given, left = kept["personal data"]
    texts = {r.doc_id: r.text for r in given}
    assert len(left) == len(given) and not any(re.search(r"\w@\w+\.\w", r.text) for r in left)
    assert all(r.text == texts[r.doc_id] or re.search("<(EMAIL|IP|CARD|PHONE)>", r.text) for r in left)
    given, pieces = kept["best-fit packing"]
    assert {p.doc_id for p in pieces} == {r.doc_id for r in given}
    assert all(p.offset + p.length <= 4096 and len(p.ids) == 4 * p.length for p in pieces)
