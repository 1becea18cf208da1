"""The pipeline against a plain version of its stages."""

from collections import Counter

from test_operators import brute_components, norm

import corpus_pipeline
from factloom.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    data = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in quality.judged(docs, quality.train(docs, labels)).where("kept").collect()}
    first = {}
    for i in sorted(kept):
        first.setdefault(norm(data[i].text), i)
    unique = set(first.values())
    comp = brute_components([(i, data[i].text) for i in unique], k=5, num=80)
    one = {i for i, (_, c) in comp.items() if c == i}

    frame = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SMALL)
        assert frame.columns == docs.columns
        seen.append(Counter(r.doc_id for r in frame.collect()))
    assert set(seen[0]) == kept and set(seen[1]) == unique and set(seen[2]) == one
    assert set(seen[3]) <= one and max(seen[3].values()) <= 3
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    copies = packed.groupby("doc_id").apply(lambda g: g.length.sum() / g.doc_tokens.iloc[0], include_groups=False)
    assert {i: round(c) for i, c in copies.items()} == dict(seen[3])
