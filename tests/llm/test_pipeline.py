"""The pipeline's stages against what the operators say of the same rows."""

import os

import pytest

import corpus_pipeline
from pairloom.llm import quality, toxicity
from pairloom.llm.decontamination import decontaminate
from pairloom.plans.scratch import materialise

DATA = "/root/testdata/sf0.001"


def plain_kept(rows):
    """Least id of each group of texts linked by a Jaccard similarity of 0.8 of five-word shingles; pairs by brute force."""

    def shingles(t):
        w = (t or "").lower().encode().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([None])

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    ids = lambda df, where: {x.doc_id for x in df.where(where).select("doc_id").collect()}
    verdicts = {
        "toxicity": lambda d: ids(toxicity.score_toxicity(d, toxicity.learn(d, labels)), "predicted = 0"),
        "quality": lambda d: ids(quality.score_quality(d, quality.learn(d, labels)), "predicted = 1"),
        "near_duplicates": lambda d: set(plain_kept([(x.doc_id, x.text) for x in d.collect()])),
        "decontamination": lambda d: ids(decontaminate(d, bench), "not contaminated"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = verdicts[name](docs)
        kept = materialise(stage(spark, docs, DATA), name)
        assert kept.columns == docs.columns
        assert ids(kept, "true") == want and kept.count() == len(want)
        docs = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert ids(pieces, "true") == ids(docs, "true")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]


def test_empty_documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the tables aren't here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
