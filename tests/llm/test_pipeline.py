"""The pipeline's stages, each on what the one before it keeps."""

from hashlib import sha256

import corpus_pipeline
import numpy as np
import pytest
import tokenizers
from corpusloom.llm import bpe, simhash, toxicity
from corpusloom.session import stage_table
from pyspark.sql import functions as F

import __spark_entry__

from . import cases

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_stages_keep_columns(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == kept["documents"].columns


def test_each_stage_works_on_its_own_input(spark, kept):
    chain = toxicity.fit_labels(kept["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(kept["documents"], chain).where("p_toxic >= 0.5").collect()}
    every = {r.doc_id for r in kept["documents"].collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == every - toxic
    assert {r.doc_id for r in kept["line_dedup"].collect()} == every - toxic
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in kept["line_dedup"].collect()}
    stay = {r.doc_id for r in kept["simhash"].collect()}
    assert all(d in stay or any(s < d and (p ^ prints[s]).bit_count() <= 3 for s in prints) for d, p in prints.items())
    assert not any(a < b and (prints[a] ^ prints[b]).bit_count() <= 3 for a in stay for b in stay)
    times = {r.doc_id: r["count"] for r in kept["mix"].groupBy("doc_id").count().collect()}
    assert set(times) <= stay and max(times.values()) <= 2
    assert kept["bpe"].count() == sum(times.values())
    library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    mixed = {r.doc_id: r.text or "" for r in kept["mix"].collect()}
    for r in kept["bpe"].collect()[:60]:
        ids = library.encode(mixed[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_stages_handle_odd_input(spark):
    """Nulls, repeats, clashing names and empty tables go through every stage."""
    df = cases.awkward(spark)
    for name in ("row", "text_hash", "_lines", "_dropped", "keys", "_may", "_own", "_hash"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    for docs, n in ((df, len(cases.rows())), (df.limit(0), 0)):
        start = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage_table(stage(spark, docs, SF), name)
            if name in ("toxicity", "line_dedup"):
                assert out.count() == n
            if name != "bpe":
                assert out.columns == start.columns
            docs = out
