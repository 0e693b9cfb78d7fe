"""Bucketed store, set manifests and the call ledger."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stubs import hashing_embedder
from corpusloom.operators import ledger
from corpusloom.operators import scoring as so
from corpusloom.sources import io, manifest
from corpusloom.sources.store import EmbeddingStore


def _store(spark, rows, name="t-store"):
    store = EmbeddingStore(spark, io.scratch_path(spark, name), "h4")
    store.append(spark.createDataFrame(rows, "content_key string, embedding array<double>"))
    return store


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _children(plan):
    seq = plan.children()
    return [seq.apply(i) for i in range(seq.size())]


def _exchanged_scans(plan, under=False):
    """Whether each bucketed scan of the plan lies below an exchange."""
    name = plan.nodeName()
    if name.startswith("Scan") and "Bucketed: true" in plan.toString():
        return [under]
    if name == "AdaptiveSparkPlan":
        return _exchanged_scans(plan.executedPlan(), under)
    return [x for c in _children(plan) for x in _exchanged_scans(c, under or "Exchange" in name)]


def test_lookups_do_not_move_the_store(spark, no_broadcast):
    path = io.scratch_path(spark, "t-store")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "id int, text string")
    out = so.embed_texts(texts, hashing_embedder(4), path, "text", "h4")
    scans = _exchanged_scans(out._jdf.queryExecution().executedPlan())
    assert scans == [False]
    misses = so.missing_embeddings(texts, EmbeddingStore(spark, path, "h4").read(), "text", "h4")
    assert _exchanged_scans(misses._jdf.queryExecution().executedPlan()) == [False]
    whole = out._jdf.queryExecution().executedPlan().toString() + misses._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in whole and "first(embedding" not in whole  # vectors are not compared or grouped
    assert out.where(F.col("embedding").isNotNull()).count() == 60 and misses.count() == 0


def test_compaction_keeps_one_row_a_key(spark):
    rows = [(f"k{i}", [float(i), 0.5]) for i in range(40)]
    store = _store(spark, rows)
    assert [g for g, _ in store.generations()] == [0]
    store.append(spark.createDataFrame(rows[:25] + [("new", [1.0])], "content_key string, embedding array<double>"))  # another writer's
    assert [g for g, _ in store.generations()] == [0, 1]
    got = sorted((r.content_key, r.embedding) for r in store.read().collect())
    assert got == sorted([(k, v) for k, v in rows] + [("new", [1.0])])
    store.append(spark.createDataFrame([("later", [2.0])], "content_key string, embedding array<double>"))
    assert [g for g, _ in store.generations()] == [0, 1] and store.read().count() == 42
    store.vacuum()
    assert [g for g, _ in store.generations()] == [1] and store.read().count() == 42


def test_store_is_read_by_another_session(spark):
    store = _store(spark, [("a", [1.0]), ("b", [2.0])])
    other = spark.newSession()
    again = EmbeddingStore(other, store.path, "h4")
    assert {r.content_key for r in again.read().collect()} == {"a", "b"}
    assert EmbeddingStore(spark, store.path, "none").read() is None and io.read_embeddings(spark, store.path + "-none") is None
    empty = _store(spark, [])
    assert empty.read().count() == 0


def merkle(texts):
    level = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    n = 0
    while n < manifest.LEVELS or len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + manifest.BLOCK]).encode()).hexdigest() for i in range(0, len(level), manifest.BLOCK)]
        n += 1
    return level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 30, 300])
def test_digest_is_a_merkle_root(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "BLOCK", 4)
    texts = [None if i % 13 == 5 else f"text {i * 7 % 11}" for i in range(n)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(5)
    got = manifest.set_digest(df, [F.col("id")]).first()
    assert (got.n, got.digest) == (n, merkle(texts))
    if n > 1:
        turned = manifest.set_digest(df.withColumn("id", -F.col("id")), [F.col("id")]).first()
        assert turned.digest == merkle(texts[::-1]) != got.digest


def test_manifest_statuses(spark):
    path, order = io.scratch_path(spark, "t-man"), [F.col("id")]
    df = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "id int, text string")

    def status(texts, name="s", **options):
        r = manifest.check_set(texts, order, name, "e", path, **options).first()
        return r.status, r.warned, r.stored_n

    assert status(df) == ("absent", False, None) and status(df, force=True) == ("absent", False, None)
    manifest.write_manifest(df, order, "s", "e", path)
    assert status(df) == ("hit", False, 9) and status(df, need_metadata=True) == ("no metadata", False, 9)
    assert status(df.where("id > 0")) == ("miss", False, 9) and status(df.where("id > 0"), force=True) == ("forced", True, 9)
    assert status(df.withColumn("text", F.lit("x")), force=True) == ("forced", False, 9)
    manifest.write_manifest(df, order, "s", "e", path, has_labels=True, has_ids=True)  # the newest record holds
    assert status(df, need_metadata=True) == ("hit", False, 9) and status(df, name="other") == ("absent", False, None)


def _prompts(spark, n):
    return spark.createDataFrame([(str(i), f"t{i}", "A", f"prompt {i % (n // 2)}") for i in range(n)],
                                 "LensID string, Title string, true_category string, prompt string")


def test_a_stopped_run_repeats_no_finished_call(spark):
    path, log = io.scratch_path(spark, "t-ledger"), io.scratch_path(spark, "t-log").removeprefix("file:")
    os.makedirs(log)
    prompts = _prompts(spark, 60)

    def model(stop):
        def call(batch):
            for p in batch:
                if stop and len(os.listdir(log)) >= stop:
                    os._exit(1)  # the worker is gone: no answer, no retry
                with open(os.path.join(log, f"{len(os.listdir(log)):04d} {p}"), "w"):
                    pass
            return ['{"scores": {"A": 0.7, "B": 0.3}}'] * len(batch)
        return call

    with pytest.raises(Exception):
        ledger.run_calls(prompts, model(13), path, max_parallel=1, rows_per_task=4, batch_size=4)
    kept = {r.call_key for r in ledger.read_ledger(spark, path).collect()}
    assert 4 <= len(kept) <= 13
    asked = ledger.run_calls(prompts, model(0), path, max_parallel=1, rows_per_task=4, batch_size=4)
    assert asked == 30 - len(kept)
    calls = [f.split(" ", 1)[1] for f in os.listdir(log)]
    done = {p for p in calls if hashlib.sha256(p.encode()).hexdigest() in kept}
    assert all(calls.count(p) == 1 for p in done) and set(calls) == {f"prompt {i}" for i in range(30)}
    assert ledger.run_calls(prompts, model(1), path, max_parallel=1) == 0  # nothing is left to ask
    got = ledger.ledger_results(prompts, path).collect()
    assert len(got) == 60 and {(r.predicted_one, r.confidence_one) for r in got} == {("A", 0.7)}


def test_error_answers_are_asked_again(spark):
    path, prompts = io.scratch_path(spark, "t-ledger"), _prompts(spark, 20)

    def bad(batch):
        return ["no JSON" if p.endswith(("1", "2")) else '{"scores": {"A": 1.0}}' for p in batch]

    assert ledger.run_calls(prompts, bad, path, max_parallel=3) == 10
    assert {r.LensID for r in ledger.ledger_results(prompts, path).collect() if r.predicted_one == "ERROR"} == {"1", "2", "11", "12"}
    assert ledger.pending(prompts, path).count() == 2

    def broken(batch):
        raise RuntimeError("down")

    assert ledger.run_calls(prompts, broken, path, max_parallel=2, attempts=1) == 2
    assert ledger.run_calls(prompts, lambda b: ['{"scores": {"B": 1.0}}'] * len(b), path, max_parallel=2) == 2
    got = {r.LensID: r.predicted_one for r in ledger.ledger_results(prompts, path).collect()}
    assert all(v == ("B" if int(k) % 10 in (1, 2) else "A") for k, v in got.items())
    assert ledger.run_calls(prompts.limit(0), bad, path) == 0


def test_calls_are_bounded_without_a_profile(spark):
    df = spark.createDataFrame([(str(i), "x") for i in range(100)], "id string, text string").repartition(20)
    out = so.call_model(df, lambda b: ["a"] * len(b), "text", "answer", so.T.StringType(), max_parallel=3)
    assert out.rdd.getNumPartitions() == 3
