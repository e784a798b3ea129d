from collections import Counter

import corpus_pipeline
from conftest import SMALL
from evertally.llm import decontamination, mixing, near_dedup, sharding, toxicity
from evertally.llm.tables import written


def test_stages_follow_their_operators(spark):
    """Each stage on its own input; the whole is what the stages make one after the other."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    benchmark, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("benchmark", "labels"))
    before, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = written(before, f"test_{name}")
        after = written(stage(spark, before, SMALL), f"test_{name}")
        texts[name] = before, after
        before = after
    assert all(after.columns == columns for name, (_, after) in texts.items() if name != "sharding")

    given, kept = texts["toxicity"]
    rows, score = toxicity.scored(given, toxicity.trained(given, labels), ["doc_id"])
    expected = {r["doc_id"] for r in rows.collect() if r[score] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in kept.collect()} == expected and len(expected) > 0.8 * given.count()

    given, kept = texts["near_dedup"]
    expected = {r["doc_id"] for r in near_dedup.near_duplicates(given).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected) and len(expected) < given.count()

    given, kept = texts["decontamination"]
    hits = {r["doc_id"]: r for r in decontamination.benchmark_hits(given, benchmark).collect()}
    old = {r["doc_id"]: r["text"] for r in given.collect()}
    new = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(new) == {i for i, r in hits.items() if r["n_hit"] <= decontamination.MAX_COVERAGE * r["n_words"]}
    assert all((new[i] == old[i]) != hits[i]["contaminated"] for i in new)

    given, kept = texts["mixing"]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(given).collect() if r["taken"]}
    assert Counter(r["doc_id"] for r in kept.collect()) == taken

    given, kept = texts["sharding"]
    assert kept.columns == [*columns, "slot", "shard"]
    assert sorted(map(tuple, kept.drop("slot", "shard").collect()), key=repr) == sorted(map(tuple, given.collect()), key=repr)
    assert len({r["shard"] for r in kept.select("shard").distinct().collect()} - set(sharding.shard_names(64))) == 0
    assert kept.groupBy("doc_id").agg({"shard": "max"}).count() == kept.select("doc_id", "shard").distinct().count()


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None
