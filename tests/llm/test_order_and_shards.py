import hashlib
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from subspan.llm.mixing import mix, schedule
from subspan.llm.sharding import shard
from tests.llm.fixtures import documents, empty, odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over `most` sizes shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = Fraction(total - sum(fixed.values()), sum(w[s] for s in free))
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, w[s] * level) for s in order}
        fixed |= {s: most * sizes[s] for s in over}


def rows_of(spark, n=60):
    texts = [None if i == 7 else "" if i == 8 else " ".join("w" * (1 + i % 5) for _ in range(i * i % 37)) for i in range(n)]
    return texts, documents(spark, texts, repeat=False)


def test_schedule_meets_targets(spark):
    texts, docs = rows_of(spark)
    got = {r["doc_id"]: r for r in schedule(docs).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    by = {}
    for i, s in source.items():
        by[s] = by.get(s, 0) + sizes[i]
    want = targets(by)
    taken = {}
    for i, r in got.items():
        assert r["size"] == sizes[i] and r["source_size"] == by[source[i]] and 0 <= r["taken"] <= 3 * sizes[i]
        assert r["target"] == pytest.approx(float(want[source[i]]))
        taken[source[i]] = taken.get(source[i], 0) + r["taken"]
    assert all(taken[s] == int(want[s] + Fraction(1, 10**6)) or abs(taken[s] - want[s]) <= 1 for s in by)
    again = {r["doc_id"]: r["taken"] for r in schedule(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_caps_and_one_source(spark):
    rows = [(i, "a b c", "big") for i in range(50)] + [(100, "x y", "a"), (101, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in schedule(docs).collect()}
    assert got[100]["taken"] == 6 and got[100]["target"] == 6.0 and got[101]["taken"] == 0
    assert sum(r["taken"] for r in got.values()) == 152
    alone = schedule(docs.where("source = 'big'")).collect()
    assert all(r["taken"] == 3 for r in alone)


def test_mix_rows(spark):
    _, docs = rows_of(spark)
    plan = {r["doc_id"]: r for r in schedule(docs).collect()}
    out = mix(docs).collect()
    assert out and mix(docs).columns == docs.columns
    words = {}
    for r in out:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {i: r["taken"] for i, r in plan.items() if r["taken"]}


def test_mix_edges(spark):
    assert schedule(empty(spark)).collect() == [] and mix(empty(spark)).collect() == []
    texts = odd_texts()
    got = schedule(documents(spark)).collect()
    assert len(got) == len(texts) + 1
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) for r in got)
    mix(documents(spark)).collect()


def checked(docs, texts, shards=8, tolerance=None):
    got = shard(docs, shards).collect()
    size = {}
    slots = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    if tolerance:
        mean = sum(size.values()) / shards
        assert len(size) == shards and all(abs(s - mean) <= tolerance for s in size.values()), size
    return got


def test_shards_are_even(spark):
    texts = [hashlib.md5(str(i).encode()).hexdigest() * (1 + i % 9) for i in range(900)]
    got = checked(documents(spark, texts, repeat=False), texts, tolerance=9 * 32 + 2)
    assert sorted(tuple(r) for r in shard(documents(spark, texts, repeat=False).repartition(5)).collect()) == sorted(map(tuple, got))


def test_hot_text_is_divided_and_small_groups_are_not(spark):
    texts = ["same text " * 20] * 400 + [f"pair {i // 2} " + "x" * (i // 2 % 50) for i in range(800)]
    got = checked(documents(spark, texts, repeat=False), texts, tolerance=1700)
    assert len({r["shard"] for r in got if r["doc_id"] < 400}) > 3
    whole = {}
    for r in got:
        if r["doc_id"] >= 400:
            whole.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in whole.values())


def test_one_giant_document(spark):
    texts = ["y" * 100_000] + [f"t{i}" for i in range(300)]
    checked(documents(spark, texts, repeat=False), texts)


def test_shard_edges(spark):
    assert shard(empty(spark)).collect() == []
    checked(documents(spark), odd_texts())
    assert shard(documents(spark, ["only"], repeat=False)).select("slot").collect()[0][0] == 0
    assert shard(documents(spark, ["a", "b"], repeat=False)).agg(F.count("*")).first()[0] == 2


def test_groups_stay_whole_and_equal_rows_are_divided(spark):
    texts = [f"group {i % 500} of forty equal texts" for i in range(20_000)]
    got = shard(documents(spark, texts, repeat=False)).groupBy("group").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert got == 0
    same = spark.createDataFrame([(7, "the same row")] * 4000 + [(i, f"other {i}") for i in range(50)], "doc_id long, text string")
    sizes = [r["count"] for r in shard(same).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 60
