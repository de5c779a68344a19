"""Targets, draws and takes of the mix against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidefolio.llm import mixing as M


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def rows(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = rnd.choice(["hot"] * 6 + ["a", "b", "B", "é", None, "", "c d"])
        size = rnd.choice([0, 1, 3, 40, 300]) if i else 9000
        text = rnd.choice(["", " "]) + rnd.choice([" ", "\n", "\t  "]).join(f"w{i}x{k}" for k in range(size)) + rnd.choice(["", "\n"])
        out.append((i, text if size or rnd.random() < 0.5 else None, source))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_contract(spark, documents, seed):
    data = rows(seed)
    df = documents(data).withColumn("k", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("taken", F.lit(2))
    got = {r.doc_id: r for r in M.mix(df).collect()}
    assert len(got) == len(data)
    sizes = Counter()
    for i, text, source in data:
        assert got[i].size == len(words(text))
        sizes[source] += got[i].size
    want, taken = plain_targets(sizes), Counter()
    for i, _, source in data:
        assert got[i].source_size == sizes[source] and got[i].target == pytest.approx(want[source])
        assert 0 <= got[i].taken <= 2 * got[i].size
        taken[source] += got[i].taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.5 + 1e-6  # the last block is cut to fit
    assert {r.doc_id: r.taken for r in M.mix(df).collect()} == {i: r.taken for i, r in got.items()}


def test_mixed_documents_hold_the_words_taken(spark, documents):
    data = rows(3, 200)
    data += [data[5]] * 3  # rows that repeat
    df = documents(data).withColumn("copy", F.lit("clash"))
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    taken = Counter()
    for r in M.mix(df).collect():
        taken[r.doc_id] += r.taken
    found, source_words = Counter(), {i: words(t) for i, t, _ in data}
    for r in out.collect():
        got = words(r.text)
        assert got and r.n_chars == len(r.text)
        places = [source_words[r.doc_id].index(w) for w in got]
        assert places == sorted(places)
        found[r.doc_id] += len(got)
    assert found == Counter({i: n for i, n in taken.items() if n})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    there = M.hand_off(M.permuted(df, "id", "n", F.lit(5).cast("long"), "at"), "t")
    back = M.hand_off(M.permuted(there, "at", "n", F.lit(5).cast("long"), "back", inverse=True), "t")
    got = back.collect()
    assert sorted(r["at"] for r in got) == list(range(n)) and all(r["back"] == r["id"] for r in got)
    if n >= 64:
        assert sum(r["at"] == r["id"] for r in got) < n / 4


def test_draws_of_a_shard_vary_and_totals_are_exact(spark):
    goals = spark.createDataFrame([("a", 50_000, 60_000.0), ("b", 9_000, 18_000.0), (None, 700, 100.0)], "source string, source_size long, target double")
    needed = M.hand_off(M.needs(goals, 16, 1), "needs")
    drawn = M.hand_off(M.draws(needed, 1, 64), "draws")
    per = {(r.k, r.shard): r["count"] for r in drawn.groupBy("k", "shard").count().collect()}
    slots = {r.k: r.slots for r in needed.collect()}
    for k, n in slots.items():
        assert sorted(r.j for r in drawn.filter(F.col("k") == k).select("j").collect()) == list(range(n))
    shares = [per.get((1, s), 0) for s in {s for _, s in per}]
    assert len(set(shares)) > 3  # the counts of a source differ between shards


def test_nothing_to_mix(spark, documents):
    assert M.mix(documents([])).count() == 0 and M.mixed_documents(documents([])).count() == 0
    got = M.mix(documents([None, "", " \n"])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3


def test_plan_is_native(spark, documents):
    plan = M.mix(documents(rows(0, 20)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
