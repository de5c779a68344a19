"""Conversation repair against a search over (cost, letters), and its defined cases."""

import hashlib
import heapq
import random
import zlib

import pytest

from tidefolio.llm import conversation_repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SPOKEN = {"u": "user", "a": "assistant"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def brute(rows):
    """Best-first search over the edits of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "." if body[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        moves = [(2, "I", r, f"{SPOKEN[r]}:", 0) for r in SPOKEN]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, state, out))
            if faults[i] in ".t":
                extra = faults[i] == "t"
                moves += [(extra, "K", role[:1], f"{role}:{text}", 1)]
                moves += [(2 + extra, "R", r, f"{SPOKEN[r]}:{text}", 1) for r in SPOKEN]
        for price, letter, r, line, step in moves:
            if (state, r) in STEPS:
                heapq.heappush(heap, (cost + price, letters + letter, i + step, STEPS[state, r], (*out, line)))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(c) for c in "bdt"]
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check(spark, rows, chunk):
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in R.digest(table, R.repair(R.damaged(table), chunk).summary).collect()}
    assert got == {conv: brute(kept) for conv, kept in damage(rows).items()}
    return got


@pytest.mark.parametrize("chunk", [2, 256])
def test_whole_table_equals_search(spark, chunk):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len(check(spark, rows, chunk)) == 100


def test_nulls_ties_repeats_and_long_conversations(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "no", "", " \t", None, "Well!", "é 世?", "x" * 5000]
    rows = [
        (rng.choice([None, 1, 2, 3, -4]), rng.choice([None, *range(-3, 40)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)
    ]
    rows += [(7, None, "user", "a")] * 30 + [(8, 3, "assistant", ".")] * 2 + [(9, 1, "user", "hi."), (9, 2, "user", "hi.")]
    check(spark, rows, 7)
    check(spark, rows, 256)


def test_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = check(spark, [(conv, 0, "user", "gone.")], 256)
    assert got[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert check(spark, [], 256) == {}


def test_other_columns_are_left_alone(spark):
    table = spark.createDataFrame([(1, 1, "user", "a.", "x", "y")], SCHEMA + ", conv string, part string")
    assert R.digest(table, R.repair(R.damaged(table)).summary).count() == 1


def test_weights_order_like_cost_then_letters():
    width = 6
    paths = [(2, "K"), (2, "KD"), (2, "KDD"), (2, "KI"), (2, "D"), (2, ""), (3, "D"), (0, "RRR")]

    def weight(cost, letters, digits=width):
        w = 0
        for c in reversed(letters):
            w = R.put_before(c, 0, w, digits)
        return w + (cost << 3 * digits)

    assert sorted(paths, key=lambda p: weight(*p)) == sorted(paths)
    assert all(R.letters_of(weight(*p), width) == p[1] for p in paths)
    for a in paths:
        for b in paths:
            both = R.joined(weight(*a), width, weight(*b), width)
            assert both == weight(a[0] + b[0], a[1] + b[1], 2 * width)


def test_repaired_rows_read_as_the_pattern(spark):
    import re

    rows = [(1, t, random.Random(t).choice(["system", "user", "assistant", "x"]), f"t{t}" + "." * (t % 3)) for t in range(60)]
    repaired = R.repair(R.damaged(spark.createDataFrame(rows, SCHEMA)), 8).chunks.orderBy("part", "seq").collect()
    said = "".join(role[:1] for r in repaired for role in r.roles)
    assert len(repaired) > 1 and re.fullmatch("(s?(ua)+)?", said)
