"""Secret spans against Python's regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidefolio.llm import secrets as S


def plain(text):
    text = text or ""
    spans = []
    for rank, rule in enumerate(S.RULES):
        pattern = {"hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        least = {"hex": 32}.get(rule.kind, rule.least)
        spans += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m.group(rule.group)) >= least]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def texts():
    rnd = random.Random(9)
    bits = [
        "password", "PassWD", "secret", "token", "api_key", "ApiKey", "apikey", ":", "=", " ", "  ", '"', "'", "abcdefgh", "abc", "A1b2/+_.=-",
        "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "é", "\U0001f600", "\n", "x", "ghp_" + "a1" * 18, "xoxb-1234567890-ab",
        "sk_live_" + "z" * 20, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJ9.eyJzdWIiOiJ9.c2lnbmF0dXJl", "K",
    ]
    out = ["".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(500)]
    return out + [None, "", "token=short token=longenough1", "password=token=abcdefgh", "x" * 60_000 + " api_key: " + "k" * 30_000, "a" * 100_000] + ["token=abcdefgh1"] * 30


def test_against_plain_matching(spark, documents):
    data = texts()
    df = documents(data).withColumn("rules", F.lit("clash")).withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in S.digest(S.scan(df)).collect()}
    assert len(got) == len(data)
    for i, t in enumerate(data):
        spans = plain(t)
        base = [s for s in spans if s[1] < len(S.BASE)]
        assert got[i].spans == joined(spans)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]


def test_redaction(spark, documents):
    data = texts()
    df = documents(data).withColumn("row", F.lit("clash"))
    out = S.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, t in enumerate(data):
        if t is None:
            assert got[i] is None
            continue
        want, at = "", 0
        for a, _, kind, b in plain(t):
            if a >= at:
                want, at = want + t[at:a] + f"[{kind}]", b
            else:
                at = max(at, b)
        assert got[i] == want + t[at:]


def test_shared_and_null_ids(spark, documents):
    df = documents([(1, "token=abcdefgh", "s"), (1, "clean", "s"), (None, "token=abcdefgh", "s"), (None, "clean", "s"), (1, "token=abcdefgh", "s")])
    got = sorted(((r.doc_id, r.n_assign) for r in S.digest(S.scan(df)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 0), (1, 1), (None, 1), (None, 0)], key=str)
    assert S.digest(S.scan(documents([]))).count() == 0


@pytest.mark.parametrize(
    "pattern, query",
    [
        (r"AKIA[A-Z0-9]+", [["aki", "kia"]]), (r"[0-9a-f]{32,}", None), (r"(foo|ba)[0-9]+", None), (r"(food|bars)[0-9]", [["foo", "ood"], ["ars", "bar"]]),
        (r"ab?cde", [["abc", "bcd", "cde"], ["acd", "cde"]]), (r"x*yyyz", [["yyy", "yyz"]]), (r"(abcd)+", [["abc", "bcd"]]),
    ],
)
def test_trigram_queries(pattern, query):
    got = S.trigram_query(pattern)
    if query is None:
        assert got == []
    else:
        assert sorted(sorted(b) for clause in got for b in clause) == sorted(query)


def test_a_query_never_misses_a_match():
    for rule in S.RULES:
        query = S.trigram_query(rule.pattern)
        for t in texts():
            if t and len(t) < 2000 and re.search(rule.pattern, t, re.A):
                low = t.lower()
                assert all(any(all(g in low for g in branch) for branch in clause) for clause in query)


def test_plan_is_native(spark, documents):
    plan = S.digest(S.scan(documents(["a"])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


LINES = [("MIIE" + f"{i:02d}" + "aZ9+/" * 20)[:64] for i in range(30)]
KEYS = [
    f"{head}\n" + "\n".join([*more, *LINES, "q7=="]) + f"\n{end}"
    for head, more, end in (
        ("-----BEGIN PRIVATE KEY-----", [], "-----END PRIVATE KEY-----"),
        ("-----BEGIN RSA PRIVATE KEY-----", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC,0A1B", ""], "-----END RSA PRIVATE KEY-----"),
        ("-----BEGIN PGP PRIVATE KEY BLOCK-----", ["Version: GnuPG v2", ""], "-----END PGP PRIVATE KEY BLOCK-----"),
        ("-----BEGIN RSA PRIVATE KEY-----", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC,0A1B", ""], ""),
        ("-----BEGIN EC PRIVATE KEY-----", [], ""),
    )
]
KEYS += [KEYS[0].replace("\n", x) for x in ("\r\n", "\\n", " ", "\n-", "\n    ")] + [KEYS[4].replace("\n", x) for x in ("\r\n", "\\n", "\n    ")]
KEYS += [KEYS[4].replace("q7==", "\n".join(LINES * 1000)), KEYS[0].replace("q7==", "\n-".join(LINES * 1000))]
# Hundreds of indented lines without END, of dashes inside a quoted key, of armour headers and of lone characters.
KEYS += ["-----BEGIN EC PRIVATE KEY-----\n" + "".join(f"    {x}\n" for x in LINES * 100)]
KEYS += ["-----BEGIN PRIVATE KEY-----\n" + "".join(f"- {x} -- é\n" for x in LINES * 200) + "-----END PRIVATE KEY-----"]
KEYS += ["-----BEGIN PRIVATE KEY-----" + "".join(f"\nComment: part {x}" for x in LINES * 10) + "\n\n" + "\n".join(LINES)]
KEYS += ["-----BEGIN PRIVATE KEY-----\n" + "-\U0001f600 x" * 50_000 + "\n-----END PRIVATE KEY-----"]
TOKENS = ["ghp_" + "a1" * 2000, "xoxb-" + "1-b" * 2000, "sk_live_" + "z9" * 2000]


def test_nothing_of_a_key_is_left(spark, documents):
    got = {r.doc_id: r.text for r in S.redact(documents([f"before\n{k}\n. after all" for k in KEYS])).collect()}
    for i in range(len(KEYS)):
        assert got[i].split() == ["before", "[private_key]", ".", "after", "all"] or got[i] == "before\n[private_key]. after all"


def test_nothing_of_a_long_token_is_left(spark, documents):
    got = {r.doc_id: r.text for r in S.redact(documents([f"a {t} b" for t in TOKENS])).collect()}
    assert [got[i] for i in range(3)] == ["a [github] b", "a [slack] b", "a [stripe] b"]


def test_a_first_line_alone_leaves_other_text_and_keys_apart(spark, documents):
    text = f"see -----BEGIN PRIVATE KEY----- in the manual - it says -----\nand {KEYS[0]} and {KEYS[1]} end"
    assert S.redact(documents([text])).first().text == "see [private_key] in the manual - it says -----\nand [private_key] and [private_key] end"


def test_key_spans_equal_their_sql(spark, documents):
    import duckdb
    import pandas as pd

    from tidefolio.llm.queries import ORACLES

    data = [f"é {x} \U0001f600 tail" for x in KEYS + TOKENS]
    base = duckdb.connect()
    base.register("documents", pd.DataFrame({"doc_id": range(len(data)), "text": data}))
    want = {r[0]: r[-1] for r in base.execute(ORACLES["op6_secrets"]).fetchall()}
    assert {r.doc_id: r.spans for r in S.digest(S.scan(documents(data))).collect()} == want
