"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidefolio.llm import (
    ball_tree,
    collocations,
    conversation_repair,
    html_text,
    mixing,
    secrets,
    sentencepiece_codec,
    simhash,
    token_counts,
    toxicity,
    training_order,
    url_filter,
    vantage_tree,
)
from tidefolio.llm.common import table
from tidefolio.session import shared_folder

#: Where the public tokenizer files are; a parameter of every operator that reads one.
TOKENIZERS = os.environ.get("TIDEFOLIO_TOKENIZERS", "/opt/tokenizers")
TOKEN_LIMIT = 1024
URL_RULES = (
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def tokenizer(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' piece ids, two bytes wide, cut, ordered, written as shards and read back."""
    path = f"{shared_folder(spark)}/tidefolio/order-{uuid.uuid4().hex}"
    encode = sentencepiece_codec.library_ids(tokenizer("piece_bpe_32k.model"))
    shards = training_order.order(table(spark, sf_dir, "documents"), path, ids="text", width=2, encode=encode)
    return training_order.read_from(spark, shards)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), budgets=(TOKEN_LIMIT,))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_tree.neighbours(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.digest(rows, conversation_repair.repair(conversation_repair.damaged(rows)).summary)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_toxicity,
        op3_top_k,
        op4_training_order,
        op5_mix_sources,
        op6_secrets,
        op7_token_counts,
        op8_sentencepiece,
        op9_simhash,
        op10_neighbours,
        op11_conversation_repair,
        op12_collocations,
        op13_html_text,
    )
}

_OP1 = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM (SELECT row_number() OVER () AS n, * FROM parts) x
  LEFT JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
  GROUP BY n, page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def _secrets_sql() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = secrets.without_possessives(rule.pattern).replace("'", "''")
        hits = f"regexp_extract_all(t, '{pattern}')"
        sized = f"regexp_extract_all(t, '{pattern}', {rule.group})"
        parts.append(f"""
  SELECT n, {rank} AS rank, '{rule.kind}' AS kind, i, hits[i] AS hit, len(sized[i]) AS size,
         list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT n, {hits} AS hits, {sized} AS sized, regexp_split_to_array(t, '{pattern}') AS gaps FROM docs))
  WHERE len(sized[i]) >= {rule.least}""")
    base = len(secrets.BASE)
    joined = "string_agg(kind || ':' || start::BIGINT || ':' || (start + len(hit))::BIGINT, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
per AS (
  SELECT n, {counts}, {joined} FILTER (rank < {base}) AS base, {joined} AS spans FROM found GROUP BY n
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (n)
"""


def _repair_sql() -> str:
    """Edits by a recursion over the rows from the last one; a path is its cost in nine digits and its letters."""
    r = conversation_repair

    def put(letter: str, cost: str, after: str) -> str:
        return f"(lpad(CAST(CAST(substr({after}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({after}, 10))"

    after_row, after_insert = [], []
    for x in r.STATES:
        ways = [put(r.DELETE, str(r.COST[r.DELETE]), f"v{x}")]
        inserts = [f"v{x}"]
        for (state, role), to in r.NEXT.items():
            if state != x:
                continue
            ways.append(f"CASE WHEN NOT gone AND initial = '{role}' THEN {put(r.KEEP, 'extra', f'v{to}')} END")
            if role in r.SPOKEN:
                ways.append(f"CASE WHEN NOT gone THEN {put(r.REROLE, f'{r.COST[r.REROLE]} + extra', f'v{to}')} END")
                inserts.append(put(r.INSERT, str(r.COST[r.INSERT]), f"v{to}"))
        after_row.append(f"least({', '.join(ways)}) AS v{x}")
        after_insert.append(f"least({', '.join(inserts)}) AS v{x}")

    def inserted(query: str) -> str:
        for _ in range(r.MOST_INSERTS):
            query = f"SELECT cid, i, {', '.join(after_insert)} FROM ({query})"
        return query

    # A least() of one argument is that argument.
    start = ", ".join(("'000000000'" if x in r.ACCEPT else "CAST(NULL AS VARCHAR)") + f" AS v{x}" for x in r.STATES)
    step = f"SELECT b.cid, b.i - 1 AS i, {', '.join(after_row)} FROM best b JOIN faulty f ON f.cid = b.cid AND f.nr = b.i"
    following = " ".join(f"WHEN state = {x} AND spoken = '{c}' THEN {to}" for (x, c), to in r.NEXT.items())
    return f"""
WITH RECURSIVE filled AS (
  SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named
  FROM conversations
), fated AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      flatten(list_transform(string_split(named, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS fate
  FROM filled
), damaged AS (
  SELECT cid, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS nr, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut
  FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY nr) > 1 AS again, substr(role, 1, 1) AS initial FROM placed
), faulty AS (
  SELECT *, cut = '' AS blank, cut <> '' AND again AS duplicate, cut = '' OR again AS gone,
         CAST(cut <> '' AND NOT again AND right(cut, 1) NOT IN ('.', '!', '?') AS INTEGER) AS extra,
         lag(initial) OVER (PARTITION BY cid ORDER BY nr) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen
), best AS (
  {inserted(f"SELECT cid, max(nr) AS i, {start} FROM faulty GROUP BY cid")}
  UNION ALL
  {inserted(step)}
), chosen AS (
  SELECT cid, CAST(substr(v0, 1, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM best WHERE i = 0
), replay AS (
  SELECT cid, audit, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS i, 0 AS state, CAST([] AS VARCHAR[]) AS lines FROM chosen
  UNION ALL
  SELECT cid, audit, pos, i, CASE {following} ELSE state END, CASE WHEN e = 'D' THEN lines ELSE list_append(lines, line) END FROM (
    SELECT *, CASE WHEN e = 'D' THEN '' ELSE substr(line, 1, 1) END AS spoken FROM (
      SELECT p.cid, p.audit, p.pos + 1 AS pos, p.i + CAST(e <> 'I' AS BIGINT) AS i, p.state, p.lines, e,
             CASE WHEN e = 'K' THEN f.role ELSE CASE WHEN p.state = 2 THEN 'assistant' ELSE 'user' END END || ':'
             || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
      FROM (SELECT *, substr(audit, pos + 1, 1) AS e FROM replay WHERE pos < len(audit)) p
      LEFT JOIN faulty f ON f.cid = p.cid AND f.nr = p.i + 1))
), repaired AS (
  SELECT cid, array_to_string(lines, chr(10)) AS whole FROM replay WHERE pos = len(audit)
), per AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, sum(extra) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY cid
)
SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS cid FROM conversations) o
LEFT JOIN per USING (cid) LEFT JOIN chosen USING (cid) LEFT JOIN repaired USING (cid)
"""


_OP12 = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) s(size))
), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST({collocations.SCALE}::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM long) c
  JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(w[k + 1:], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, m AS size, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM long))
  GROUP BY ALL
), kept AS (
  SELECT x.* FROM lowest x LEFT JOIN inside y USING (lang, size, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < {collocations.COVERED}::HUGEINT * x.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN totals USING (lang)
) WHERE rank <= {collocations.TOP}
"""

ORACLES = {
    "op1_url_filter": _OP1,
    "op3_top_k": _OP3,
    "op6_secrets": _secrets_sql(),
    "op11_conversation_repair": _repair_sql(),
    "op12_collocations": _OP12,
}
