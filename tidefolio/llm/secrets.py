"""Secret scans by a trigram index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: a text that matches must hold every trigram
of some literal run, for one branch of each alternation. The texts are indexed for the trigrams that any rule asks for,
one posting (trigram, doc_id) each; postings of a rule's clauses are intersected by counting them per document, and only
documents that survive are verified with the expression itself. A rule without a mandatory trigram (a run of hex digits)
scans every text. Spans come from the matches and the pieces between them, in code points.

Rules: ``assign``, ``access`` and ``hex`` give the base spans; ``private_key``, ``github``, ``slack``, ``stripe`` and
``jwt`` are added by this module. A ``private_key`` span covers the key's body up to its END line, or all base64 lines that
follow where there is none; tokens are taken to their last character.

Defined cases: null text counts as empty and has no spans; the digest of no spans is that of the empty string; texts of any
length are scanned whole; a null doc_id is a key like any other and rows that share an id are each verified on their own
text; an empty table gives no rows; columns other than the named ones are kept only by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

#: Branches a query may have before its node counts as unknown.
BRANCHES = 64


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Same matches as runs of any length of which the short ones are dropped.
    SecretRule("hex", r"[0-9a-f]{32,}"),
)
#: A key up to its END line: a body without spaces, or any in which no five dashes come between. Repeated groups are
#: possessive: nothing in them could match otherwise, and so they take no stack, however often they repeat.
_END = r"-{5,}END [A-Z0-9 ]*-{0,5}"
_CLOSED = rf"[A-Za-z0-9+/=_\r\n\\-]*?{_END}|[^-]*+(?:-{{1,4}}+[^-]++)*+{_END}"
#: Without an END line: armour headers, then all base64 lines (also with escaped line ends), then indented ones. Where such
#: lines stop inside a line, its first word counts as base64.
_OPEN = (
    r"(?:[\x20\t\r]*+\n[\x20\t]*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n]*+)*+"
    # Indented lines have 24 characters at least; spelled out for engines that bound repetitions in repetitions.
    rf"[A-Za-z0-9+/=\r\n\\]*+(?:(?:[\x20\t]++{'[A-Za-z0-9+/=]' * 24}[A-Za-z0-9+/=\r\n\\]*+)++[\x20\t]*+[A-Za-z0-9+/=]*+)?+"
)
ADDED = (
    SecretRule("private_key", rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_CLOSED}|{_OPEN})"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def without_possessives(pattern: str) -> str:
    """The same pattern for engines that do not backtrack; here possessive marks only follow * + ? and }."""
    return re.sub(r"(?<=[*+?}])\+", "", pattern)


def _strings(node) -> set[str] | None:
    """All strings a parsed node can match, lower-cased, or None if they are too many or unbounded."""
    kind, value = node
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if name == "SUBPATTERN":
        return _joined(value[3])
    if name == "BRANCH":
        parts = [_joined(x) for x in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        inner = _joined(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > BRANCHES:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjunction of disjunctions: for each entry one of its trigram sets must be in the lower-cased text as a whole.

    Empty if the pattern has no mandatory trigram.
    """
    query: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def flush() -> None:
        if all(len(s) >= 3 for s in run):
            query.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}, key=sorted))

    for node in re._parser.parse(pattern):
        more = _strings(node)
        if more is not None and len(run) * len(more) <= BRANCHES:
            run = {a + b for a, b in product(run, more)}
        else:
            flush()
            run = {""}
            if str(node[0]) in ("MAX_REPEAT", "MIN_REPEAT") and node[1][0] >= 1:
                inner = _joined(node[1][2])
                run = inner if inner is not None else {""}
                flush()
                run = {""}
    flush()
    return query


def candidates(df: DataFrame, rules: Sequence[SecretRule], *, id_col: str, text: str) -> DataFrame:
    """(doc_id, rules): documents whose postings meet some rule's query, with those rules' kinds."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = sorted({t for q in queries.values() for clause in q for branch in clause for t in branch})
    # lower() maps A-Z as needed; what else it maps can only add candidates.
    lowered = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]))
    postings = lowered.select("doc_id", F.explode(held).alias("trigram"))
    # A branch is met if all its trigrams are there, a rule if each of its clauses has such a branch.
    met = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))

    def holds(branch: frozenset[str]) -> Column:
        return F.size(F.array_intersect("have", F.array(*[F.lit(t) for t in sorted(branch)]))) == len(branch)

    flags = []
    for kind, query in queries.items():
        if query:
            every = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [holds(x) for x in clause]) for clause in query])
            flags.append(F.when(every, F.lit(kind)))
    if not flags:
        return met.select("doc_id", F.array().cast("array<string>").alias("rules")).limit(0)
    return met.select("doc_id", F.array_compact(F.array(*flags)).alias("rules")).filter(F.size("rules") > 0)


def rule_spans(text: Column, rule: SecretRule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, from the matches and the pieces between them."""
    pattern = F.lit(rule.pattern if "(" in rule.pattern else f"({rule.pattern})")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,size:int>>").alias("spans"))
    lengths = F.transform(
        F.arrays_zip(between.alias("gap"), found.alias("hit"), sized.alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("size"))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        )

    spans = F.aggregate(lengths, zero, step, lambda acc: acc["spans"])
    return F.filter(spans, lambda s: s["size"] >= rule.least)


def scan(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """doc_id, row (all columns of ``df``) and spans: array<struct<start, rank, kind, end>>, by start, then rank, which is
    the rule's place in ``rules``."""
    body = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )
    some = candidates(body, rules, id_col="doc_id", text="text").select(F.col("doc_id").alias("found_id"), "rules")
    joined = body.join(some, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def named(rank: int, kind: str):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        )

    parts = []
    for rank, rule in enumerate(rules):
        may = F.array_contains("rules", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        spans = F.transform(rule_spans(F.col("text"), rule), named(rank, rule.kind))
        parts.append(F.when(may & F.col("text").rlike(rule.pattern), spans).otherwise(none))
    return joined.select("doc_id", "row", F.array_sort(F.concat(*parts)).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans and all spans as text."""

    def joined(c: Column) -> Column:
        texts = F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(texts, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return spans.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """``df`` with every span replaced by ``[kind]``; overlapping spans are replaced as one, under the first one's kind."""
    found = scan(df, id_col=id_col, text=text, rules=rules)
    body = F.col(f"row.`{text}`")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))

    clean = F.when(F.size("spans") == 0, body).otherwise(F.aggregate("spans", zero, step, rest))
    return found.select(*[(clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns])
