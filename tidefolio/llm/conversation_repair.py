"""Conversation structure repair: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

Rows of a conversation stand in the order of (turn, role, SHA-256 of the text), null turns first. Each row is kept (0),
given the role user or assistant (2) or deleted (3); an empty user or assistant row may be inserted anywhere (2); a blank row
or one whose role and text were seen earlier must go; a truncated row that stays costs 1. Among the cheapest edits the ones
whose initials, in order, are ASCII-least win.

A weight is one integer: its high digits are the cost, its low digits, three bits each and as many as any path may need, are
the letters of the edits from the left, with zeros after the last one. A smaller integer is then a cheaper path, or an equally
cheap one with lesser letters (a path that ends first is less, as in ASCII). The edits form a DAG over (row, state of the
pattern); its shortest path by ordinary integer minimum, worked from the end so that an edge puts its letter in front, gives
cost and letters at once.

No conversation needs a task of its own. All rows are range-partitioned and sorted; equal rows may part, as nothing tells
them apart. Each partition is cut into chunks of ``CHUNK`` rows of one conversation. The first row of each (conversation,
role, text) is found by an aggregate over 32-byte keys. A chunk's weights for every pair of states come from its own rows, the
weights of neighbouring chunks combine in a binary tree of integer minima, and the path chosen at the top is handed back
down. SHA-256 can only be chained in order, so the chunks of a conversation with several of them stream through one task,
a chunk held at a time; those with one are hashed where they are.

Defined cases: null role and text are one space; an initial is the first character of the role, so an empty or unknown role
cannot be kept; null conversations are one conversation; a conversation without rows has zeros, an empty audit and the hash of the
empty text; texts of any length are read once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.session import hand_off

CHUNK = 256
CHUNK_CHARS = 1 << 20
BLANK, DUPLICATE, TRUNCATED, FINE = "bdt."

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: Digits in the order of the letters' ASCII codes; 0 is the end.
DIGIT = {c: k for k, c in enumerate(sorted("KRDI"), start=1)}
LETTER = {str(k): c for c, k in DIGIT.items()}
#: States of the pattern: nothing yet, after s, after u, after a; END is past the accepting states 0 and 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ACCEPT, END = range(4), (0, 3), 4
SPOKEN = {"u": "user", "a": "assistant"}
#: Inserts between two rows: a longer run would hold a pair ``ua`` or ``au`` that leads back to its own state.
MOST_INSERTS = 2

Matrix = dict[tuple[int, int], int]


# --- weights ------------------------------------------------------------------------------------------------------

def put_before(letter: str, cost: int, weight: int, width: int) -> int:
    """The weight of a path that begins with ``letter`` and goes on as ``weight``, with ``width`` digits."""
    letters = weight & ((1 << 3 * width) - 1)
    return weight - letters + (cost << 3 * width) + (DIGIT[letter] << 3 * (width - 1)) + (letters >> 3)


def letters_of(weight: int, width: int) -> str:
    low = weight & ((1 << 3 * width) - 1)
    return "".join(LETTER[d] for d in f"{low:0{width}o}".rstrip("0")) if low else ""


def joined(a: int, a_width: int, b: int, b_width: int) -> int:
    """The weight, of ``a_width + b_width`` digits, of path ``a`` followed by path ``b``."""
    low = a & ((1 << 3 * a_width) - 1)
    free = ((low & -low).bit_length() - 1) // 3 if low else a_width
    after = b & ((1 << 3 * b_width) - 1)
    cost = (a >> 3 * a_width) + (b >> 3 * b_width)
    return (cost << 3 * (a_width + b_width)) + (low << 3 * b_width) + (after << 3 * free)


def _inserts(best: dict[int, int], width: int) -> dict[int, int]:
    """Least weights to the end when empty rows may be put in first."""
    for _ in range(MOST_INSERTS):
        wider = dict(best)
        for (state, _role), to in NEXT.items():
            if _role != "s" and to in best:
                w = put_before(INSERT, COST[INSERT], best[to], width)
                wider[state] = min(wider.get(state, w), w)
        best = wider
    return best


def _row(best: dict[int, int], initial: str, fault: str, width: int) -> dict[int, int]:
    out = {x: put_before(DELETE, COST[DELETE], w, width) for x, w in best.items()}
    if fault in (BLANK, DUPLICATE):
        return out
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for (state, role), to in NEXT.items():
        if to not in best:
            continue
        ways = [(KEEP, COST[KEEP])] if role == initial else []
        if role in SPOKEN:
            ways.append((REROLE, COST[REROLE]))
        for letter, cost in ways:
            w = put_before(letter, cost + extra, best[to], width)
            out[state] = min(out.get(state, w), w)
    return out


@lru_cache(maxsize=1 << 14)
def chunk_weights(initials: str, faults: str) -> tuple[int, Matrix]:
    """Digits and least weight of every pair of states before and after these rows; inserts come before a row."""
    width = max((1 + MOST_INSERTS) * len(initials), 1)
    matrix: Matrix = {}
    for end in STATES:
        best = {end: 0}
        for initial, fault in zip(reversed(initials), reversed(faults)):
            best = _inserts(_row(best, initial, fault, width), width)
        matrix.update({(start, end): w for start, w in best.items()})
    return width, matrix


def ending() -> tuple[int, Matrix]:
    """Inserts after the last row, up to an accepting state."""
    best = _inserts({x: 0 for x in ACCEPT}, MOST_INSERTS)
    return MOST_INSERTS, {(x, END): w for x, w in best.items()}


class Node:
    """Weights of some neighbouring chunks, from two halves or from one chunk."""

    def __init__(self, width: int, matrix: Matrix, halves: tuple[Node, Node] | None = None, via: dict | None = None):
        self.width, self.matrix, self.halves, self.via = width, matrix, halves, via or {}

    @staticmethod
    def over(a: Node, b: Node) -> Node:
        matrix, via = {}, {}
        for (start, mid), w in a.matrix.items():
            for (other, end), v in b.matrix.items():
                if other == mid:
                    total = joined(w, a.width, v, b.width)
                    if (start, end) not in matrix or total < matrix[start, end]:
                        matrix[start, end], via[start, end] = total, mid
        return Node(a.width + b.width, matrix, (a, b), via)

    def leaves(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        """(state before, letters) of each chunk along the best path."""
        if self.halves is None:
            yield start, letters_of(self.matrix[start, end], self.width)
        else:
            mid = self.via[start, end]
            yield from self.halves[0].leaves(start, mid)
            yield from self.halves[1].leaves(mid, end)


def best_edits(chunks: list[tuple[int, Matrix]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and per chunk the state before it and its letters; the inserts after the last row belong to the last chunk."""
    level = [Node(*c) for c in [*chunks, ending()]]
    while len(level) > 1:
        pairs = [Node.over(a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    top = level[0]
    *inner, (state, tail) = top.leaves(0, END)
    cost = top.matrix[0, END] >> 3 * top.width
    return cost, [*inner[:-1], (inner[-1][0], inner[-1][1] + tail)] if inner else []


def apply_edits(state: int, edits: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The rows that the edits leave, from the state before them."""
    rows, out = iter(zip(roles, texts)), []
    for e in edits:
        role, text = ("", "") if e == INSERT else next(rows)
        if e == DELETE:
            continue
        initial = role[:1] if e == KEEP else next(r for r in SPOKEN if (state, r) in NEXT)
        out.append((role if e == KEEP else SPOKEN[initial], text))
        state = NEXT[state, initial]
    return out


# --- tables -------------------------------------------------------------------------------------------------------

def conversation_key(conv_id: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` picks."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rows = conversations.select(
        "conv_id", "turn", filled["role"].alias("role"), filled["text"].alias("text"),
        (F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"]).cast("binary")) % 20).alias("_fate"),
    ).where("_fate <> 0")
    fate = F.col("_fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")
    ).drop("_")


def fault_of(text: str) -> str:
    """What the text alone shows."""
    last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
    return BLANK if not last else FINE if last in ".!?" else TRUNCATED


def cut(rows: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """Chunks of at most ``chunk_rows`` rows of one conversation: (conv, part, seq) by order, arrays of the rows' columns."""
    placed = rows.select(
        conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text",
        F.unhex(F.sha2("text", 256)).alias("key"), F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("salt")]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = (
        "conv string, part int, seq int, turns array<bigint>, roles array<string>, texts array<string>,"
        " keys array<binary>, initials string, faults string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, chars = [], 0
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
                 pa.list_(pa.binary()), pa.string(), pa.string()]
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        done: list[tuple] = []

        def close():
            conv, turns, roles, texts, keys = held[0][0], *map(list, zip(*(r[1:] for r in held)))
            initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r in roles)
            done.append((conv, part, seq, turns, roles, texts, keys, initials, "".join(map(fault_of, texts))))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
            done.clear()
            return out

        size = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for row in zip(*columns):
                if held and (row[0] != held[0][0] or len(held) == chunk_rows or chars + len(row[3]) > CHUNK_CHARS):
                    close()
                    size += chars
                    held, chars, seq = [], 0, seq + 1
                    if size > CHUNK_CHARS or len(done) >= 1024:
                        yield flush()
                        size = 0
                held.append(row)
                chars += len(row[3])
        if held:
            close()
        if done:
            yield flush()

    return ordered.select("conv", "turn", "role", "text", "key").mapInArrow(run, schema)


def first_rows(chunks: DataFrame) -> DataFrame:
    """(part, seq, firsts): the places of the rows whose role and text their conversation has not had before."""
    place = F.struct("part", "seq", "pos")
    rows = chunks.select(
        "conv", "part", "seq", F.posexplode(F.arrays_zip("roles", "keys", F.split("faults", "").alias("fault"))).alias("pos", "row")
    ).where(F.col("row.fault") != BLANK)
    firsts = rows.groupBy("conv", F.col("row.roles").alias("role"), F.col("row.keys").alias("key")).agg(F.min(place).alias("at"))
    return firsts.groupBy("at.part", "at.seq").agg(F.collect_list("at.pos").alias("firsts"))


def _mapped(df: DataFrame, one: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows from rows, some at a time."""
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = [o for row in batch.slice(at, 512).to_pylist() for o in one(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _solved(row: dict) -> list[dict]:
    firsts, initials = set(row["firsts"] or ()), row["initials"]
    faults = "".join(f if f == BLANK or k in firsts else DUPLICATE for k, f in enumerate(row["faults"]))
    width, matrix = chunk_weights(initials, faults)
    turns = [t for t in row["turns"] if t is not None]
    return [
        {
            "conv": row["conv"], "part": row["part"], "seq": row["seq"],
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "head": initials[0], "tail": initials[-1],
            "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
            "width": width,
            "paths": [{"start": s, "end": e, "weight": w.to_bytes((w.bit_length() + 7) // 8, "big")} for (s, e), w in matrix.items()],
        }
    ]


_SOLVED = (
    "conv string, part int, seq int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string,"
    " turns bigint, low bigint, high bigint, width bigint, paths array<struct<start: int, end: int, weight: binary>>"
)
_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CHOSEN = "conv string, part int, seq int, chunks bigint, state int, edits string, audit string, " + ", ".join(
    f"{c} bigint" for c in _TOTALS
)


class _Joined(NamedTuple):
    """The chunks of one conversation, in order."""

    rows: list[dict]

    def chosen(self) -> list[dict]:
        rows = self.rows
        cost, edits = best_edits(
            [(r["width"], {(p["start"], p["end"]): int.from_bytes(p["weight"], "big") for p in r["paths"]}) for r in rows]
        )
        borders = list(zip(rows, rows[1:]))
        illegal = sum(r["illegal"] for r in rows) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in borders)
        lows = [r["low"] for r in rows if r["low"] is not None]
        highs = [r["high"] for r in rows if r["high"] is not None]
        distinct = sum(r["turns"] for r in rows) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in borders)
        totals = {"gaps": max(highs) - min(lows) + 1 - distinct if lows else 0, "illegal": illegal, "cost": cost}
        totals |= {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}
        out = [
            {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "chunks": len(rows), "state": s, "edits": e}
            for r, (s, e) in zip(rows, edits)
        ]
        out[0] |= totals | {"audit": "".join(e for _, e in edits)}
        return out


def _streamed(df: DataFrame, key: str, schema: str, run: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Rows of a key side by side and in order of (part, seq), read one after the other."""
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out = to_arrow_schema(kinds), []
        rows = (row for b in batches for at in range(0, b.num_rows, 64) for row in b.slice(at, 64).to_pylist())
        for o in run(rows):
            out.append(o)
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, "part", "seq").mapInArrow(task, schema)


def _choose(rows: Iterator[dict]) -> Iterator[dict]:
    held: list[dict] = []
    for row in rows:
        if held and held[0]["conv"] != row["conv"]:
            yield from _Joined(held).chosen()
            held = []
        held.append(row)
    if held:
        yield from _Joined(held).chosen()


def _hash(rows: Iterator[dict]) -> Iterator[dict]:
    """SHA-256 of each conversation's pieces, line feeds between those that have rows."""
    conv, state, some = None, hashlib.sha256(), False
    for row in rows:
        if row["conv"] != conv:
            if conv is not None:
                yield {"conv": conv, "sha": state.hexdigest()}
            conv, state, some = row["conv"], hashlib.sha256(), False
        if row["lines"]:
            state.update((b"\n" if some else b"") + row["piece"].encode())
            some = True
    if conv is not None:
        yield {"conv": conv, "sha": state.hexdigest()}


class Repair(NamedTuple):
    """``summary``: a row per conversation with rows; ``chunks``: the repaired rows as arrays, by (conv, part, seq)."""

    summary: DataFrame
    chunks: DataFrame


def repair(rows: DataFrame, chunk_rows: int = CHUNK) -> Repair:
    """Edits and repaired rows of (conv_id, turn, role, text)."""
    chunks = hand_off(cut(rows, chunk_rows), "conversation-chunks")
    light = chunks.select("conv", "part", "seq", "turns", "initials", "faults").join(first_rows(chunks), ["part", "seq"], "left")
    chosen = hand_off(_streamed(_mapped(light, _solved, _SOLVED), "conv", _CHOSEN, _choose), "conversation-edits")
    edits = chosen.select("part", "seq", "chunks", "state", "edits")

    def edited(row: dict) -> list[dict]:
        kept = apply_edits(row["state"], row["edits"], row["roles"], row["texts"])
        same = {c: row[c] for c in ("conv", "part", "seq", "chunks")}
        return [same | {"roles": [r for r, _ in kept], "texts": [t for _, t in kept]}]

    repaired = _mapped(
        chunks.select("conv", "part", "seq", "roles", "texts").join(edits, ["part", "seq"]),
        edited, "conv string, part int, seq int, chunks bigint, roles array<string>, texts array<string>",
    )
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    pieces = hand_off(repaired.select("conv", "part", "seq", "chunks", "roles", "texts"), "conversation-repaired")
    text = pieces.select("conv", "part", "seq", "chunks", F.size("roles").alias("lines"), F.array_join(lines, "\n").alias("piece"))
    one = text.where("chunks = 1").select("conv", F.sha2("piece", 256).alias("sha"))
    many = _streamed(text.where("chunks > 1").drop("chunks"), "conv", "conv string, sha string", _hash)
    summary = chosen.where("audit IS NOT NULL").select("conv", *_TOTALS, "audit").join(one.unionByName(many), "conv")
    return Repair(summary, pieces)


def digest(conversations: DataFrame, summary: DataFrame) -> DataFrame:
    """A row per conversation of the original table; those without rows have zeros and empty texts."""
    ids = conversations.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    empty = hashlib.sha256().hexdigest()
    return ids.join(summary, "conv", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _TOTALS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"),
    )
