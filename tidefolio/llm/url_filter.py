"""URL filters: every rule of a list is simulated at once over each canonical URL, one bit per rule position.

A canonical URL is ``.host``, a border byte that no UTF-8 text holds, and the path. A rule is a host glob and a path
glob: its host fits the same host and every subdomain, its path fits every path that starts with it; ``*`` is any run
(inside the host without the border), ``?`` any one byte. The rules' positions are laid out side by side in a row of
64-bit words, the longest rule first, so the lowest set bit among the accepting ones names the winner. For each byte
two masks per word say which positions it may enter and at which it may stay; a step is a shift with carry and two ANDs
over all URLs of a batch.

Defined cases: a null URL or one without ``://`` has an empty host and path and meets no rule, which gives the default
verdict; URLs of any length are read byte by byte without a copy per rule, and leave the simulation as soon as no
position is alive; rows that repeat are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.llm.common import lower_ascii

BORDER = 0xFF
CHECK_ALIVE = 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host`` with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class Automaton:
    """Masks of a rule list: ``enter[byte]`` and ``stay[byte]`` are rows of words, ``start`` and ``accept`` too."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: (-len(r.text), r.text))
        steps: list[tuple[list[int], list[int]]] = []
        starts, ends = [], []
        inside = [b for b in range(256) if b != BORDER]
        for rule in self.rules:
            starts.append(len(steps))
            steps.append(([], inside))  # any run before the dot of a subdomain or of the host itself
            for part, run in ((b"." + rule.host.lower().encode(), inside), (rule.path.encode(), list(range(256)))):
                for byte in part:
                    if byte == ord("*"):
                        steps[-1] = (steps[-1][0], run)
                    else:
                        steps.append((inside if byte == ord("?") else [byte], []))
                if part.startswith(b".") and run is inside:
                    steps.append(([BORDER], []))
            ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, (enter, stay) in enumerate(steps):
            word, bit = at // 64, np.uint64(1 << (at % 64))
            self.enter[enter, word] |= bit
            self.stay[stay, word] |= bit
        self.start, self.accept = self._row(starts), self._row(ends)
        self.rule_at = np.full(self.words * 64, -1, np.int32)
        self.rule_at[ends] = np.arange(len(self.rules))

    def _row(self, places: Sequence[int]) -> np.ndarray:
        row = np.zeros(self.words, np.uint64)
        for at in places:
            row[at // 64] |= np.uint64(1 << (at % 64))
        return row

    def winners(self, texts: Sequence[bytes]) -> np.ndarray:
        """The longest fitting rule's index for each canonical URL, or -1."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        hits = np.zeros((len(texts), self.words), np.uint64)
        alive = order
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, last = np.uint64(1), np.uint64(63)
        for at in range(int(lengths.max(initial=0))):
            keep = int(np.searchsorted(-lengths[alive], -at, side="left"))
            if keep < len(alive):
                alive, state = alive[:keep], state[:keep]
            if at % CHECK_ALIVE == 0:
                some = state.any(axis=1)
                if not some.all():
                    alive, state = alive[some], state[some]
            if not len(alive):
                break
            byte = flat[offsets[alive] + at]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> last
            state = (moved & self.enter[byte]) | (state & self.stay[byte])
            hits[alive] |= state & self.accept
        return self._lowest(hits)

    def _lowest(self, hits: np.ndarray) -> np.ndarray:
        found = hits.any(axis=1)
        word = np.argmax(hits != 0, axis=1)
        value = hits[np.arange(len(hits)), word]
        lowest = value & (~value + np.uint64(1))
        bit = np.zeros(len(hits), np.int64)
        bit[found] = np.log2(lowest[found].astype(np.float64)).astype(np.int64)
        return np.where(found, self.rule_at[word * 64 + bit], -1).astype(np.int32)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    df: DataFrame, rules: Sequence[Rule], *, url: str = "url", keep: Sequence[str] = (), default: str = "allow"
) -> DataFrame:
    """``keep``, host, path, rule (text or null) and verdict of every row."""
    machine = Automaton(rules)

    @F.pandas_udf("int")
    def winner(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            texts = [b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths, strict=True)]
            yield pd.Series(machine.winners(texts))

    host, path = host_and_path(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    parts = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    which = parts.withColumn("_rule", winner("host", "path"))

    def named(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))  # null beyond the list, as for -1

    if not machine.rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return which.select(
        *[F.col(f"`{c}`") for c in keep],
        "host",
        "path",
        named([r.text for r in machine.rules]).alias("rule"),
        F.coalesce(named([r.verdict for r in machine.rules]), F.lit(default)).alias("verdict"),
    )
