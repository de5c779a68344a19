"""Token counts of a byte-level merge tokenizer by a table over prefixes.

A text is cut where the tokenizer cuts it: special strings, then the pre-tokenizer's pieces. Inside a piece a table from
left to right holds the exact token count of every prefix (see ``merges``), so a text's total, the count at any prefix
and the longest prefix within a budget are read off, without encoding again for each question. Pieces repeat: tables are
made once per distinct piece and task, in sorted order, and only totals are kept, up to ``CACHE`` entries.

A prefix is tokenized as a text of its own: a piece that the prefix cuts is cut the same way, except that a run of white
space at its end is one piece and a cut contraction (``'re``) is an apostrophe and letters.

Defined cases: null text counts as empty and has no tokens; very long texts and words are counted whole, in memory that
grows with the longest text; rows that repeat are counted alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidefolio.llm.common import as_text, slices, some_rows
from tidefolio.llm.merges import MergeVocabulary, walk

#: The pre-tokenizer's pattern, a fixed value of the vocabulary; its white space is Unicode's property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(
    rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
)
#: Borders that no piece crosses, cheaper to find: words with the one space before them, and runs of white space.
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BLANK = re.compile(f"[{SPACE}]")
RUNS = re.compile(rf"[{SPACE}]+|[^{SPACE}]+")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
CACHE = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Counter:
    """Counts for one vocabulary file of byte-level merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()

        def raw(s: str) -> bytes:
            return bytes(letters[c] for c in s)

        model = spec["model"]
        specials = [t["content"] for t in spec.get("added_tokens", ())]
        pairs = (p.split(" ") if isinstance(p, str) else p for p in model["merges"])
        merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in specials}
        self.vocabulary = MergeVocabulary(ids, merges)
        self.specials = frozenset(specials)
        found = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
        self.special = re.compile(f"({found})") if found else None
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """Chunks of a text; a special string is a chunk."""
        if self.special is None or not any(s in text for s in self.specials):
            return CHUNKS.findall(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.specials else CHUNKS.findall(part)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Makes sure that the totals of all these chunks are known."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        known = self.chunks
        new = set().union(*texts).difference(known)
        cut = {c: PIECES.findall(c) for c in new if c not in self.specials}
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        pieces = self.pieces
        fresh = {p for ps in cut.values() for p in ps if p not in pieces}
        for word, _, count in walk(sorted(p.encode() for p in fresh), self.vocabulary):
            pieces[word.decode()] = count[-1]
        for c, ps in cut.items():
            known[c] = sum(map(pieces.__getitem__, ps))
        for s in self.specials:
            known[s] = 1

    def counts(self, texts: list[str]) -> tuple[list[list[str]], list[int]]:
        """Chunks and totals of texts."""
        cut = [self.cut(t) for t in texts]
        self.learn(cut)
        total = self.chunks.__getitem__
        return cut, [sum(map(total, chunks)) for chunks in cut]

    def _prefixes(self, piece: str) -> list[int]:
        """Counts of a piece's prefixes that end with a whole character, from one character on."""
        [(_, _, count)] = walk([piece.encode()], self.vocabulary)
        if piece in CONTRACTIONS:  # cut short it is an apostrophe, then letters
            inner = [1 + n for n in self._prefixes(piece[1:])]
            return [1, *inner[:-1], count[-1]]
        ends = accumulate(len(c.encode()) for c in piece)
        return [count[e] for e in ends]

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of every prefix, from the empty one to the whole text."""
        out, base = [0], 0
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            if part in self.specials:  # cut short it is ordinary text
                out += [base + n for n in self._plain(part)[1:-1]] + [base + 1]
            else:
                out += [base + n for n in self._plain(part)[1:]]
            base = out[-1]
        return out

    def _plain(self, text: str) -> list[int]:
        out, base, lead = [0], 0, ""
        runs = RUNS.findall(text)
        for i, run in enumerate(runs):
            if BLANK.match(run):
                at_end = self._prefixes(run)
                out += [base + n for n in at_end]
                if i + 1 < len(runs):  # the last one goes with the word if it is a plain space
                    base += at_end[-2] if len(run) > 1 else 0
                    lead = " " if run[-1] == " " else ""
                    base += 0 if lead else self._prefixes(run[-1])[-1]
            else:
                for piece in PIECES.findall(lead + run):
                    counts = self._prefixes(piece)
                    out += [base + n for n in counts[1 if lead else 0 :]]
                    base, lead = base + counts[-1], ""
        return out

    def longest_within(self, chunks: list[str], budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        sums = list(accumulate(map(self.chunks.__getitem__, chunks)))
        first = bisect_right(sums, budget)  # the first chunk that ends beyond the budget
        if first == len(chunks):
            return sum(map(len, chunks))
        # White space before a word is counted as a whole run at the end of a prefix, so start before it.
        start = first
        while start and not chunks[start - 1].strip() and chunks[start - 1] not in self.specials:
            start -= 1
        base = sums[start - 1] if start else 0
        if chunks[first] in self.specials:
            near = "".join(chunks[start : first + 1])
        else:
            stop = first + 1
            while stop < min(first + 3, len(chunks)) and chunks[stop] not in self.specials:
                stop += 1
            near = "".join(chunks[start:stop])
        inside = self.prefix_counts(near)
        return sum(map(len, chunks[:start])) + max(i for i, n in enumerate(inside) if base + n <= budget)


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    df: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", budgets: tuple[int, ...] = ()
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, for each budget b, ``chars_b``: the characters of the longest prefix within it."""
    names = [f"chars_{b}" for b in budgets]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for b in some_rows(batches):
            totals: list[int] = []
            cuts: list[list[int]] = [[] for _ in budgets]
            for part in slices(as_text(b.column(2))):  # chunks are held for a slice of the batch at a time
                chunks, counts = counter.counts(part)
                totals += counts
                for out, budget in zip(cuts, budgets, strict=True):
                    both = zip(part, chunks, counts, strict=True)
                    out += [len(t) if n <= budget else counter.longest_within(c, budget) for t, c, n in both]
            arrays = [b.column(0), b.column(1), pa.array(totals, pa.int64()), *[pa.array(c, pa.int64()) for c in cuts]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", *names])

    body = F.col(f"`{text}`")
    narrow = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"),
        body.alias("text"),
    )
    return narrow.mapInArrow(per_batch, "doc_id long, n_bytes long, n_tokens long" + "".join(f", {n} long" for n in names))
