"""Merge vocabularies read forwards: the last token of every prefix, and with it the count, word by word.

Byte-pair merging has a local property. Call two tokens a good pair if merging their joined text from scratch gives just
these two. A sequence of tokens, each stable on its own, is what merging gives exactly if all neighbours are good pairs:
the first merge across a border would already happen in the text of the two tokens alone, for the merges on either side
come in the same order there. So the last token of a prefix is the one token that ends there and is a good pair with the
last token of what is before it, and a table from left to right holds the exact segmentation of every prefix.

Words are taken in sorted order, so a word continues the table of the longest prefix it shares with the one before: a
depth-first walk through the trie of the words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

#: Entries a cache of good pairs or words may hold before it starts anew.
PAIRS = 1 << 19


class MergeVocabulary:
    """Pieces (bytes or str) with ids; ``rank`` of a merge of two pieces, smaller merges first, leftmost among equals."""

    def __init__(self, ids: dict, merges: dict | None = None, ranks: dict | None = None):
        """``merges`` maps (left, right) to a rank; without it any two pieces merge if their join has a rank."""
        self.ids, self.merges, self.ranks = ids, merges, ranks
        self.longest = max(map(len, ids), default=1)
        self.pairs: dict[tuple, bool] = {}
        self._stable: dict = {}

    def _rank(self, a, b):
        return self.merges.get((a, b)) if self.merges is not None else self.ranks.get(a + b)

    def merge(self, parts: Iterable) -> list:
        """Plain merging of symbols, for short texts."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self._rank(parts[i], parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, token) -> bool:
        known = self._stable.get(token)
        if known is None:
            known = self._stable[token] = len(self.merge(symbols(token))) == 1
        return known

    def good(self, left, right) -> bool:
        """Whether the joined text of the two merges to just these two, which makes both stable."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merge([*symbols(left), *symbols(right)]) == [left, right]
        return known


def symbols(text) -> list:
    """Characters of a str, single bytes of bytes."""
    return list(text) if isinstance(text, str) else [text[i : i + 1] for i in range(len(text))]


def walk(words: Sequence, vocabulary: MergeVocabulary) -> Iterator[tuple]:
    """(word, last, count) for each distinct word in sorted order; ``last[e]`` is the last token of the prefix of length
    e and ``count[e]`` its number of tokens. The lists are overwritten by the next word.

    A symbol outside the vocabulary is a token of its own that no other token merges with.
    """
    ids, longest, pairs = vocabulary.ids, vocabulary.longest, vocabulary.pairs
    last: list = [None]
    count: list[int] = [0]
    before = words[0][:0] if words else ""
    for word in words:
        same = shared(before, word)
        del last[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            at = end - longest if end > longest else 0
            while at < end:
                token = word[at:end]
                if token in ids:
                    if at == 0:
                        fits = vocabulary.stable(token)
                    else:
                        left = last[at]
                        fits = pairs.get((left, token))
                        if fits is None:
                            fits = vocabulary.good(left, token)
                    if fits:
                        break
                at += 1
            else:
                at = end - 1
                token = word[at:end]
            last.append(token)
            count.append(count[at] + 1)
        before = word
        yield word, last, count


def shared(a, b) -> int:
    """Length of the longest common prefix."""
    if b[: len(a)] == a:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo
