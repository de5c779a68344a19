"""SentencePiece encoding and decoding by a shared-prefix forward pass over the trie of distinct marked words.

White space becomes the mark U+2581 and a mark is put before the text. Marked words are runs of marks with the characters
that follow them, cut also at characters that no longer piece holds (line ends); no piece crosses such a border, which is
checked on the vocabulary. The distinct words of an Arrow batch that are not known yet are sorted and walked depth-first
as a trie: the forward table of a word (for every prefix, its best last piece and score) continues that of the prefix it
shares with the word before. Tracing back gives the ids; each text is then a join of its words' packed ids.

The forward step depends on the model. For unigram models it is Viterbi's: the largest sum of piece scores. A merge (BPE)
model's pieces are not the ones with the largest sum; there the step takes the one piece that ends at the position and
is a good neighbour of the last piece before it (see ``merges``), which gives the model's own segmentation. Characters
outside the vocabulary become byte pieces, or the unknown id without byte fallback.

Defined cases: null and empty texts have no ids; decoding no ids gives the empty text; texts of any length are encoded
whole; the mark itself in a text decodes to a space, as the model writes both alike; control ids decode to nothing and
bytes that are no UTF-8 to U+FFFD; rows that repeat are encoded alike; an empty table gives no rows; extra columns are
kept under their names unless they are called ``ids`` or ``n_pieces``, which the results replace.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidefolio.llm.common import as_text, slices, some_rows
from tidefolio.llm.merges import MergeVocabulary, shared, walk

MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far an unknown character's score lies below the lowest piece's, a fixed value of the model family.
UNKNOWN_PENALTY = 10.0
CACHE = 400_000
#: Words the library is given at a time; its heap is slow on long texts.
TOGETHER = 1000
INT = np.dtype("<i4")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """Encoder and decoder of one model file (or its serialized bytes)."""

    def __init__(self, model: str | bytes):
        from sentencepiece import sentencepiece_model_pb2 as spec

        proto = spec.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are known")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that rewrite their text are not known")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not known")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on beyond a word are not known")
        self.surface = [
            b"" if p.type == CONTROL else bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE
            else proto.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        #: Pieces whose own mark stands for the one put before the text.
        self.marked = [p.type == NORMAL and p.piece.startswith(MARK) for p in proto.pieces]
        alone = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.ids))
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + f"|[{alone}]" * bool(alone))
        self.vocabulary = MergeVocabulary(self.ids, ranks={p: -s for p, s in self.scores.items()})
        self.longest = self.vocabulary.longest
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, bytes] = {}

    def _piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _viterbi(self, words: list[str]) -> Iterator[tuple[str, list[str | None]]]:
        """(word, last): the last piece of the best segmentation of every prefix."""
        scores, before = self.scores, ""
        last: list[str | None] = [None]
        best = [0.0]
        for word in words:
            same = shared(before, word)
            del last[same + 1 :], best[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                top, piece = None, None
                for at in range(max(0, end - self.longest), end):
                    token = word[at:end]
                    score = scores.get(token)
                    if score is None:
                        if at < end - 1:
                            continue
                        score = self.lowest
                    if top is None or best[at] + score > top:
                        top, piece = best[at] + score, token
                last.append(piece)
                best.append(top)
            before = word
            yield word, last

    def learn(self, words: set[str]) -> None:
        """Packed ids of all these words; words the vocabulary walk has not seen are walked in sorted order."""
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = sorted(words.difference(self.known))
        if self.kind == MERGES:
            tables = ((word, last) for word, last, _ in walk(fresh, self.vocabulary))
        else:
            tables = self._viterbi(fresh)
        for word, last in tables:
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            self.known[word] = pack([i for p in reversed(pieces) for i in self._piece_ids(p)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian 32-bit integers. Words are held for a slice of the texts at a time."""
        out = []
        for part in slices(texts):
            cut = [self.words.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in part]
            self.learn(set().union(*cut))
            known = self.known.__getitem__
            out += [b"".join(map(known, words)) for words in cut]
        return out

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, INT).tolist()
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if first is not None and self.prefix and self.marked[first] else text


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p) // INT.itemsize for p in packed]], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), INT)))


def encode(df: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), ids array<int> and n_pieces."""
    names = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "n_pieces")]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    carried = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for b in some_rows(batches):
            ids = _lists(codec.encode(as_text(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, ids.value_lengths()], ["row", "ids", "n_pieces"])

    schema = f"row {rows.schema.simpleString()}, ids array<int>, n_pieces int"
    return carried.mapInArrow(per_batch, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in names], "ids", "n_pieces")


def encode_packed(df: DataFrame, path: str, *, width: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids: binary, little-endian integers of ``width`` bytes (1, 2 or 4), which must hold the model's ids."""
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        if len(codec.surface) > 1 << (8 * width):
            raise ValueError(f"ids of this model do not fit into {width} bytes")
        for b in some_rows(batches):
            packed = [np.frombuffer(p, INT).astype(f"<u{width}").tobytes() for p in codec.encode(as_text(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return narrow.mapInArrow(per_batch, "doc_id long, ids binary")


def library_ids(path: str, width: int = 2) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    """For tasks that only need the ids, packed in ``width`` bytes: the model's own library over each distinct word once.

    Words are joined by line ends, which no piece with other characters holds, and the ids cut there again.
    """

    def opened() -> Callable[[list[str]], list[bytes]]:
        from sentencepiece import SentencePieceProcessor

        model, codec = SentencePieceProcessor(model_file=path), load(path)
        kind = np.dtype(f"<u{width}")
        if len(codec.surface) > 1 << (8 * width):
            raise ValueError(f"ids of this model do not fit into {width} bytes")
        end = codec._piece_ids("\n")
        if len(end) > 1 or any("\n" in p and len(p) > 1 for p in codec.ids):
            return lambda texts: [np.array(model.encode(t), kind).tobytes() for t in texts]
        known: dict[str, bytes] = {}

        def learn(words: list[str]) -> None:
            ids = np.array(model.encode("\n" + "\n".join(words)), kind)
            ends = np.flatnonzero(ids == end[0]) + 1
            packed, starts = ids.tobytes(), (ends * width).tolist()
            stops = [*((ends[1:] - 1) * width).tolist(), len(packed)]
            known.update((w, packed[a:b]) for w, a, b in zip(words, starts, stops, strict=True))

        def packed_ids(texts: list[str]) -> list[bytes]:
            cut = [codec.words.findall(codec.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
            words = set().union(*cut)
            if len(known) > CACHE:
                known.clear()
            known["\n"] = np.array(end, kind).tobytes()
            fresh = list(words.difference(known))
            for i in range(0, len(fresh), TOGETHER):
                learn(fresh[i : i + TOGETHER])
            return [b"".join(map(known.__getitem__, x)) for x in cut]

        return packed_ids

    return opened


def decode(df: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of its ids (null for null)."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load(path)
        for s in batches:
            yield s.map(lambda x: None if x is None else codec.decode(np.asarray(x, INT).tobytes()))

    return df.withColumn(out, texts(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip: whether decoding gives the
    text again, the mark read as a space."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for b in some_rows(batches):
            texts = as_text(b.column(1))
            packed = codec.encode(texts)
            same = [codec.decode(p) == t.replace(MARK, " ") for p, t in zip(packed, texts, strict=True)]
            arrays = [b.column(0), pa.array([len(p) // INT.itemsize for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "packed", "round_trip"])

    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = narrow.mapInArrow(per_batch, "doc_id long, n_pieces long, packed binary, round_trip boolean")
    return rows.select("doc_id", "n_pieces", F.sha2("packed", 256).alias("ids_sha256"), "round_trip")
