"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there (itself and along its output links). Each report
relaxes the best path to that position by the best path to where the piece starts. For a unigram model a path is
worth the sum of its pieces' scores. A BPE model's scores are merge priorities and a path counts only if the merges
would leave each two neighbouring pieces apart; exactly one path to each position does, so the first report that fits
settles the position. Both give the ids that the library gives.

No piece holds a space behind another character, so texts are cut there and each distinct part is encoded once while
it stays in a bounded cache.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, by_size, sole, unused
from .tokens import SPACE, pretokens

#: Parts kept: so many, and so many characters of them.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 8 << 20
PAIR_ENTRIES = 300_000
CHUNK_CHARS = 1 << 20
#: A character without a piece costs so much more than the worst piece (fixed by the library).
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces, scores and kinds of a model file. ``bpe`` None: as the file says."""

    def __init__(self, path: str, bpe: bool | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bpe = model_is_bpe(path) if bpe is None else bpe
        self.unknown = sp.unk_id()
        self.scores = [sp.get_score(i) for i in range(n)]
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                self.raw[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} holds a space behind another character")
                self.ids[piece] = i
                self.raw[i] = piece.replace(SPACE, " ").encode()
        self.raw[self.unknown] = b" \xe2\x81\x87 "
        self.strings = {i: p for p, i in self.ids.items()}
        self.worst = min((self.scores[i] for i in self.strings), default=0.0) - UNKNOWN_PENALTY
        self.covered = frozenset(p for p in self.ids if len(p) == 1)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        # with BPE a piece that merging never leaves whole can't end a path
        for piece, i in self.ids.items():
            if not self.bpe or len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        if self.ids:
            self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The merges of ``text`` in order of priority, leftmost first; for strings of a few pieces only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for j in range(len(parts) - 1):
                i = self.ids.get(parts[j] + parts[j + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], j
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the text of two neighbouring pieces leaves just these two."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            x, y = self.strings[a], self.strings[b]
            known = self.pairs[key] = self.merge(x + y) == [x, y]
        return known

    def encode(self, part: str) -> list[int]:
        """Ids of one part, with spaces already written as SPACE."""
        if self.bpe and self.covered.issuperset(part):
            return self._bpe_covered(part)
        path = self._bpe(part) if self.bpe else self._unigram(part)
        ids = []
        for piece, start, end in path:
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[x] for x in part[start:end].encode("utf-8", "replace")]
            else:  # neighbouring unknown characters are one unknown piece
                if not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids

    def _back(self, last: list, start: list[int]) -> list[tuple[int, int, int]]:
        path, p = [], len(last) - 1
        while p:
            path.append((last[p], start[p], p))
            p = start[p]
        return path[::-1]

    def _bpe_covered(self, part: str) -> list[int]:
        """As _bpe, for a part whose every character is a piece."""
        n = len(part)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        pairs, apart = self.pairs.get, self.apart
        for end, (piece, size) in self.automaton.iter(part):
            end += 1
            if last[end] >= 0:
                continue
            p = end - size
            if p:
                before = last[p]
                if before < 0:
                    continue
                fits = pairs(before << 20 | piece)
                if not (apart(before, piece) if fits is None else fits):
                    continue
            last[end] = piece
            start[end] = p
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        ids.reverse()
        return ids

    def _bpe(self, part: str) -> list[tuple[int, int, int]]:
        n = len(part)
        last: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        done = 0  # positions up to here are settled
        pairs, apart = self.pairs, self.apart
        for end, (piece, size) in self.automaton.iter(part):
            end += 1
            while done < end - 1:  # characters that no report covers
                done += 1
                if last[done] is None:
                    last[done], start[done] = -1, done - 1
            if last[end] is not None:
                continue
            p = end - size
            if p:
                before = last[p]
                if before is None:
                    continue
                if before >= 0:
                    fits = pairs.get(before << 20 | piece)
                    if not (apart(before, piece) if fits is None else fits):
                        continue
            last[end], start[end] = piece, p
        for p in range(done + 1, n + 1):
            if last[p] is None:
                last[p], start[p] = -1, p - 1
        return self._back(last, start)

    def _unigram(self, part: str) -> list[tuple[int, int, int]]:
        n = len(part)
        best = [0.0] + [-np.inf] * n
        last, start = [-1] * (n + 1), [0] * (n + 1)
        done = 0

        def settle(upto: int) -> None:
            """A character whose single piece is missing may stand as unknown."""
            nonlocal done
            while done < upto:
                done += 1
                if part[done - 1] not in self.ids and best[done - 1] + self.worst > best[done]:
                    best[done], last[done], start[done] = best[done - 1] + self.worst, -1, done - 1

        for end, (piece, size) in self.automaton.iter(part):
            settle(end)
            worth = best[end + 1 - size] + self.scores[piece]
            if worth > best[end + 1]:
                best[end + 1], last[end + 1], start[end + 1] = worth, piece, end + 1 - size
        settle(n)
        return self._back(last, start)


def model_is_bpe(path: str) -> bool:
    """Whether a model file's trainer settings (field 2) name BPE (field 3, value 2)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
            else:
                size = number() if kind == 2 else {1: 8, 5: 4}[kind]
                yield tag >> 3, data[at : at + size]
                at += size

    with open(path, "rb") as file:
        model = file.read()
    for field, value in fields(model):
        if field == 2:
            return any(f == 3 and v == 2 for f, v in fields(value))
    return False


class Encoder:
    """Encodes texts; keeps the parts used of late, at most twice what CACHE_ENTRIES and CACHE_CHARS name and one call's own."""

    def __init__(self, path: str, bpe: bool | None = None):
        self.pieces = Pieces(path, bpe)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [pretokens(x) for x in texts]
        if len(self.recent) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.recent, self.older, self.chars = {}, self.recent, 0
        recent, older, encode = self.recent, self.older.get, self.pieces.encode
        for part in set().union(*cut).difference(recent):
            self.chars += len(part)
            recent[part] = older(part) or array("i", encode(SPACE + (part.replace(" ", SPACE) if " " in part else part))).tobytes()
        get = recent.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), dtype=np.int32) for x in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; one space at its start is the one the encoder added."""
        out = b"".join(map(self.pieces.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def encode(docs: DataFrame, model: str, *, bpe: bool | None = None, text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with the column ``into`` (struct of ids array<int>, n_ids, round_trip) added, which must not be there yet.

    round_trip tells whether decoding the ids gives the text again (U+2581 counts as a space, as in the library).
    Null and empty texts have no ids and round_trip true. ``model`` is a file that every executor can open.
    """

    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sole(Encoder, model, bpe)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            # rows leave in parts of bounded size, so memory doesn't follow the size of a batch's result
            for part in by_size((x.as_py() for x in column), CHUNK_CHARS):
                each = enc.encode(part)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                whole = [enc.decode(ids) == one.replace(SPACE, " ") for one, ids in zip(part, each, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each), pa.int32()))
                found = pa.StructArray.from_arrays([lists, pa.array(np.diff(ends), pa.int64()), pa.array(whole, pa.bool_())], ["ids", "n_ids", "round_trip"])
                same = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*same.columns, found], [*same.schema.names, into])

    pieces = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("n_ids", T.LongType()).add("round_trip", T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, pieces)]))


def decode(encoded: DataFrame, model: str, *, bpe: bool | None = None, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the decoded text in ``into``; null ids give a null text, ids outside the model an error."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = sole(Encoder, model, bpe)
        for batch in batches:
            yield pd.Series([None if x is None else enc.decode(np.asarray(x)) for x in batch], dtype="object")

    return encoded.withColumn(into, run(F.col(ids)))


def encoded_documents(docs: DataFrame, model: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, ids, n_ids, round_trip; other columns are ignored."""
    into = unused("pieces", key, text)
    return encode(docs.select(key, text), model, text=text, into=into).select(key, f"{into}.*")
