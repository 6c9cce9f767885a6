"""Token counts by the whole-token shortcut.

A vocabulary string that encodes alone as one token needs no merging wherever it stands alone between
pre-token borders. That is proved once, on the driver, by encoding every vocabulary string. Texts are cut
where no vocabulary piece can cross (before a space that follows another character), pre-tokens that are
proved strings count one each, and only the rest is merged, each distinct one once while it stays in a
bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, by_size, sole

#: Marks a space inside SentencePiece pieces (fixed by that library).
SPACE = "▁"
#: A pre-token: spaces and what follows them up to the next space, or trailing spaces.
PRETOKEN = re.compile(r" *[^ ]+| +")
#: Merged pre-tokens kept: so many, and so many characters of them.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 16 << 20
CHUNK_CHARS = 1 << 20


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove_whole(path: str) -> frozenset[str]:
    """Pre-tokens, without their leading space, that the model encodes alone as one token.

    Raises ValueError if a piece holds a space after another character: then texts could not be cut at spaces.
    """
    sp = processor(path)
    whole = []
    for i in range(sp.vocab_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
        if piece.startswith(SPACE):
            text = piece[1:].replace(SPACE, " ")
            if text and len(sp.encode(text)) == 1:
                whole.append(text)
    return frozenset(whole)


def pretokens(text: str) -> list[str]:
    """Pre-tokens of ``text``, each without the one space that the encoder puts in front by itself.

    The library treats a literal U+2581 as a space, and adds one space before the text.
    """
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [x[1:] for x in PRETOKEN.findall(" " + text)]


class Counter:
    """Counts tokens of texts; holds at most CACHE_ENTRIES merged pre-tokens (of CACHE_CHARS characters) and one call's own beside the proved ones."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.sp = processor(path)
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)
        self.chars = 0

    def count(self, texts: list[str]) -> list[int]:
        cut = [pretokens(x) for x in texts]
        rest = set().union(*cut).difference(self.known)
        if rest:
            if len(self.known) + len(rest) > CACHE_ENTRIES + len(self.whole) or self.chars > CACHE_CHARS:
                self.known, self.chars = dict(self.whole), 0
                rest = set().union(*cut).difference(self.known)
            rest = list(rest)
            self.chars += sum(map(len, rest))
            # a pre-token that is only its own space comes as "", which the library would encode as nothing
            self.known.update(zip(rest, map(len, self.sp.encode(rest, num_threads=1)), strict=True))
            self.known[""] = 1
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in cut]


def token_counts(docs: DataFrame, model: str, *, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``model`` is a SentencePiece file that every executor can open. Null and empty texts count 0; repeated rows
    are counted each; other columns are ignored. Texts are counted whole, whatever their length.
    """
    bounded_batches(docs)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(model))

    @F.pandas_udf(T.LongType())
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = sole(Counter, model, whole.value)
        for batch in batches:
            yield pd.Series([n for part in by_size(batch, CHUNK_CHARS) for n in counter.count(part)], dtype="int64")

    full = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select(F.col(key), full.alias("__text"))
        .select(key, F.octet_length("__text").cast("long").alias("n_bytes"), n_tokens("__text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
