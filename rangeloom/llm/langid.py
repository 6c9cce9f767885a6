"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily into the longest
phrases that occur in that text; the language that needs the fewest phrases, normalised by the description
length of a phrase (log2 of its training length), wins. The automaton with its restarts at phrase ends is one
table ``[state, letter] -> next state and whether a phrase begins``, so that many stretches of text are parsed in
step by array look-ups; where a script has so many letters that this table grows large, its transitions are kept
sorted and searched instead. A text is one parse, whatever its length: stretches are first parsed from the start state,
then again from the state that the stretch before ended in, up to the letter where both parses are in one state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, by_size, sole, unused

UNKNOWN = "und"
#: Letters parsed in step with those of other stretches; it has no effect on the result.
STRETCH = 256
#: Rounds in which all stretches whose start state changed are parsed again at once.
TOGETHER = 4
#: So few stretches are parsed one by one.
FEW = 32
CHUNK_CHARS = 1 << 19
FOLDS = 5
#: A language with more cells than this in its table (64 MB) is parsed by search.
DENSE_CELLS = 1 << 24
#: Letter codes: padding, any run of non-letters, a letter that no training text holds; learned letters follow.
PAD, GAP, OTHER, FIRST = 0, 1, 2, 3


def learn_sample(docs: DataFrame, *, train_chars: int = 32_768, rows: int = 96, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, str]:
    """Training text per language, at most ``train_chars`` characters each, from about ``rows`` labelled rows a language.

    Only rows whose crc32(key as text) mod 5 is not 0 are used. The rows are those with the smallest key hashes, so
    the sample doesn't depend on the partitioning; each gives at most an eighth of a language's text, from a place
    chosen by that hash, and equal stretches are taken once. Languages are few (they are class labels). At most
    2 * ``rows`` stretches a language reach the driver, also where one key repeats in many rows.
    """
    labelled = (
        docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
        .where(F.col("l").isNotNull() & (F.crc32(F.col("k").cast("string")) % FOLDS != 0))
        .withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1 << 40)))
    )
    # keys with text; each needs one place in the sketch, not one in a shuffle
    named = labelled.where(F.col("t").isNotNull() & (F.col("t") != "")).groupBy("l").agg(F.approx_count_distinct("h").alias("n"))
    sizes = {r["l"]: max(1, r["n"]) for r in named.collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(int(min(1.0, rows / n) * (1 << 40))))])
    each = train_chars // 8
    piece = F.substring("t", (1 + F.col("h") % F.greatest(F.lit(1), F.length("t") - each + 1)).cast("int"), F.lit(each))
    picked = labelled.where(F.col("t").isNotNull() & (F.col("h") < share[F.col("l")])).select("l", "h", "k", piece.alias("p")).distinct()
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "k", "p"))
    picked = picked.withColumn("i", first).where(F.col("i") <= 2 * rows).collect()
    out: dict[str, str] = {}
    for l in sorted(sizes):
        parts = dict.fromkeys(r["p"] for r in sorted((r for r in picked if r["l"] == l), key=lambda r: (r["h"], r["k"], r["p"])))
        out[l] = " ".join(parts)[:train_chars]
    return {l: t for l, t in out.items() if any(map(str.isalpha, t))}


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of one training text."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return following


def dense(following: list[dict[int, int]], letters: int) -> np.ndarray:
    """The parse table, flattened: value = 2 * (next state * letters) + (a phrase begins here)."""
    start = np.zeros(letters, dtype=np.int64)
    for c, s in following[0].items():
        start[c] = s
    # without a transition the letter begins the next phrase; one unseen even alone is a phrase by itself
    table = np.tile(2 * start * letters + 1, (len(following), 1))
    for s, nexts in enumerate(following):
        if nexts:
            table[s, list(nexts)] = 2 * letters * np.fromiter(nexts.values(), dtype=np.int64)
    table[0] |= 1  # the start, and behind a letter that is unseen even alone: a phrase begins in any case
    table[:, PAD] = 0
    return table.astype(np.int32).ravel()


class Sparse:
    """The same table as sorted transitions: what it lacks goes on from the start."""

    def __init__(self, following: list[dict[int, int]], letters: int):
        self.letters = letters
        keys = np.array([s * letters + c for s, nexts in enumerate(following) for c in nexts] + [len(following) * letters], dtype=np.int64)
        nexts = np.array([x for nexts in following for x in nexts.values()] + [0], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nexts = keys[order], nexts[order]
        self.start = np.zeros(letters, dtype=np.int64)
        for c, s in following[0].items():
            self.start[c] = s

    def step(self, state: np.ndarray, row: np.ndarray) -> np.ndarray:
        """2 * next state + (a phrase begins here)."""
        wanted = state * self.letters + row
        at = np.searchsorted(self.keys, wanted)
        held = self.keys[at] == wanted
        return 2 * np.where(held, self.nexts[at], self.start[row]) + ((row != PAD) & (~held | (state == 0)))


class Dense:
    """The parse table as an array over all states and letters; states are multiplied by the number of letters."""

    def __init__(self, following: list[dict[int, int]], letters: int):
        self.table = dense(following, letters)

    def step(self, state: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.table.take(state + row)

    def again(self, state: int, letters: list[int], trail: list[int]) -> list[int]:
        """``trail`` of one lane from another start state, letter by letter."""
        out = []
        for c, old in zip(letters, trail, strict=True):
            got = self.table.item(state + c)
            out.append(got)
            state = got >> 1
            if state == old >> 1:
                break
        return out + trail[len(out) :]


def parse_lanes(table: Dense | Sparse, steps: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane (column of ``steps``); a lane that ``follows`` goes on from the end of the one before."""
    trail = np.empty(steps.shape, dtype=np.int64 if isinstance(table, Sparse) else np.int32)
    state = np.zeros(steps.shape[1], dtype=trail.dtype)
    for t, row in enumerate(steps):
        trail[t] = table.step(state, row)
        state = trail[t] >> 1
    # from the true states: only as far as the parse differs from the one before, and in turn for what follows
    begun = np.zeros(steps.shape[1], dtype=trail.dtype)
    rounds = TOGETHER
    while True:
        came = np.zeros_like(begun)
        came[1:] = np.where(follows[1:], trail[-1, :-1] >> 1, 0)
        changed = came != begun
        if not changed.any():
            return (trail & 1).sum(axis=0)
        if rounds:
            rounds -= 1
        else:
            # parses that stay apart (one letter over and over): each stretch waits for the one before
            changed[1:] &= ~changed[:-1]
        lanes = np.flatnonzero(changed)
        begun[lanes] = state = came[lanes]
        if len(lanes) <= FEW and isinstance(table, Dense):
            for lane in lanes.tolist():
                trail[:, lane] = table.again(came.item(lane), steps[:, lane].tolist(), trail[:, lane].tolist())
            continue
        for t, row in enumerate(steps):
            got = table.step(state, row[lanes])
            apart = got >> 1 != trail[t, lanes] >> 1
            trail[t, lanes] = got
            if not apart.all():
                lanes, got = lanes[apart], got[apart]
                if not len(lanes):
                    break
            state = got >> 1


class Parser:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [l for l, _ in samples]
        seen = sorted({c for _, t in samples for c in t.lower() if c.isalpha()})
        self.letters = FIRST + len(seen)
        self.code = np.full(0x110000, GAP, dtype=np.min_scalar_type(self.letters))
        self.code[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
        for i, c in enumerate(seen):
            self.code[ord(c)] = FIRST + i
        #: A table for each language, and its own numbers of the letters (None: the common ones) if there are many.
        self.tables: list[Dense | Sparse] = []
        self.own: list[np.ndarray | None] = []
        self.weights = []
        for _, t in samples:
            codes = self.encode(t)
            own, letters = None, self.letters
            if letters > 256:
                mine = np.unique(codes[codes >= FIRST])
                own = np.minimum(np.arange(letters), OTHER).astype(np.int32)
                own[mine] = FIRST + np.arange(len(mine))
                letters = FIRST + len(mine)
            following = automaton((codes if own is None else own[codes]).tolist())
            self.own.append(own)
            self.tables.append((Dense if len(following) * letters <= DENSE_CELLS else Sparse)(following, letters))
            self.weights.append(math.log2(len(codes) + 2))

    def encode(self, text: str) -> np.ndarray:
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]
        if len(codes):
            keep = codes != GAP
            keep[1:] |= codes[:-1] != GAP
            codes = codes[keep]
        return codes

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters and learned letters per text, and phrases per text and language."""
        codes = [self.encode(t) for t in texts]
        letters = np.array([int((c >= OTHER).sum()) for c in codes], dtype=np.int64)
        learned = np.array([int((c >= FIRST).sum()) for c in codes], dtype=np.int64)
        lanes = np.array([-(-len(c) // STRETCH) for c in codes], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(lanes)))
        flat = np.zeros(int(first[-1]) * STRETCH, dtype=self.code.dtype)
        for c, at in zip(codes, first, strict=False):
            flat[at * STRETCH : at * STRETCH + len(c)] = c
        steps = np.ascontiguousarray(flat.reshape(-1, STRETCH).T).astype(np.int32)
        phrases = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        of = np.repeat(np.arange(len(texts)), lanes)
        follows = np.diff(of, prepend=-1) == 0
        for j, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            begun = parse_lanes(table, steps if own is None else own.take(steps), follows)
            phrases[:, j] = np.bincount(of, weights=begun, minlength=len(texts))
        return letters, learned, phrases

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters, learned, phrases = self.parse(texts)
        cost = phrases * np.array(self.weights)
        best = cost.argmin(axis=1)
        at = np.arange(len(texts))
        least = cost[at, best]
        if len(self.langs) > 1:
            cost[at, best] = np.inf
            next_best = cost.min(axis=1)
        else:
            next_best = np.maximum(letters, 1) * self.weights[0]
        score = np.clip(1 - least / np.maximum(next_best, 1e-9), 0, 1)
        score[letters == 0] = 0
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)], score, (letters > 0) & (2 * learned >= letters)


def identify(docs: DataFrame, samples: dict[str, str], *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with the column ``into`` (struct of lang_pred, score, evidence) added, which must not be there yet.

    lang_pred is ``und`` for a null text, one without letters, or if nothing was learned; of languages with equal cost
    the first by name wins. score is 1 - the winner's cost over the runner-up's (0: tie); evidence tells whether at least half of the letters occur in training texts.
    """
    bounded_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    @F.arrow_udf("lang_pred string, score double, evidence boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = sole(Parser, held.value) if held.value else None
        for batch in batches:
            names: list[str] = []
            scores, found = [np.zeros(0)], [np.zeros(0, bool)]
            for part in by_size((x.as_py() for x in batch), CHUNK_CHARS):
                n, s, e = parser.predict(part) if parser else ([UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part), bool))
                names += n
                scores.append(s)
                found.append(e)
            columns = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(found))]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "evidence"])

    return docs.select("*", predict(F.col(text)).alias(into))


def language_id(docs: DataFrame, *, train_chars: int = 32_768, rows: int = 96, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score, evidence.

    Learns from the non-null labels of the rows outside the held-out fold, and predicts from the text alone. A null
    key is in no fold: never learned from, held_out false. Repeated rows are predicted each; empty tables give none.
    """
    samples = learn_sample(docs, train_chars=train_chars, rows=rows, text=text, lang=lang, key=key)
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out")
    into = unused("language", key, text)
    named = identify(docs.select(key, text), samples, text=text, into=into)
    return named.select(key, held_out, f"{into}.lang_pred", f"{into}.score", f"{into}.evidence")
