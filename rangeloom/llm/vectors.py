"""Near-duplicate embeddings by product quantisation.

Vectors of equal label (and length) are compared as unit vectors. Coarse centroids give inverted lists, and residual
centroids that all lists share cut a list into cells: as many as the data need for cells of about CELL vectors. In a
cell, a vector is stored with codes of its residual (a byte for each subspace) and the length of what the codes leave
out. A query probes every cell that can hold a vector within the linking distance: by the bisectors between the nearest
and the other centroids, of lists and then of cells, no neighbour lies in what is left out, so the probes are
sufficient; as that holds from either side, a query leaves out cells with smaller numbers than its own. In a cell,
distances to the codes are summed from look-up tables; a vector stays a candidate unless that distance less its coding
error is beyond the linking distance, and candidates are compared by exact cosine. So no link is lost to the index.

Cells and queries are cut into blocks of bounded size, and a pair of blocks gives counts and a labelling of what is
linked, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, materialise
from .components import connected_components

#: The index is fitted on about so many distinct vectors of a length. It has a list for each LIST of the largest label, at
#: most MAX_LISTS (and one for each eight fitted vectors); beyond that lists are cut into cells of about CELL, at most
#: MAX_CELLS a list. More lists and cells don't lose links.
FIT_ROWS, LIST, MAX_LISTS, CELL, MAX_CELLS = 20_000, 128, 2048, 128, 1024
SUBSPACES, CODES, ROUNDS = 8, 256, 6
#: Vectors in a block of a list or of its queries, and queries compared at a time.
BLOCK, AT_ONCE = 2048, 256
#: Vectors measured against all centroids at a time.
ROWS = 512
RERANK = 100_000
SLACK = 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(1)
    return np.concatenate([(norms - 2 * (x[i : i + ROWS] @ centres.T)).argmin(1) for i in range(0, len(x), ROWS)] or [np.zeros(0, dtype=np.int64)])


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (x @ centres.T), 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            sums = np.bincount(near, weights=x[:, d], minlength=k)
            centres[n > 0, d] = sums[n > 0] / n[n > 0]
    return centres


class Index:
    """Coarse centroids, residual centroids of cells, and for each subspace a codebook of what they leave."""

    def __init__(self, sample: np.ndarray, lists: int, cells: int = 1):
        rng = np.random.default_rng(11)
        self.centres = _kmeans(sample, lists, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cells = _kmeans(rest, cells, rng) if cells > 1 else np.zeros((1, sample.shape[1]))
        rest = rest - self.cells[_nearest(rest, self.cells)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, c], CODES, rng) for c in self.cuts]

    def centre(self, cell: int) -> np.ndarray:
        return self.centres[cell // len(self.cells)] + self.cells[cell % len(self.cells)]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and coding error of each row."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        inner = _nearest(rest, self.cells)
        rest = rest - self.cells[inner]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        left = rest - self.decode(codes)
        return own * len(self.cells) + inner, codes.astype(np.uint8), np.sqrt((left * left).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
        """Cells that come within ``reach`` of each row, whose own cell is ``own``."""
        out: list[np.ndarray] = []
        for at in range(0, len(x), ROWS):
            part, lists = x[at : at + ROWS], own[at : at + ROWS] // len(self.cells)
            within = _reached(_squares(part, self.centres), self.centres, lists, reach)
            if len(self.cells) == 1:
                out += [np.flatnonzero(row) for row in within]
                continue
            for q, row in zip(part, within, strict=True):
                some = np.flatnonzero(row)
                inner = _squares(q - self.centres[some], self.cells)
                i, j = np.nonzero(_reached(inner, self.cells, inner.argmin(1), reach))
                out.append(some[i] * len(self.cells) + j)
        return out

    def near(self, q: np.ndarray, cell: int, codes: np.ndarray, errors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) that the table distances don't rule out."""
        rest = q - self.centre(cell)
        total = np.zeros((len(q), len(codes)), dtype=np.float32)
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c]
            table = ((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * (part @ book.T)).astype(np.float32)
            total += table[:, codes[:, i]]
        return np.nonzero(total <= (reach + errors.astype(np.float32) + SLACK)[None, :] ** 2 + SLACK)


def _reached(squares: np.ndarray, centres: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
    """Which centroids' parts of the space come within ``reach`` of points, from their squared distances to all centroids
    and the nearest one: beyond the bisector of two centroids, moved by ``reach``, all is nearer to the first."""
    lead = squares - squares[np.arange(len(squares)), own][:, None]
    return lead <= 2 * reach * np.sqrt(_squares(centres[own], centres)) + SLACK


def _linked(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``ids`` reaches over the links between positions ``left`` and ``right``."""
    label = ids.copy()
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        if (new == label).all():
            return label
        label = new


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; lengths whose squares overflow or vanish are scaled first."""
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search(indexes: dict[int, Index], kind: str, cosine: float, reach: float):
    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index, cell = indexes[int(key[1])], int(key[2])
        ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        ask, home = pdf["ask"].to_numpy(), pdf["home"].to_numpy()
        asks, held = np.flatnonzero(ask), np.flatnonzero(~ask)
        links = np.zeros(len(ids), dtype=np.int64)
        label = ids
        if len(asks) and len(held):
            x = units(pdf["raw"].tolist(), kind)
            codes = np.stack([np.frombuffer(c, np.uint8) for c in pdf["codes"].iloc[held]])
            errors = pdf["error"].to_numpy()[held]
            # an id can stand on both sides: its two positions are linked
            order = np.argsort(ids, kind="stable")
            twins = np.flatnonzero(ids[order][1:] == ids[order][:-1])
            left, right = [order[twins]], [order[twins + 1]]
            for at in range(0, len(asks), AT_ONCE):
                part = asks[at : at + AT_ONCE]
                i, j = index.near(x[part], cell, codes, errors, reach)
                i, j = part[i], held[j]
                other = ids[i] != ids[j]
                i, j = i[other], j[other]
                good = np.zeros(len(i), dtype=bool)
                for lo in range(0, len(i), RERANK):
                    some = slice(lo, lo + RERANK)
                    good[some] = np.einsum("ij,ij->i", x[i[some]], x[j[some]]) >= cosine
                i, j = i[good], j[good]
                links += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
                # queries of other cells aren't asked from here
                away = ~home[i]
                links += np.bincount(j[away], weights=copies[i[away]], minlength=len(ids)).astype(np.int64)
                # keep what these links join, not the links: each position and the one whose id it reaches
                used = np.unique(np.concatenate((i, j)))
                reached = _linked(ids, i, j)[used]
                first = dict(zip(ids[used].tolist(), used.tolist(), strict=True))
                left.append(used)
                right.append(np.array([first[r] for r in reached.tolist()], dtype=np.int64))
            label = _linked(ids, np.concatenate(left), np.concatenate(right))
        keep = (links > 0) | (label != ids)
        return pd.DataFrame({"id": ids[keep], "links": links[keep], "reached": label[keep]})

    return search


def near_vectors(vectors: DataFrame, *, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: key, n_links (others linked directly), component_id (smallest key reachable), kept.

    Vectors of equal non-null label link at a cosine of at least ``cosine`` in double precision. Vectors that are null,
    empty, zero, of another length, or hold null or non-finite components link with nothing, nor do rows without label
    or key (no component, kept). Equal vectors are one class in the search and count as links of each other. Rows that
    repeat a key count each as a vector. Keys may be of any type that has an order. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    own = own if single else own.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    with Scratch(spark) as scratch:
        classes = own.where(sound).groupBy("label", "v").agg(F.min("id").alias("key"), F.count("*").alias("copies"))
        # numbers in place of keys of any type
        classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "key", "label", "copies", "v", F.size("v").alias("dim")), "vectors")
        found = scratch.result(_found(classes, kind, cosine), "found")
    return own.join(found, ["label", "v"], "left").select(
        F.col("id").alias(key), F.coalesce(F.when(F.col("id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    ).withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("component_id")))


def fitted(classes: DataFrame) -> dict[int, Index]:
    """An index for each vector length."""
    by_label = classes.groupBy("dim", "label").agg(F.count("*").alias("n"))
    sizes = {r["dim"]: (r["n"], r["most"]) for r in by_label.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    indexes = {}
    for dim, (n, most) in sorted(sizes.items()):
        share = int(min(1.0, FIT_ROWS / n) * (1 << 40))
        picked = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < share)).select("key", "v").orderBy("key").collect()
        if not picked:
            picked = classes.where(F.col("dim") == dim).select("key", "v").orderBy("key").limit(1).collect()
        sample = np.array([r["v"] for r in picked], dtype=np.float64)
        sample /= np.abs(sample).max(1, keepdims=True)
        lists = max(1, min(MAX_LISTS, -(-most // LIST), len(sample) // 8))
        indexes[dim] = Index(sample / np.linalg.norm(sample, axis=1, keepdims=True), lists, max(1, min(MAX_CELLS, most // (lists * CELL), len(sample) // 8)))
    return indexes


def _found(classes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """label, v, n_links and component (the smallest key reachable) of the distinct vectors that link with others."""
    spark = classes.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    indexes = fitted(classes)
    shared = spark.sparkContext.broadcast(indexes)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                index = shared.value[int(dim)]
                raw = [np.asarray(v, dtype=kind).tobytes() for v in part["v"]]
                x = units(raw, kind)
                lists, codes, errors = index.place(x)
                yield pd.DataFrame({
                    "id": part["id"], "label": part["label"], "copies": part["copies"], "dim": int(dim), "raw": raw, "list": lists.astype("int32"),
                    "codes": [c.tobytes() for c in codes], "error": errors, "probes": [p[p >= c].astype("int32") for p, c in zip(index.probes(x, lists, reach), lists, strict=True)],
                })

    placed = classes.mapInPandas(place, "id long, label string, copies long, dim int, raw binary, list int, codes binary, error double, probes array<int>")
    placed = materialise(placed, "index")
    cell = ["label", "dim", "list"]
    entries = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("eb"))
    asked = placed.select("label", "dim", F.explode("probes").alias("list")).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    cells = materialise(entries.join(asked, cell), "cells")
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = placed.join(cells, cell).select(*cell, block("eb").alias("e"), each("qb").alias("q"), F.lit(False).alias("ask"), F.lit(True).alias("home"), "id", "copies", "codes", "error", "raw")
    asking = placed.select("label", "dim", F.col("list").alias("own"), F.explode("probes").alias("list"), "id", "copies", "raw").join(cells, cell)
    asking = asking.select(*cell, each("eb").alias("e"), block("qb").alias("q"), F.lit(True).alias("ask"), (F.col("own") == F.col("list")).alias("home"), "id", "copies", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), "raw")

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _search(shared.value, kind, cosine, reach)(key, pdf)

    met = stored.unionByName(asking).groupBy(*cell, "e", "q").applyInPandas(search, "id long, links long, reached long")
    met = materialise(met, "links")
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(met.select(F.col("id").alias("a"), F.col("reached").alias("b")))
    least = joined.join(classes.select("id", "key"), "id").groupBy("component").agg(F.min("key").alias("least"))
    joined = joined.join(least, "component").select("id", F.col("least").alias("component"))

    found = classes.select("label", "v", "id", "key", "copies").join(counts, "id", "left").join(joined, "id", "left")
    found = found.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    return found.where((F.col("n_links") > 0) | (F.col("component").isNotNull()))
