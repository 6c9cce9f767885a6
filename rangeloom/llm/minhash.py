"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A permutation gives two signature components, the least and the greatest hash of a document's shingles; either is
equal in two documents with probability their Jaccard similarity. So N permutations give 2N components for half the
hash evaluations, and the two of one permutation go to different bands.

1. One pass over the texts: distinct shingles, an exact fingerprint of the set, band hashes.
2. Documents with equal sets become one class (a partial aggregation, whatever the size of a group of copies).
3. Classes that share a band hash (a bucket) are candidates. Every class is linked to the smallest of its bucket only;
   components of these links are neighbourhoods that no true link leaves.
4. A neighbourhood of one block of bounded size is compared whole, on full sets, and gives a spanning forest of the
   links that hold: never the pairs themselves.
5. In a wider one, each class meets the smallest class of all its buckets. After that only buckets whose members aren't yet
   one component are looked at again, one of those with equal members: there, all that isn't in the bucket's largest
   component meets the bucket, block by block. So only classes that share a bucket are compared; unless the buckets of a
   neighbourhood overlap so much that their union makes fewer pairs than they do one by one: then the union is one.
6. Components of the confirmed links give the smallest reachable document.

Sets are compared as sets of 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, by_size, materialise, sole
from .components import connected_components

PERMUTATIONS = 128
#: Largest chance to miss a pair that lies exactly at the threshold.
MISS = 1e-4
CHUNK_CHARS = 1 << 19
#: A block of steps 4 and 5 holds about so many classes or shingles, whichever is less.
BLOCK_SETS, BLOCK_SHINGLES = 512, 250_000
#: Classes of a block in step 5: those that meet one class, and those that meet another block.
STAR_SETS, PAIR_SETS = 128, 256
COLUMNS = 1024

_RANDOM = np.random.default_rng(20_240_501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_BLANK] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_A = (_RANDOM.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words, and where each word starts."""
    a = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_BLANK[a]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    size = max(2 * CHUNK_CHARS, 1 << len(a).bit_length())
    up, down = sole(_powers, size)
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, ASCII letters lower-cased, and the offsets of the texts in them.

    A long text is hashed in pieces that end at a blank, so memory follows its words.
    """
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    if len(raws) == 1 and len(raws[0]) > CHUNK_CHARS:
        raw, parts, at = raws[0], [], 0
        while at < len(raw):
            end = at + CHUNK_CHARS
            while end < len(raw) and not _BLANK[raw[end]]:
                end += 1
            parts.append(_hash_words(raw[at:end])[0])
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    words, starts = _hash_words(b" ".join(raws) + b" ")
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    return words, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles; of all words if there are fewer."""
    words, at = word_hashes(texts)
    n = len(words) - size + 1
    every = mix(sum((words[i : i + n] * _PLACE[i] for i in range(size)), np.uint64(size))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        m = hi - lo
        if m >= size:
            out.append(np.unique(every[lo : hi - size + 1]))
        elif m:
            out.append(mix((words[lo:hi] * _PLACE[:m]).sum(keepdims=True, dtype=np.uint64) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_rows(threshold: float) -> int:
    """Components in a band: as many as keep the chance of a miss at the threshold under MISS."""
    k = 1
    while (1 - threshold ** (k + 1)) ** (2 * PERMUTATIONS // (k + 1)) <= MISS:
        k += 1
    return k


def bands(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Band hashes, a row for each set; sets must not be empty."""
    lens = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    part = np.empty((2 * PERMUTATIONS, len(sets)), dtype=np.uint64)
    t = np.empty_like(x)
    for i in range(PERMUTATIONS):
        np.multiply(x, _A[i], out=t)
        np.add(t, _B[i], out=t)
        part[i] = np.minimum.reduceat(t, at)
        # greatest values half the list away, so that no band holds both of one permutation
        part[PERMUTATIONS + (i + PERMUTATIONS // 2) % PERMUTATIONS] = np.maximum.reduceat(t, at)
    # least and greatest values take turns
    part = part.reshape(2, PERMUTATIONS, -1).transpose(1, 0, 2).reshape(2 * PERMUTATIONS, -1)
    count = 2 * PERMUTATIONS // rows
    out = np.empty((len(sets), count), dtype=np.uint64)
    for b in range(count):
        h = np.full(len(sets), b + 1, dtype=np.uint64)
        for c in part[b * rows : (b + 1) * rows]:
            h = mix(h * _BASE + c)
        out[:, b] = h
    return out.view(np.int64)


def _sketches(size: int, rows: int):
    @F.arrow_udf("n long, f1 long, f2 long, bands array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, first, second, banded = [], [], [], []
            for part in by_size((x.as_py() for x in batch), CHUNK_CHARS):
                sets = shingle_sets(part, size)
                full = [s for s in sets if len(s)]
                rest = iter(bands(full, rows) if full else ())
                counts += map(len, sets)
                first += [s.sum(dtype=np.uint64).view(np.int64) for s in sets]
                second += [mix(s).sum(dtype=np.uint64).view(np.int64) for s in sets]
                banded += [next(rest) if len(s) else None for s in sets]
            columns = [pa.array(np.array(c, dtype=np.int64)) for c in (counts, first, second)]
            yield pa.StructArray.from_arrays([*columns, pa.array(banded, pa.list_(pa.int64()))], ["n", "f1", "f2", "bands"])

    return sketch


def _sets(size: int):
    @F.arrow_udf("shingles array<long>, f1 long, f2 long")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, first, second = [], [], []
            for part in by_size((x.as_py() for x in batch), CHUNK_CHARS):
                for s in shingle_sets(part, size):
                    out.append(s.view(np.int64))
                    first.append(s.sum(dtype=np.uint64).view(np.int64))
                    second.append(mix(s).sum(dtype=np.uint64).view(np.int64))
            columns = [pa.array(out, pa.list_(pa.int64())), pa.array(np.array(first, dtype=np.int64)), pa.array(np.array(second, dtype=np.int64))]
            yield pa.StructArray.from_arrays(columns, ["shingles", "f1", "f2"])

    return sets


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered in ``left`` with those in ``right``, exactly."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    of, code = of[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    got = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(code, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[of[a:b], code[a:b] - lo] = 1
        got += has[left] @ has[right].T
    return got.astype(np.int64)


def forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` with 100 * intersection >= percent * union."""
    both = common(sets, left, right)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    union = size[left][:, None] + size[right][None, :] - both
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True):
        x, y = root(int(left[i])), root(int(right[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[left[i]]), int(ids[right[j]])))
    return out


def _confirm(percent: int):
    def confirm(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, bi, bj = key
        links: list[tuple[int, int]] = []
        for _, group in pdf.groupby("hood", sort=False):
            if len(group) > 1:
                ids, block = group["id"].to_numpy(), group["block"].to_numpy()
                sets = [np.asarray(s) for s in group["shingles"]]
                every = np.arange(len(ids))
                left, right = (every, every) if bi < 0 else (np.flatnonzero(block == bi), np.flatnonzero(block == bj))
                links += forest(ids, sets, left, right, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return confirm


def _blocks(n: str | Column, most: int | None = None) -> Column:
    """How many blocks of ``most`` rows (BLOCK_SETS) the rows of a group fill; rows whose ``n`` is null aren't counted."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.ceil(F.count(n) / (most or BLOCK_SETS)), F.ceil(F.coalesce(F.sum(n), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _block(of: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), F.col(of)).cast("int")


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links of the sets that stand in the two blocks of a pair (-1: a group of whole neighbourhoods)."""
    return rows.groupBy("g", "bi", "bj").applyInPandas(_confirm(percent), "a long, b long")


def _smallest() -> Column:
    """The class that a class meets first: the smallest of its buckets, but for itself."""
    return F.array_min(F.filter(F.col("buckets.a"), lambda a: a != F.col("id")))


def _by_smallest(wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each class with the smallest one of its buckets (of several, the smallest of these)."""
    pairs = wide.select("id", "n", _smallest().alias("a")).where(F.col("a").isNotNull())
    # classes that have one smallest class in common, in blocks; it stands in each of them
    sized = pairs.groupBy("a").agg(_blocks("n", STAR_SETS).alias("blocks"))
    placed = materialise(pairs.join(sized, "a").select("id", F.col("a").alias("g"), _block("blocks").alias("b"), F.lit(1).alias("block")), "pairs")
    first = sized.select(F.col("a").alias("id"), F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("block"))
    rows = placed.unionByName(first).join(sets.select("id", "shingles"), "id")
    rows = rows.select("id", "shingles", "block", F.lit(0).alias("hood"), F.struct("g", "b").alias("g"), F.lit(0).alias("bi"), F.lit(1).alias("bj"))
    return _compared(rows, percent)


def _pairs(found: DataFrame, *group: str) -> DataFrame:
    """For each group the pairs of what isn't in its largest component with all of it."""
    sizes = found.groupBy(*group, "component").agg(F.count("*").alias("c")).groupBy(*group)
    return sizes.agg((F.sum("c") * (F.sum("c") - F.max("c"))).cast("double").alias("pairs"))


def _by_bucket(wide: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links inside the buckets whose members ``links`` doesn't join yet."""
    found = wide.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    found = materialise(found.select("id", "hood", "n", "component", _smallest().alias("met"), F.explode("buckets.band").alias("band")), "found")
    apart = found.groupBy("band").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members"),
        F.min("id").alias("least"), F.max_by("met", "id").alias("met"),
    )
    # the pair of two members has been compared if no other bucket gave the greater one a smaller class to meet
    compared = (F.col("c") == 2) & (F.col("met") == F.col("least"))
    apart = apart.where((F.col("x") != F.col("y")) & ~compared).groupBy("c", "members").agg(F.min("band").alias("band"))
    found = materialise(found.join(apart.select("band"), "band"), "apart")

    # buckets of a neighbourhood become one where that makes no more pairs
    united = found.select("hood", "id", "n", "component").distinct()
    each = _pairs(found, "hood", "band").groupBy("hood").agg(F.sum("pairs").alias("each"))
    fewer = materialise(_pairs(united, "hood").join(each, "hood").where(F.col("pairs") <= F.col("each")).select("hood"), "united")
    single = found.join(fewer, "hood", "left_anti").select(F.struct("hood", "band").alias("g"), "id", "n", "component")
    united = united.join(fewer, "hood").select(F.struct("hood", F.lit(None).cast("long").alias("band")).alias("g"), "id", "n", "component")
    found = materialise(single.unionByName(united), "compared")

    largest = found.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("component", F.struct("c", "component")).alias("most"))
    found = found.join(largest, "g").select("id", "g", "n", (F.col("component") == F.col("most")).alias("main"))
    sized = found.groupBy("g").agg(_blocks(F.when(~F.col("main"), F.col("n")), PAIR_SETS).alias("rest"), _blocks(F.when(F.col("main"), F.col("n")), PAIR_SETS).alias("mains"))
    found = found.join(sized, "g").withColumn("block", F.when(F.col("main"), F.col("rest") + _block("mains")).otherwise(_block("rest")))
    others = F.sequence(F.lit(0), F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    # a set meets its class once, then it goes to its blocks
    placed = found.groupBy("id").agg(F.collect_list(F.struct("g", "block", others.alias("others"))).alias("places"))
    placed = placed.join(sets.select("id", "shingles"), "id").select("id", "shingles", F.explode("places").alias("p"))
    rows = placed.select("id", "shingles", "p.block", "p.g", F.explode("p.others").alias("other"))
    rows = rows.select("id", "shingles", "block", F.lit(0).alias("hood"), "g", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    return _compared(rows, percent)


def near_duplicates(docs: DataFrame, *, percent: int = 80, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Links documents with 100 * |A and B| >= percent * |A or B| over their sets of ``size``-word shingles;
    component_id is the smallest key reachable, kept tells whether that is the row's own. Null, empty and blank texts
    have an empty set and link with nothing. A row without key links with nothing, has no component and is kept.
    Rows that repeat a key are each judged by their own text. Keys may be of any type that has an order. Other columns
    are ignored.
    """
    bounded_batches(docs)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    with Scratch(docs.sparkSession) as scratch:
        sketched = scratch.result(own.withColumn("s", _sketches(size, band_rows(percent / 100))("t")).select("id", "s.*"), "sketches")
        usable = sketched.where(F.col("id").isNotNull() & (F.col("n") > 0))
        classes = usable.groupBy("f1", "f2", "n").agg(F.min("id").alias("key"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
        # numbers in place of keys
        classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        linked = connected_components(_links(own, classes, percent, size))
        least = linked.join(classes.select("id", "key"), "id").groupBy("component").agg(F.min("key").alias("least"))
        linked = linked.join(least, "component").select("id", "least")
        merged = classes.select("f1", "f2", "n", "id", "key", "copies").join(linked, "id", "left")
        merged = merged.where((F.col("copies") > 1) | F.col("least").isNotNull()).select("f1", "f2", "n", F.coalesce("least", "key").alias("component_id"))
        merged = scratch.result(merged, "merged")
    return (
        sketched.select("id", "n", "f1", "f2")
        .join(merged, ["f1", "f2", "n"], "left")
        .select(
            F.col("id").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("component_id")))
    )


def _links(own: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between classes: enough of those that hold to join all that links join."""
    banded = classes.select("id", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where(F.col("a") < F.col("z")).select("band", "a")
    buckets = banded.join(crowded, "band")
    hoods = connected_components(buckets.where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))).withColumnRenamed("component", "hood")

    members = materialise(hoods.join(classes.select("id", "key", "n", "f1", "f2"), "id"), "members")
    wide = members.groupBy("hood").agg(_blocks("n").alias("blocks"))
    weight = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = members.join(wide, "hood").select("id", "hood", "n", "blocks", F.col("key").alias("k"), F.col("f1").alias("c1"), F.col("f2").alias("c2"))
    # the same plan at every size: texts meet their places by key, never by a broadcast of a list that grows
    text_of = own.where(F.col("t").isNotNull()).withColumnRenamed("id", "k").join(placed.hint("merge"), "k")
    with_sets = text_of.select("id", "hood", "n", "blocks", "c1", "c2", _sets(size)("t").alias("s"))
    # of rows that repeat a key, those with the class's own text
    with_sets = with_sets.where((F.col("s.f1") == F.col("c1")) & (F.col("s.f2") == F.col("c2"))).dropDuplicates(["id"])
    with_sets = materialise(with_sets.select("id", "hood", "n", "blocks", "s.shingles"), "sets")

    # neighbourhoods of one block, several to a group
    single = with_sets.where(F.col("blocks") == 1).select("id", "hood", "shingles", F.lit(0).alias("block"), F.lit(-1).alias("bi"), F.lit(-1).alias("bj"), F.pmod(F.xxhash64("hood"), F.lit(1 + weight // BLOCK_SHINGLES)).alias("g"))
    links = _compared(single, percent)
    if wide.where(F.col("blocks") > 1).isEmpty():
        return links
    several = materialise(with_sets.where(F.col("blocks") > 1), "wide-sets")
    # a row for each class, so that joins by class don't multiply with its buckets
    grouped = buckets.groupBy("id").agg(F.collect_list(F.struct("band", "a")).alias("buckets"))
    wide_classes = materialise(several.select("id", "hood", "n").join(grouped, "id"), "buckets")
    first = materialise(_by_smallest(wide_classes, several, percent), "links")
    return links.unionByName(first).unionByName(_by_bucket(wide_classes, several, first, percent))
