"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

1. The index: the postings (term, text, position) of all training tokens that are words of some benchmark item, stored
   once as a table. The frequencies of the terms come from it.
2. Items are cut into windows, and windows that start within UNIT window lengths share a unit. Texts are cut
   into cells: 2 * ``window`` words, a cell every ``window`` words, so that every occurrence of a window lies in a cell.
3. From the rarest: if a cell holds at least r of the d different terms of a window, it holds at least two of the
   window's d - r + 2 rarest ones. So only the postings of these are met with the units, and a pair of unit and cell
   stays if two different terms meet there.
4. For the pairs that stay, the postings of all terms of the unit in the cell are read. Each is shifted by the term's
   place in the item; equal shifts are an alignment, and the places that it holds are the intersection of the shifted
   lists. Places without a gap over a whole window are exact phrases. A cell without one that holds enough of a
   window's terms, in any order, is a proximity match.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise

#: Characters between words in texts that aren't lower-cased yet: ASCII but for letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ENDS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
#: A table is broadcast if its rows, of ROW_BYTES and their strings' bytes each, were counted to take no more.
BROADCAST_BYTES, ROW_BYTES = 96 << 20, 128
#: Otherwise the rows of a frequent term are dealt to so many tasks.
SALTS = 32
#: The windows of a unit start within so many window lengths.
UNIT = 4


def words_of(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(ENDS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BETWEEN))


def ascii_lower(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def fits(df: DataFrame, *strings: str) -> bool:
    """Whether a materialised table may be broadcast: by its rows and the bytes of its ``strings``."""
    size = F.lit(ROW_BYTES).cast("long")
    for c in strings:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES


def meet(postings: DataFrame, small: DataFrame, on: str, *strings: str) -> DataFrame:
    """Postings joined with a materialised table by a term: a broadcast where that is small, else with hot terms dealt out."""
    if fits(small, *strings):
        return postings.join(F.broadcast(small), on)
    dealt = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)).cast("int")).join(dealt, [on, "salt"]).drop("salt")


def _bounded(df: DataFrame, *strings: str) -> DataFrame:
    """A materialised table, with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if fits(df, *strings) else df


def positional_index(docs: DataFrame, terms: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings (tid, k, h, pos) of the ``terms`` (low, word, tid; materialised) in all texts: k the key, h a hash of the text."""
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    tokens = texts.select("k", F.xxhash64("t").alias("h"), F.posexplode(words_of(F.col("t"))).alias("pos", "raw")).withColumn("low", F.lower("raw"))
    # equal ASCII lower cases have one Unicode lower case; the other way round it holds for ASCII words
    plain = (F.octet_length("raw") == F.length("raw")) & (F.col("low") == F.col("word"))
    same = (F.col("raw") == F.col("word")) | plain | (ascii_lower(F.col("raw")) == F.col("word"))
    return meet(tokens, terms, "low", "low", "word").where(same).select("tid", "k", "h", "pos")


def matches(
    docs: DataFrame, items: DataFrame, *, window: int = 10, near: float | None = 0.9, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per match: key, h (hash of the text), item, lo, hi (word positions, from 0, hi included), exact.

    An exact match is an occurrence of a window of ``window`` words (of the whole item, if that is shorter). Others are
    cells (words from a multiple of ``window`` on, 2 * ``window`` of them) without an exact match of the item that hold
    at least the share ``near`` of the different words of one of its windows; with ``near`` None there are none.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        held = items.select(F.col(item_key).cast("string").alias("item"), F.transform(words_of(F.col(item_text)), ascii_lower).alias("iw")).where(F.size("iw") > 0)
        held = materialise(held.distinct().withColumn("iid", F.monotonically_increasing_id()), "items")
        placed = held.select("iid", F.posexplode("iw").alias("q", "word"))
        terms = placed.select("word").distinct().select(F.lower("word").alias("low"), "word", F.monotonically_increasing_id().alias("tid"))
        terms = materialise(terms, "terms")
        index = materialise(positional_index(docs, terms, text=text, key=key), "index")
        counts = index.groupBy("tid").agg(F.count("*").alias("n"))
        placed = materialise(placed.join(terms.select("word", "tid"), "word").join(counts, "tid", "left").select("iid", "q", "tid", F.coalesce("n", F.lit(0)).alias("n")), "places")

        # windows: their unit, and their different terms from the rarest on
        ranks = placed.groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("q", F.struct("n", "tid").alias("t"))))["t"].alias("ts"))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ts") - window))
        windows = ranks.select("iid", "ts", F.explode(starts).alias("s"))
        windows = windows.select("iid", "s", F.floor(F.col("s") / (UNIT * window)).cast("int").alias("seg"), F.sort_array(F.array_distinct(F.slice("ts", F.col("s") + 1, F.lit(window)))).alias("ts"))
        least = F.ceil(F.size("ts") * F.lit(near) - 1e-9).cast("int") if near is not None else F.size("ts")
        windows = windows.withColumn("r", F.greatest(F.lit(1), least)).withColumn("c", F.least("r", F.lit(2)))
        # terms that no text holds can't be among r ones
        windows = windows.where(F.size(F.filter("ts", lambda t: t["n"] == 0)) <= F.size("ts") - F.col("r"))
        windows = materialise(windows, "windows")
        rare = windows.select("iid", "seg", "c", F.explode(F.slice("ts", F.lit(1), F.size("ts") - F.col("r") + F.col("c"))).alias("t"))
        rare = materialise(rare.where(F.col("t.n") > 0).groupBy("iid", "seg", F.col("t.tid").alias("tid")).agg(F.min("c").alias("c")), "rare")

        block = F.floor(F.col("pos") / window).cast("int")
        at = meet(index, rare, "tid").select("k", "h", "iid", "seg", "tid", "c", F.explode(F.sequence(F.greatest(F.lit(0), block - 1), block)).alias("cell"))
        pairs = at.groupBy("k", "h", "iid", "seg", "cell").agg(F.min("tid").alias("a"), F.max("tid").alias("z"), F.min("c").alias("c"))
        pairs = materialise(pairs.where((F.col("a") != F.col("z")) | (F.col("c") == 1)).select("k", "h", "iid", "seg", "cell"), "pairs")

        # all postings of these cells, from the index again
        blocks = pairs.select("k", "h", "iid", "seg", "cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("block"))
        # the same plan at every size: cells grow with the texts, so they meet the index by a shuffle
        blocks = blocks.hint("merge")
        held_by = index.withColumn("block", block).alias("x").join(blocks.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.block") == F.col("y.block")))
        held_by = held_by.select("x.k", "x.h", "y.iid", "y.seg", "y.cell", "x.tid", "x.pos")
        places = windows.select("iid", "seg", F.explode(F.sequence(F.col("s"), F.col("s") + window - 1)).alias("q")).distinct().join(placed.select("iid", "q", "tid"), ["iid", "q"])
        places = materialise(places.groupBy("iid", "seg", "tid").agg(F.collect_list("q").alias("qs")), "unit-places")
        needs = windows.groupBy("iid", "seg").agg(F.min("r").alias("r"))
        cells = held_by.join(_bounded(places), ["iid", "seg", "tid"]).groupBy("k", "h", "iid", "seg", "cell").agg(F.collect_set(F.struct("tid", "pos", "qs")).alias("posts"))
        cells = cells.withColumn("tids", F.array_distinct("posts.tid")).join(_bounded(materialise(needs, "needs")), ["iid", "seg"]).where(F.size("tids") >= F.col("r"))
        cells = materialise(cells.select("k", "h", "iid", "seg", "cell", "posts", "tids"), "cells")

        # places of one shift, and in them the windows that lack none
        length = F.size("iw")
        sizes = materialise(held.select("iid", "item", F.least(length, F.lit(window)).alias("m")), "item-sizes")
        shifted = cells.select("k", "h", "iid", "cell", F.explode("posts").alias("p")).select("k", "h", "iid", "cell", F.col("p.pos").alias("pos"), F.explode("p.qs").alias("q"))
        aligned = shifted.groupBy("k", "h", "iid", "cell", (F.col("pos") - F.col("q")).alias("shift")).agg(F.sort_array(F.collect_set("q")).alias("qs")).join(_bounded(sizes, "item"), "iid").where(F.size("qs") >= F.col("m"))
        whole = F.filter("qs", lambda q, i: F.get("qs", i + F.col("m") - 1) == q + F.col("m") - 1)
        exact = aligned.select("k", "h", "iid", "item", "cell", F.explode(whole).alias("q"), "shift", "m").select("k", "h", "iid", "item", "cell", (F.col("q") + F.col("shift")).alias("lo"), (F.col("q") + F.col("shift") + F.col("m") - 1).alias("hi"))
        exact = materialise(exact, "exact")
        found = exact.select("k", "h", "item", "lo", "hi", F.lit(True).alias("exact")).distinct()
        if near is not None:
            enough = F.size(F.array_intersect("tids", "ts.tid")) >= F.col("r")
            close = cells.select("k", "h", "iid", "seg", "cell", "tids").join(_bounded(windows.select("iid", "seg", "ts", "r")), ["iid", "seg"]).where(enough).select("k", "h", "iid", "cell").distinct()
            known = exact.select("k", "h", "iid", "cell").distinct()
            close = close.alias("x").join(known.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.iid") == F.col("y.iid")) & (F.col("x.cell") == F.col("y.cell")), "left_anti")
            lo = F.col("cell") * window
            found = found.unionByName(close.join(_bounded(sizes, "item"), "iid").select("k", "h", "item", lo.alias("lo"), (lo + 2 * window - 1).alias("hi"), F.lit(False).alias("exact")))
        return scratch.result(found, "matches").withColumnRenamed("k", key)


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = 10, near: float | None = 0.9, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_hit counts words inside any occurrence of a window, n_items the items with occurring windows (an item without
    an id has hits but isn't counted), n_near the proximity matches (see ``matches``). Null texts and items have no
    words and no hits; rows with equal key and text have equal results, also without a key; other columns are ignored.
    """
    found = matches(docs, items, window=window, near=near, text=text, key=key, item_key=item_key, item_text=item_text)
    exact = F.col("exact")
    runs = found.groupBy(F.col(key).alias("fk"), F.col("h").alias("fh")).agg(
        F.sort_array(F.collect_set(F.when(exact, F.struct("lo", "hi")))).alias("runs"),
        F.sort_array(F.collect_set(F.when(exact, F.col("item")))).alias("ids"),
        F.sum(F.when(exact, 0).otherwise(1)).alias("n_near"),
    )
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(F.greatest(s["end"], r["hi"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(s["end"], r["lo"] - 1))).cast("long").alias("n")),
    )["n"]
    runs = runs.select("fk", "fh", covered.alias("hit"), F.size("ids").cast("long").alias("items"), F.array_join("ids", ",").alias("joined"), "n_near")
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(ENDS))
    all_docs = docs.select(F.col(key), F.xxhash64(text).alias("h"), F.when(inner == "", 0).otherwise(F.size(F.split(inner, BETWEEN))).cast("long").alias("n_words"))
    return all_docs.join(runs, F.col(key).eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh")), "left").select(
        key, "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
