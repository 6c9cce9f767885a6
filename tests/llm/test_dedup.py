"""Near-duplicates, components, embeddings, decontamination and licences against brute force on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import components, decontam, licenses, minhash, vectors
from rangeloom.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("local", [3, 100_000])
@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, monkeypatch, kind, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(7)
    n = 400
    links = {"chain": [(i, i + 1) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)], "star": [(n - 1, i) for i in range(0, n, 2)], "none": []}[kind]
    df = spark.createDataFrame(links + links[:5] + [(b, a) for a, b in links[:5]], "a long, b long")
    want = closure(range(n + 1), links)
    used = {x for a, b in links if a != b for x in (a, b)}
    assert {r.id: r.component for r in connected_components(df).collect()} == {i: want[i] for i in used}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows, percent):
    sets = {k: shingles(t) for k, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = closure(ids, links)
    return {k: (len(sets[k]), label[k], label[k] == k) for k in ids}


def family(rng, n, words, edits):
    base = [f"W{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    texts = [t for _ in range(12) for t in family(rng, 9, 120, 5)] + family(rng, 150, 90, 6) + ["a b c", "A B  c", "a b c d", "", None, " \n", "é É", "É é", "one two three four five", "one two three four five"]
    texts += [" ".join(f"w{i}" for i in range(40_000)), " ".join(f"w{i}" for i in range(41_000))]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).withColumn("bands", F.lit(2))
    want = near(rows, 85)
    assert sum(not v[2] for v in want.values()) > 60
    monkeypatch.setattr(minhash, "BLOCK_SETS", 40)  # the larger family takes several blocks
    monkeypatch.setattr(minhash, "STAR_SETS", 16)
    monkeypatch.setattr(minhash, "PAIR_SETS", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent=85).collect()}
    assert got == want


def test_templated_texts_chain_without_meeting_all(spark, monkeypatch):
    """A chain of texts, each like the next: one wide neighbourhood of several components."""
    rng = random.Random(12)
    words_ = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(160):
        for at in rng.sample(range(100), 1 if k % 7 else 6):
            words_[at] = f"n{k}-{at}"
        rows.append((k, " ".join(words_)))
    rng.shuffle(rows)
    want = near(rows, 80)
    assert 5 < len({v[1] for v in want.values()}) < 150
    for name, value in (("BLOCK_SETS", 12), ("STAR_SETS", 5), ("PAIR_SETS", 7)):
        monkeypatch.setattr(minhash, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == want


def test_a_bucket_of_two_is_compared_beside_others(spark):
    """The greater class of a bucket of two meets a smaller one of another bucket first; its link is in this one only."""
    many = list(range(100))
    sets = spark.createDataFrame([(1, 0, 100, list(range(500, 600))), (2, 0, 100, many), (3, 0, 100, many[1:] + [900])], "id long, hood long, n long, shingles array<long>")
    wide = spark.createDataFrame([(1, 0, 100, [(10, 1)]), (2, 0, 100, [(20, 2)]), (3, 0, 100, [(10, 1), (20, 2)])], "id long, hood long, n long, buckets array<struct<band:long,a:long>>")
    first = minhash.materialise(minhash._by_smallest(wide, sets, 85), "links")
    found = first.unionByName(minhash._by_bucket(wide, sets, first, 85)).collect()
    assert {frozenset((r.a, r.b)) for r in found} == {frozenset((2, 3))}


def test_keys_that_repeat_with_other_texts(spark):
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join([*base[:30], "x", *base[31:]])
    rows = [("k1", one), ("k2", two), ("k1", "an entirely different text that stands under a key of another one"), ("k3", "an entirely different text that stands under a key of another one")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [("k1", 8, "k1", True), ("k1", 56, "k1", True), ("k2", 56, "k1", False), ("k3", 8, "k1", False)]


def test_near_duplicates_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (None, None), (9, None)], kind)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == sorted([(-1, 2, -1, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (-1, 0, -1, True), (9, 0, 9, True)])


def test_shingle_hashes_are_those_of_the_words():
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "\n", "\t\x0b", " ", "word", "🙂"], k=rng.randint(0, 60))) for _ in range(500)]
    seen = {}
    for text, hashed in zip(texts, minhash.shingle_sets(texts), strict=True):
        own = shingles(text)
        assert len(hashed) == len(own)
        assert (minhash.shingle_sets([text])[0] == hashed).all()
        seen[text] = set(hashed.tolist())
    for a, b in zip(texts, texts[1:], strict=False):
        assert len(seen[a] & seen[b]) == len(shingles(a) & shingles(b))
    long = " ".join(f"Word{i % 7777}" for i in range(400_000))
    assert len(minhash.shingle_sets([long])[0]) == len(shingles(long))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    b = np.concatenate((a[:1000], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    got = minhash.bands([np.sort(a), np.sort(b)], 1)
    assert got.shape[1] == 2 * minhash.PERMUTATIONS
    assert abs((got[0] == got[1]).mean() - 1000 / 1400) < 0.12
    for t in (0.8, 0.85, 0.9):
        k = minhash.band_rows(t)
        assert (1 - t**k) ** (2 * minhash.PERMUTATIONS // k) <= minhash.MISS


def brute_vectors(rows, cosine):
    links, count = [], {k: 0 for k, _, _ in rows}
    good = [(k, np.array(v, float), l) for k, v, l in rows if v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for i, (a, x, l) in enumerate(good):
        for b, y, m in good[:i]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    label = closure([k for k, _, _ in rows], links)
    return {k: (count[k], label[k], label[k] == k) for k, _, _ in rows}


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, k = [], 10
    for label in (1, 2, 2, 2):
        for _ in range(40):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((k, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.07)], label))
                k += 1
    centre = rng.normal(size=16)
    for _ in range(150):
        rows.append((k, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.12)], 1))
        k += 1
    same = [float(x) for x in np.float32(centre)]
    rows += [(k + i, same, 1) for i in range(30)] + [(k + 40, [2 * x for x in same], 1), (k + 41, same, None), (k + 42, None, 1), (k + 43, [], 1), (k + 44, [0.0] * 16, 1)]
    rows += [(k + 45, [float("nan")] * 16, 1), (k + 46, [*same[:15], float("inf")], 1), (k + 47, [*same[:15], None], 1), (k + 48, same[:8], 1), (k + 49, [-x for x in same], 1), (k + 50, [x * 1e300 for x in same], 1)]
    want = brute_vectors([r for r in rows if r[0] != k + 50], 0.98)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("v", F.lit(0))
    for name, value in (("BLOCK", 32), ("LIST", 40), ("FIT_ROWS", 200), ("MAX_LISTS", 3), ("CELL", 10), ("ROWS", 7)):
        monkeypatch.setattr(vectors, name, value)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df.where(F.col("vec_id") != k + 50)).collect()}
    assert got == want
    big = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert big[k + 50].n_links >= 30  # a length that overflows when squared


def test_vectors_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(1, None, 1)], kind)).collect()] == [(1, 0, 1, True)]
    got = vectors.near_vectors(spark.createDataFrame([(3, [1.0], 1), (3, [1.0], 1), (2, [2.0], 1), (None, [1.0], 1)], kind)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False)]


def test_index_measures(spark):
    """The probes and the table distances keep every neighbour."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[::2] = x[1::2] + rng.normal(size=(1500, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index(x[:1000], 4, 3)
    own, codes, errors = index.place(x)
    reach = math.sqrt(2 - 2 * 0.98) + 1e-9
    probes = index.probes(x, own, reach)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(i) > 1000 and all(own[b] in probes[a] and own[a] in probes[b] for a, b in zip(i, j, strict=True))
    for c in range(12):
        held = np.flatnonzero(own == c)
        a, b = index.near(x[:400], c, codes[held], errors[held], reach)
        found = set(zip(a.tolist(), held[b].tolist(), strict=True))
        assert all((p, q) in found for p, q in zip(*np.nonzero(x[:400] @ x.T >= 0.98), strict=True) if own[q] == c)


def test_work_of_the_index_follows_the_input(spark):
    """On clustered vectors, what queries meet in the cells they probe grows nearly as the number of vectors."""
    rng = np.random.default_rng(5)
    work, sizes = [], (3000, 12_000, 48_000)
    for n in sizes:
        x = np.repeat(rng.normal(size=(n // 30, 32)), 30, axis=0) + rng.normal(size=(n, 32)) * 0.3
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = vectors.Index(x[rng.permutation(n)[: vectors.FIT_ROWS]], -(-n // vectors.LIST))
        own = index.place(x)[0]
        held = np.bincount(own, minlength=len(index.centres) * len(index.cells))
        asked = rng.permutation(n)[:1000]
        work.append(np.mean([held[p].sum() for p in index.probes(x[asked], own[asked], math.sqrt(2 - 2 * 0.98))]))
    assert work[2] < work[0] * 4, work  # candidates of a query; 16 if all met all
    assert work[2] < 0.1 * sizes[2]


def test_keys_of_other_types(spark):
    rows = [("b", [1.0, 2.0], 1), ("a", [1.0, 2.001], 1), ("c", [2.0, 1.0], 1), (None, [1.0, 2.0], 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in got) == [("", 0, "", True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs, items, n=10, near=0.9):
    windows, kept = {}, {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add((k, tuple(w)))
            kept.setdefault((k, tuple(w)), []).append(set(w[i : i + n]))
    out = []
    for k, t in docs:
        w, hit, found, there = words(t), set(), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= {item for item, _ in got}
                    there |= {(item, c) for item in got for c in (i // n - 1, i // n) if c >= 0 and i + size <= c * n + 2 * n}
        cells = [set(w[c : c + 2 * n]) for c in range(0, len(w), n)]
        close = sum((item, c) not in there and any(len(x & held) >= max(1, math.ceil(near * len(x) - 1e-9)) for x in own) for c, held in enumerate(cells) for item, own in kept.items())
        joined = ",".join(sorted(str(x) for x in found))
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit), close))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    pool = ["the", "of", "É", "é", "İx", "straße", "STRASSE", "K", "K", "x1", *[f"w{i}" for i in range(12)]]
    seps = [" ", ", ", "\n", "-", "_", "—", "."]
    text = lambda n: "".join(rng.choice(pool) + rng.choice(seps) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(50, None), (51, ""), (52, "!!!"), (1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (60, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(150):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1] or ""
            parts += [source[rng.randrange(5) :].upper() if rng.random() < 0.3 else source, text(rng.randrange(15))]
        docs.append((k, rng.choice([" ", ".."]).join(parts)))
    docs += [(900, None), (901, ""), (902, "--"), (903, "w1 " * 5000), (5, docs[5][1])]
    kind = "doc_id long, text string"
    df = spark.createDataFrame(docs, kind).withColumn("h", F.lit(1)).withColumn("w", F.lit("x")).withColumn("n_words", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    want = contaminated(docs, items)
    assert sum(r[5] for r in want) > 40
    assert sum(r[6] for r in want) > 40
    got = decontam.contamination(df, bench)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    only = decontam.contamination(df, bench, near=None).drop("n_near").collect()
    assert sorted((tuple(r) for r in only), key=str) == [r[:6] for r in want]
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)  # everything by shuffle
    assert sorted((tuple(r) for r in decontam.contamination(df, bench).collect()), key=str) == want


def test_decontamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, None), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b c"), (None, "a")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect())
    assert got == [(0, 0, 0, 0), (0, 3, 3, 1), (1, 0, 0, 0)]
    assert {r.n_hit for r in decontam.contamination(docs, items.limit(0)).collect()} == {0}
    assert decontam.contamination(docs.limit(0), items).collect() == []


def test_near_matches(spark):
    item = "red fox jumps over lazy dogs near quiet green river banks"
    docs = spark.createDataFrame([(1, item), (2, "fox red jumps over the lazy dogs near green quiet river banks"), (3, "something else")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near > 0) for r in decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (11, False), 2: (0, True), 3: (0, False)}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""
BSD3 = "\n".join(licenses.SENTENCES[i] for i in (70, 71, 72, 73, 74))


def test_licences(spark):
    rows = [
        (1, "Some text. Released under the MIT License.\nMore."), (2, MIT), (3, BSD3), (4, BSD3.replace(licenses.SENTENCES[73] + "\n", "")), (5, None), (6, ""), (7, "a licence to kill, with permission"),
        (8, "Licensed under CC BY-NC 4.0.\nfoo\nLicensed under the Apache License, Version 2.0."), (9, "x " * 100_000 + "\nSPDX-License-Identifier: GPL-3.0-or-later\n"), (None, "Licensed under CC BY 4.0."), (1, "Some text. Released under the MIT License.\nMore."),
        (10, "\n".join(licenses.SENTENCES[i] for i in (21, 22, 23, 24, 25))), (11, "released UNDER the mit   license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit("clash")).withColumn("sid", F.lit(1)).withColumn("k", F.lit(1))
    got = licenses.licences(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.licenses for r in got} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "", 6: "", 7: "", 8: "Apache-2.0,CC-BY-NC-4.0", 9: "GPL-3.0", None: "CC-BY-4.0", 10: "Apache-2.0", 11: "MIT"}
    assert licenses.licences(df.limit(0)).collect() == []


def test_every_known_sentence_is_found(spark):
    one = spark.createDataFrame([(i, f"Before that.\n{s}\nAnd after.") for i, s in licenses.SENTENCES.items()], "doc_id long, text string")
    assert {r.doc_id: r.sentences for r in licenses.licences(one).collect()} == {i: str(i) for i in licenses.SENTENCES}
    whole = {"\n".join(licenses.SENTENCES[i] for i in r): l for l, r in licenses.RULES}
    got = licenses.licences(spark.createDataFrame([(i, t) for i, t in enumerate(whole)], "doc_id long, text string"))
    assert [r.licenses for r in got.orderBy("doc_id").collect()] == list(whole.values())


def test_licence_tables():
    known = [licenses.normal(s) for s in licenses.SENTENCES.values()]
    assert len(set(known)) == len(known)
    assert all(any(c in s.lower() for c in licenses.CUES) for s in licenses.SENTENCES.values())
    assert {i for _, r in licenses.RULES for i in r} == set(licenses.SENTENCES)
