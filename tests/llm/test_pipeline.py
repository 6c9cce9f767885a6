"""The corpus pipeline against its stages written out plainly, and the registered queries."""

import json
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from rangeloom.llm import decontam, langid, minhash, pii  # noqa: E402
from rangeloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer  # noqa: E402

from .test_dedup import contaminated, near  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plainly(docs, bench):
    """Rows (doc_id, text) that the stages keep, in plain Python; the language stage drops texts without letters."""
    import sentencepiece

    held = [(k, t) for k, t in docs if t is not None and any(map(str.isalpha, t))]
    label = near(held, 80)
    held = [(k, t) for k, t in held if label[k][2]]
    hit = {r[0] for r in contaminated(held, bench) if r[5]}
    held = [(k, pii.redacted(t, pii.find(t))) for k, t in held if k not in hit]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    return {k: (t, len(t), library.encode(t)) for k, t in held}


def test_pipeline_equals_its_stages_written_out(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.piece_ids) for r in got} == plainly(docs, bench)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got) and len(got) < len(docs)


def test_stages_on_odd_documents(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [
        (1, "first text with some words in it for all of us", "en", "a", 5), (1, "first text with some words in it for all of us", "en", "a", 5), (2, "first text with some words in it for all of us", "en", "a", 5),
        (3, None, "en", None, None), (4, "12345 --- 678", None, "b", 1), (None, "a text without an id but a mail: joe@example.com", "en", None, None), (5, f"before {item.upper()} behind", "en", "b", 7), (None, item, "en", "b", 2),
        (6, "short", "en", "c", 3), (7, "word " * 50_000, "en", "c", 250_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__extra", F.lit(1)).withColumn("kept", F.lit("clash")).withColumn("h", F.lit(2)).withColumn("n_pieces", F.lit("clash")).withColumn("language", F.lit("clash")).withColumn("pieces", F.lit("clash"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text[:60], r.n_chars) for r in got) == [
        (0, "a text without an id but a mail: <EMAIL>", 40), (1, "first text with some words in it for all of us", 46), (6, "short", 5), (7, ("word " * 12)[:60], 250_000)
    ]
    empty = tmp_path / "empty"
    df.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_near_duplicates_of_wide_neighbourhoods(spark, monkeypatch):
    """Texts in threes: a base, one linked with it, and one that shares some of its buckets only."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        base = [f"w{k}-{i}" for i in range(100)]
        at = rng.sample(range(6, 94, 6), 6)
        rows += [(3 * k + i, " ".join(f"x{i}" if j in where else w for j, w in enumerate(base))) for i, where in enumerate(([], at[:2], at[2:]))]
    rng.shuffle(rows)
    label = near(rows, 80)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 1)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if label[i][2]}


def test_decontamination_joins_texts_without_a_shuffle(spark, monkeypatch):
    """Whatever Spark itself would broadcast; and by a shuffle, with equal rows, where the hits aren't counted to be few."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain = corpus_pipeline.decontamination(spark, docs, SMALL)
        assert "SortMergeJoin" not in plain._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
        shuffled = corpus_pipeline.decontamination(spark, docs, SMALL)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id for r in plain.collect()}
        assert got == {r.doc_id for r in shuffled.collect()} and len(got) < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]


def test_language_stage_keeps_text_of_any_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = langid.learn_sample(docs)
    gone = langid.identify(docs, samples).where(~F.col("language.evidence")).select("text").collect()
    assert not any(any(map(str.isalpha, r.text or "")) for r in gone)
    other = spark.createDataFrame([(1, "汉语文本 a"), (2, "mostly known 汉"), (3, "a"), (4, "1 b 2")], "doc_id long, text string")
    assert [r.doc_id for r in langid.identify(other, samples).where("language.evidence").orderBy("doc_id").collect()] == [2, 3, 4]
    unlabelled = other.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, SMALL).count() == 4
    assert json.dumps(samples) == json.dumps(langid.learn_sample(docs.repartition(7)))


def test_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)
