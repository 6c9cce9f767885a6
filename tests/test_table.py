import random
import threading

import pytest
from pyspark.sql import functions as F

from rangeloom.errors import ClosedError, ConflictError, DuplicateKeyError, FinishedError, KeyedTableError, KeyTooLongError, NullKeyError, SchemaError
from rangeloom.functions import changes
from rangeloom.streaming.sink import upsert_stream
from rangeloom.table import KeyedTable, Options


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def make(spark, path, n=0, **options):
    t = KeyedTable.create(spark, path, "k int, v string", "k", Options(**options))
    if n:
        t.load(spark.range(n).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v")))
    return t


def content(t):
    return {r.k: r.v for r in t.scan().collect()}


def test_empty_table(spark, path):
    t = make(spark, path)
    assert len(t) == 0 and t.scan().collect() == [] and t.first().collect() == [] and t.count_range(0, 9) == 0 and t.validate().is_valid
    assert t.put(1, "a") is True and t.put(1, "b") is False and content(t) == {1: "b"} and t[1].v == "b" and 1 in t and 2 not in t
    with pytest.raises(KeyError):
        t[5]


def test_reopen_and_versions(spark, path):
    t = make(spark, path, 10)
    t.put_range({3: "x", 20: "y"})
    again = KeyedTable.open(spark, path)
    assert content(again) == content(t) and len(again) == 11 and again.key == ["k"]
    assert again.view(1).count() == 10 and again.try_get(3).v == "x" and again.view(1).try_get(3).v == "v3"
    assert {r.k: r.change for r in again.diff(1, 2).collect()} == {3: "update", 20: "insert"}
    assert [h["what"] for h in again.history()] == ["create", "load", "put"]
    with pytest.raises(KeyedTableError):
        make(spark, path)
    with pytest.raises(KeyedTableError):
        KeyedTable.open(spark, path + "-none")


def test_every_write(spark, path):
    t = make(spark, path, 5)
    r = t.put_range([(1, "a"), (1, "b"), (9, "c")])
    assert (r.inserted, r.updated) == (1, 1) and content(t)[1] == "b"
    r = t.try_insert([(1, "no"), (7, "first"), (7, "second")])
    assert (r.inserted, r.unchanged) == (1, 1) and content(t)[7] == "first"
    assert {x.k: x.v for x in t.get_or_add([(1, "no"), (8, "eight")]).outcome.collect()} == {1: "b", 8: "eight"}
    assert t.try_update([(2, "two"), (50, "no")]).updated == 1
    t.update_with([2, 50], lambda old: {"v": F.upper(old["v"])})
    assert content(t)[2] == "TWO" and 50 not in content(t)
    t.add_or_update([(3, "+"), (60, "new")], lambda old, new: {"v": F.concat(old["v"], new["v"])})
    assert content(t)[3] == "v3+" and content(t)[60] == "new"
    r = t.pop([60, 61])
    assert r.deleted == 1 and [x.old.v for x in r.outcome.where("existed").collect()] == ["new"]
    swap = spark.createDataFrame([(3, "swapped", "v3+"), (4, "no", "wrong")], "k int, v string, was string")
    assert t.compare_and_swap(swap, expected={"v": "was"}).updated == 1
    assert t.delete_range(0, 1) == 2 and t.delete_range(5, 0) == 0
    assert content(t) == {2: "TWO", 3: "swapped", 4: "v4", 7: "first", 8: "eight", 9: "c"} and t.validate().is_valid
    before = t.statistics().version
    assert t.delete([1000]).deleted == 0 and t.statistics().version == before and t.put_range([]).version == before


def test_bad_batches(spark, path):
    t = make(spark, path, max_key_bytes=0)
    with pytest.raises(NullKeyError):
        t.put_range(spark.createDataFrame([(None, "a")], "k int, v string"))
    with pytest.raises(SchemaError):
        t.put_range(spark.createDataFrame([(1, 2)], "k int, w int"))
    with pytest.raises(SchemaError):
        t.put_range(spark.createDataFrame([("1", "2")], "k string, v string"))
    with pytest.raises(DuplicateKeyError):
        t.add_or_update([(1, "a"), (1, "b")], lambda old, new: new)
    with pytest.raises(Exception):  # noqa: B017
        t.put_range(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("v", F.raise_error(F.lit("broken"))))
    assert len(t) == 0 and t.statistics().version == 0
    s = KeyedTable.create(spark, path + "s", "k string, v int", "k", Options(max_key_bytes=4))
    with pytest.raises(KeyTooLongError):
        s.put_range([("ééé", 1)])
    assert s.put("éé", 1)
    for schema, key in (("k double, v int", "k"), ("k int", "z"), ("k int, op int", "k")):
        with pytest.raises(SchemaError):
            KeyedTable.create(spark, path + "x", schema, key)
    with pytest.raises(ValueError):
        KeyedTable.create(spark, path + "y", "k int", "k", Options(retries=-1))


def test_snapshot_survives_compaction(spark, path):
    t = make(spark, path, 100)
    with t.snapshot() as s:
        t.delete_range(0, 69)
        t.put(500, "new")
        assert t.compact().files_removed > 0
        assert s.count() == 100 and s.try_get(5).v == "v5" and [r.k for r in s.last().collect()] == [99]
        assert t.statistics().open_snapshots == 1
    assert len(t) == 31 and t.validate().is_valid
    with pytest.raises(ClosedError):
        s.scan().collect()


def test_reads_equal_before_and_after_compaction(spark, path):
    t = make(spark, path, 1000)
    t.delete(spark.range(1000).where("id % 10 < 7").select(F.col("id").cast("int").alias("k")))
    t.put_range([(5, "five"), (5000, "far")])

    def reads():
        return content(t), len(t), t.count_range(100, 300), [r.k for r in t.top(4).collect()], [r.k for r in t.latest(4).collect()], [r.k for r in t.next_after(100).collect()], [r.k for r in t]

    a = reads()
    seen = []
    folded = t.checkpoint()
    assert t.statistics().delta_files == 0 and t.statistics().version == folded and reads() == a and t.validate().is_valid
    t2 = KeyedTable.open(spark, path, Options(on_compaction_started=lambda: seen.append("start"), on_compaction_completed=lambda r: seen.append(r.version)))
    result = t2.compact()
    assert seen == ["start", result.version] and reads() == a and t.validate().is_valid


def test_folding_by_number_of_deltas(spark, path):
    t = make(spark, path, 10, fold_after=3)
    for i in range(4):
        t.put(i, f"n{i}")
    assert t.statistics().delta_files <= 2 and content(t)[3] == "n3" and t.validate().is_valid


def test_transaction_reads_its_own_writes(spark, path):
    t = make(spark, path, 10)
    with t.transaction() as tx:
        tx.insert(100, "x")
        tx.insert_range([(1, "one"), (101, "y")])
        assert tx.delete_range(5, 100) == 6 and len(tx) == 6 and tx.try_get(100) is None and tx[1].v == "one" and len(t) == 10
        assert [r.k for r in tx.latest(2).collect()] == [101, 4]
        tx.commit()
        with pytest.raises(FinishedError):
            tx.commit()
        with pytest.raises(FinishedError):
            tx.insert(1, "z")
    assert len(t) == 6 and t.validate().is_valid and t.statistics().open_transactions == 0


def test_rollback_and_conflict(spark, path):
    t = make(spark, path, 10)
    with t.transaction() as tx:
        tx.delete_range(0, 9)
    assert len(t) == 10
    a, b = t.transaction(), t.transaction()
    a.insert(1, "a")
    b.insert(9, "b")
    a.commit()
    with pytest.raises(ConflictError) as e:
        b.commit()
    assert e.value.winner == a._start.number + 1 and content(t)[9] == "v9"
    c = t.transaction()
    assert c.try_get(1).v == "a"
    t.put(1, "later")
    assert c.try_get(1).v == "a" and c.commit() < t.statistics().version  # read only
    d = t.transaction(serializable=True)
    d.count_range(0, 3)
    t.put(2, "touched")
    with pytest.raises(ConflictError):
        d.commit()
    e2 = t.transaction(serializable=True)
    e2.count_range(0, 1)
    t.put(8, "elsewhere")
    e2.commit()


def test_async_commit_and_scope(spark, path):
    t = make(spark, path, 3)
    tx = t.transaction()
    tx.insert(50, "later")
    assert tx.commit_async().result(60) == t.statistics().version and 50 in t
    with t.scope() as s:
        s.try_delete([50])
        s.complete()
    with t.scope() as s:
        s.try_delete([0])
    with pytest.raises(RuntimeError), t.scope() as s:
        s.try_delete([1])
        s.complete()
        raise RuntimeError
    with pytest.raises(AttributeError):
        t.scope().commit()
    assert set(content(t)) == {0, 1, 2}


def test_concurrent_counters_lose_nothing(spark, path):
    t = KeyedTable.create(spark, path, "k int, v int", "k", Options(retries=50))
    t.put(1, 0)

    def work():
        mine = KeyedTable.open(spark, path, Options(retries=50))
        for _ in range(3):
            mine.update_with([1], changes.increment("v"))

    threads = [threading.Thread(target=work) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert t[1].v == 9


def test_unfinished_writes_are_ignored(spark, path):
    t = make(spark, path, 100)
    tx = t.transaction()
    tx.insert_range([(k, "lost") for k in range(200, 250)])  # staged files, no log entry: as if killed here
    again = KeyedTable.open(spark, path)
    assert len(again) == 100 and again.validate().is_valid
    assert again.vacuum()[0] == 0  # it may be at work still
    assert KeyedTable.open(spark, path, Options(lease_seconds=0)).vacuum()[0] > 0 and len(again) == 100
    (t._store.files).create("_log/junk.tmp", "{")
    assert len(KeyedTable.open(spark, path)) == 100


def test_validation_finds_damage(spark, path):
    t = make(spark, path, 50)
    f = t._store.manifest.latest().base[0]
    t._store._read([f]).where("k <> 3").write.mode("overwrite").parquet(path + "-tmp")
    good = spark.read.parquet(path + "-tmp").collect()
    t._store.files.delete(f.path)
    import os
    import shutil

    part = next(x for x in os.listdir(path + "-tmp") if x.endswith(".parquet"))
    shutil.copy(f"{path}-tmp/{part}", f"{path}/{f.path}")
    result = t.validate()
    assert good and not result.is_valid and result.error


def test_closed(spark, path):
    t = make(spark, path, 3)
    t.close()
    t.close()
    for call in (t.flush, lambda: t.scan(), t.compact, t.transaction, t.snapshot, lambda: t.put(1, "x"), lambda: t[1], lambda: len(t)):
        with pytest.raises(ClosedError):
            call()


def test_large_values_and_odd_keys(spark, path):
    t = KeyedTable.create(spark, path, "k string, b binary", "k")
    big = {"": b"", "🌳": b"\x01\x02\x03\xff" * 50_000, "￿": None, "a": b"z" * 1_000_000}
    t.put_range(big)
    with t.snapshot() as s:
        t.put("a", b"small")
        assert bytes(s["a"].b) == big["a"]
        t.compact()
        assert bytes(s["a"].b) == big["a"] and bytes(t["🌳"].b) == big["🌳"] and t["￿"].b is None
    assert [r.k for r in t.keys().collect()] == ["", "a", "￿", "🌳"]


def test_composite_key(spark, path):
    t = KeyedTable.create(spark, path, "a int, b string, v int", ["a", "b"])
    t.put_range([(i // 3, "xyz"[i % 3], i) for i in range(30)])
    assert t.count_range((2, "y"), (4, "x")) == 6 and t.count_range((2,), (2,)) == 3 and t[(3, "z")].v == 11
    assert t.delete_range((0, "x"), (8, "z")) == 27 and [r.v for r in t.scan().collect()] == [27, 28, 29] and t.validate().is_valid


def test_pruning_reads_few_files(spark, path):
    t = KeyedTable.create(spark, path, "k int, v string", "k", Options(file_rows=100))
    t.load(spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v")))
    assert t.statistics().base_files >= 20
    assert len(t.scan(150, 160).inputFiles()) == 1 and len(t.get(5000).inputFiles()) == 0 and len(t.top(5).inputFiles()) == 1
    assert t.count_range(0, 1999) == 2000


def test_random_operations_equal_a_dict(spark, path):
    rng = random.Random(11)
    t = make(spark, path, fold_after=6)
    want = {}
    for step in range(30):
        batch = {rng.randrange(64): f"{step}-{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))}
        what = rng.random()
        if what < 0.55:
            t.put_range(batch)
            want.update(batch)
        elif what < 0.7:
            t.try_insert(list(batch.items()))
            want = {**batch, **want}
        elif what < 0.85:
            t.delete(list(batch))
            want = {k: v for k, v in want.items() if k not in batch}
        else:
            a = rng.randrange(64)
            assert t.delete_range(a, a + 6) == sum(a <= k <= a + 6 for k in want)
            want = {k: v for k, v in want.items() if not a <= k <= a + 6}
        assert len(t) == len(want)
        if step % 6 == 5:
            assert content(t) == want
    assert content(t) == want and t.validate().is_valid


def test_stream_sink_applies_a_batch_once(spark, path, tmp_path):
    t = KeyedTable.create(spark, path, "k int, v int", "k")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 1), (1, 5, 2), (2, 2, 1)], "k int, v int, o int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k int, v int, o int").parquet(src)
    for _ in range(2):
        upsert_stream(stream, t, name="s", checkpoint=str(tmp_path / "cp"), order="o").awaitTermination(60)
    assert {r.k: r.v for r in t.scan().collect()} == {1: 5, 2: 2}
    version = t.statistics().version
    t.put_range([(1, 0)], batch_id=("s", 0))  # a batch that was applied before
    assert t.statistics().version == version and t[1].v == 5


def test_files_in_and_out(spark, path, tmp_path):
    from rangeloom.sources.external import export, table_from_files

    spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string").write.csv(str(tmp_path / "csv"))
    t = table_from_files(spark, path, str(tmp_path / "csv"), key="k", format="csv", schema="k int, v string")
    assert content(t) == {1: "a", 2: None, 3: "c"}
    export(t.view(), str(tmp_path / "json"), format="json")
    assert spark.read.schema("k int, v string").json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError):
        table_from_files(spark, path + "2", str(tmp_path / "csv"), key="k", format="csv")


def test_load_of_unique_rows(spark, path):
    t = KeyedTable.create(spark, path, "k int, v string", "k")
    assert t.load(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), unique=True) == 2 and t.validate().is_valid
    u = KeyedTable.create(spark, path + "2", "k int, v string", "k")
    u.load(spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string"), unique=True)
    assert not u.validate().is_valid


def test_small_writes_look_at_few_files(spark, path):
    t = KeyedTable.create(spark, path, "k int, v string", "k", Options(file_rows=100))
    t.load(spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v")))
    batch = spark.createDataFrame([(150, "x"), (160, "y")], "k int, v string")
    met = t._met(t.view().version, batch)
    assert len(met.inputFiles()) == 1 and met.count() == 2
    t.put_range(batch)
    assert t[150].v == "x" and len(t) == 2000
    t.checkpoint()
    assert t.statistics().base_files >= 20 and t.validate().is_valid and t.count_range(0, 1999) == 2000


def test_vacuum_and_compaction_beside_a_writer(spark, path):
    t = make(spark, path, 1000)
    a, b = KeyedTable.open(spark, path), KeyedTable.open(spark, path)
    with a.transaction() as tx:
        tx.insert(5000, "staged")
        assert b.vacuum()[0] == 0
        tx.commit()
    assert len(t) == 1001 and content(t)[5000] == "staged" and t._store.files.names("_staged") == []
    # a put while a compaction runs is kept, without another rewrite
    c = KeyedTable.open(spark, path, Options(on_compaction_started=lambda: (a.put(7, "meanwhile"), a.delete([8]), a.put(6000, "new"))))
    c.compact()
    assert content(t)[7] == "meanwhile" and content(t)[6000] == "new" and 8 not in t and len(t) == 1001 and t.validate().is_valid
    assert t.history()[-1]["what"] == "compact" and t.statistics().delta_rows == 3
    # two at once: the second finds its files replaced
    d = KeyedTable.open(spark, path, Options(on_compaction_started=lambda: a.compact()))
    with pytest.raises(ConflictError):
        d.compact()
    assert t.validate().is_valid


def test_commit_of_lost_files_fails(spark, path):
    t = make(spark, path, 10)
    tx = t.transaction()
    tx.insert(50, "x")
    KeyedTable.open(spark, path, Options(lease_seconds=0)).vacuum()
    with pytest.raises(KeyedTableError):
        tx.commit()
    assert len(t) == 10 and t.validate().is_valid


def test_leases_end(spark, path):
    t = make(spark, path, 10)
    t.snapshot()  # never closed
    t.delete_range(0, 4)
    assert t.compact().files_removed == 1  # the delta's; the base file is under the lease
    late = KeyedTable.open(spark, path, Options(lease_seconds=0))
    assert late.vacuum()[0] >= 1 and len(late) == 5 and late.validate().is_valid


def test_folds_and_reads_go_by_the_files_spans(spark, path):
    t = KeyedTable.create(spark, path, "k int, v string", "k", Options(file_rows=250, ranges=4))
    t.load(spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v")))
    files = {f.path for f in t.view().version.base}
    probes = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    assert len(files) >= 8
    assert len(t.page(5, after=1300).inputFiles()) <= 2 and len(t.page(5, before=1300, reverse=True).inputFiles()) <= 2
    assert [r.k for r in t.page(3, after=1300).collect()] == [1301, 1302, 1303] and [r.k for r in t.page(2, before=250, reverse=True).collect()] == [249, 248]
    assert len(t.next_after(10).inputFiles()) <= 2 and [r.k for r in t.next_after(1998).collect()] == [1999] and t.next_after(1999).collect() == []
    assert len(t.multi_get(probes(1500)).inputFiles()) == 1 and len(t.present(probes(3, 1999)).inputFiles()) == 2 and t.absent(probes(3, 5000)).collect()[0].k == 5000
    t.put(3, "low")
    t.put(1997, "high")
    t.checkpoint()
    kept = files & {f.path for f in t.view().version.base}
    assert len(kept) == len(files) - 2 and t.statistics().delta_files == 0 and t.validate().is_valid and len(t) == 2000
    # one batch that spans the table folds all; keys beyond the files make files of their own
    t.put_range({-5: "a", 9000: "b"})
    t.put(700, "c")
    t.checkpoint()
    assert t.validate().is_valid and len(t) == 2002 and [r.k for r in t.top(2).collect()] == [-5, 0] and [r.k for r in t.latest(2).collect()] == [9000, 1999]


def test_large_tables_are_folded_behind_the_write(spark, path):
    t = make(spark, path, 100, fold_after=2, fold_bytes=1)
    for i in range(3):
        t.put(i, f"n{i}")
    t._folding.result(120)
    assert content(t)[2] == "n2" and len(t.view().version.deltas) <= 2 and t.validate().is_valid
