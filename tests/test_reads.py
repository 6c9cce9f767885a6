import pytest

from rangeloom.operators import ordering
from rangeloom.operators.reads import ReadView


@pytest.fixture(scope="module")
def ten(spark):
    return ReadView(spark.createDataFrame([(k, k * 10) for k in range(1, 11)], "k int, v int"), "k")


@pytest.fixture(scope="module")
def empty(spark):
    return ReadView(spark.createDataFrame([], "k int, v int"), "k")


def ks(df):
    return [r.k for r in df.collect()]


@pytest.mark.parametrize(("a", "b", "n"), [(1, 10, 10), (3, 7, 5), (5, 5, 1), (2, 8, 7), (50, 60, 0), (7, 3, 0), (None, 4, 4), (9, None, 2), (0, 0, 0)])
def test_count_range(ten, a, b, n):
    assert ten.count_range(a, b) == n
    assert len(ks(ten.scan(a, b))) == n


def test_order(ten):
    assert ks(ten.scan(3, 6)) == [3, 4, 5, 6]
    assert ks(ten.scan_reverse(3, 6)) == [6, 5, 4, 3]
    assert ks(ten.keys()) == list(range(1, 11))
    assert [r.v for r in ten.values().collect()][:2] == [10, 20]
    assert [r.k for r in ten] == list(range(1, 11))


def test_each_goes_through_rows_in_their_tasks(ten):
    import os

    here = os.getpid()
    got = ten.each(lambda rows: ((r.k, r.v, os.getpid()) for r in rows), "k int, v int, pid long").collect()
    assert [(r.k, r.v) for r in got] == [(k, k * 10) for k in range(1, 11)]
    assert here not in {r.pid for r in got}


def test_iterate_sends_no_rows_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from rangeloom.plans import catalog

    def refused(*_, **__):
        raise AssertionError("rows through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    out = catalog.iterate(spark, "/root/testdata/sf0.001")
    got = [r.o_orderkey for r in out.collect()]
    assert got == sorted(got) and len(got) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_lookups(ten, spark):
    assert ten.try_get(3).v == 30 and ten.try_get(99) is None and ten.contains(1) and not ten.contains(0)
    assert ten[4].v == 40
    with pytest.raises(KeyError):
        ten[11]
    got = {r.k: (r.v, r.found) for r in ten.multi_get(spark.createDataFrame([(1,), (77,)], "k int")).collect()}
    assert got == {1: (10, True), 77: (None, False)}


def test_null_value_is_present(spark):
    view = ReadView(spark.createDataFrame([(1, None)], "k int, v int"), "k")
    assert view.multi_get(spark.createDataFrame([(1,)], "k int")).first().found


def test_ends_and_neighbours(ten):
    assert ks(ten.first()) == [1] and ks(ten.last()) == [10]
    assert ks(ten.next_after(3)) == [4] and ks(ten.next_after(0)) == [1] and ks(ten.next_after(10)) == []
    assert ks(ten.prev_before(3)) == [2] and ks(ten.prev_before(1)) == [] and ks(ten.prev_before(99)) == [10]
    assert ks(ten.page(3, after=4)) == [5, 6, 7] and ks(ten.page(2, before=4, reverse=True)) == [3, 2]
    assert ks(ten.top_by("v", 2)) == [10, 9]


def test_empty(empty, spark):
    for df in (empty.scan(), empty.scan_reverse(), empty.first(), empty.last(), empty.next_after(1), empty.prev_before(1), empty.keys(), empty.get(1)):
        assert df.collect() == []
    assert empty.count() == 0 and empty.count_range(1, 2) == 0
    assert ordering.neighbours(empty.rows, "k").collect() == []
    got = ordering.nearest(empty.rows, spark.createDataFrame([(1,)], "p int"), "k", "p").collect()
    assert [(r.p, r.next_key, r.prev_key) for r in got] == [(1, None, None)]


def test_string_order_is_by_code_point(spark):
    view = ReadView(spark.createDataFrame([("￿",), ("🌳",), ("a",), ("",)], "k string"), "k")
    assert ks(view.scan()) == ["", "a", "￿", "🌳"]


def test_distributed_order(spark):
    import bisect
    import random

    rng = random.Random(4)
    keys = sorted(rng.sample(range(10_000), 700))
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(5)
    got = {r.k: (r.next_key, r.prev_key) for r in ordering.neighbours(df, "k").collect()}
    assert got == {k: (keys[i + 1] if i + 1 < len(keys) else None, keys[i - 1] if i else None) for i, k in enumerate(keys)}
    assert {r.k: r.rank for r in ordering.ranked(df, "k", ascending=False).collect()} == {k: len(keys) - i for i, k in enumerate(keys)}
    probes = [rng.randrange(-5, 10_005) for _ in range(300)] + keys[:20]
    asked = ordering.nearest(df, spark.createDataFrame([(p,) for p in probes], "p int"), "k", "p").collect()
    assert len(asked) == len(probes)
    for r in asked:
        i, j = bisect.bisect_right(keys, r.p), bisect.bisect_left(keys, r.p)
        assert r.next_key == (keys[i] if i < len(keys) else None) and r.prev_key == (keys[j - 1] if j else None)


def test_append_keys_as_one_by_one(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.randrange(40)) for i in range(100)]
    for after in (None, 25):
        taken, want = set(), {}
        top = after
        for i, w in sorted(rows, key=lambda r: (r[1], r[0])):
            key = w if top is None else max(w, top + 1)
            top = key
            taken.add(key)
            want[i] = key
        got = {r.i: r.key for r in ordering.append_keys(spark.createDataFrame(rows, "i int, w int"), "w", "i", after=after).collect()}
        assert got == want


def test_append_keys_puts_nulls_last(spark):
    rows = [(1, None), (2, 5), (3, 5), (4, None), (None, 5), (6, 1)]
    got = ordering.append_keys(spark.createDataFrame(rows, "i int, w int"), "w", "i").collect()
    assert sorted((r.key, r.i, r.w) for r in got) == [(1, 6, 1), (5, 2, 5), (6, 3, 5), (7, None, 5), (8, 1, None), (9, 4, None)]


def test_append_bump_is_that_of_its_sql_in_any_time_zone(spark, tmp_path):
    import duckdb

    from rangeloom.plans import catalog

    times = ["2024-01-01 00:09:59.999", "2024-03-31 01:30:00", "2024-07-01 12:00:00", "2024-07-01 12:01:00", "1969-12-31 23:59:59.5", None]
    rows = spark.createDataFrame(list(enumerate(times)), "event_id long, ts string")
    rows.selectExpr("event_id", "cast(ts as timestamp_ntz) ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = sorted(db.execute(catalog.SQL["append_bump"]).fetchall())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Europe/London", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert sorted(map(tuple, catalog.append_bump(spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
