"""The registered queries of the keyed-table operators, and DuckDB's SQL for the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClosedError, ConflictError, DuplicateKeyError, FinishedError, KeyedTableError, MaintenanceError, NullKeyError, SchemaError
from ..functions.changes import add_given, increment
from ..operators import checks, ordering, writes
from ..operators.reads import ReadView
from ..sources.scratch import shared_folder
from ..table import KeyedTable, Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, key: str | list[str]) -> ReadView:
    return ReadView(table(spark, sf_dir, name), key)


def orders(spark: SparkSession, sf_dir: str) -> ReadView:
    return view(spark, sf_dir, "orders", "o_orderkey")


def _value(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(n,)], "n long")


# --- lookups ---
@query("SELECT * FROM orders WHERE o_orderkey = 100")
def point_get(spark, sf_dir):
    return orders(spark, sf_dir).get(100)


@query("SELECT * FROM orders WHERE o_orderkey = -1")
def point_get_absent(spark, sf_dir):
    return orders(spark, sf_dir).get(-1)


@query("SELECT p.k AS o_orderkey, o.* EXCLUDE (o_orderkey), o.o_orderkey IS NOT NULL AS found FROM (SELECT c_custkey * 7 AS k FROM customer) p LEFT JOIN orders o ON o.o_orderkey = p.k")
def multi_get(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("o_orderkey"))
    return orders(spark, sf_dir).multi_get(probes)


def _probes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13).alias("o_orderkey"))


@query("SELECT c_custkey * 13 AS o_orderkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 13)")
def contains_present(spark, sf_dir):
    return orders(spark, sf_dir).present(_probes(spark, sf_dir))


@query("SELECT c_custkey * 13 AS o_orderkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 13)")
def contains_absent(spark, sf_dir):
    return orders(spark, sf_dir).absent(_probes(spark, sf_dir))


@query("SELECT o_orderkey FROM orders")
def keys(spark, sf_dir):
    return orders(spark, sf_dir).keys()


@query("SELECT * EXCLUDE (o_orderkey) FROM orders")
def values(spark, sf_dir):
    return orders(spark, sf_dir).values()


@query("SELECT * FROM customer")
def items(spark, sf_dir):
    return view(spark, sf_dir, "customer", "c_custkey").items()


# --- scans ---
@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def range_scan(spark, sf_dir):
    return orders(spark, sf_dir).scan(100, 900)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 0 AND 10")
def range_scan_from_zero(spark, sf_dir):
    return orders(spark, sf_dir).scan(0, 10)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN -5 AND 0")
def range_scan_to_zero(spark, sf_dir):
    return orders(spark, sf_dir).scan(-5, 0)


@query("SELECT * FROM orders WHERE o_orderkey >= -5")
def range_scan_default_is_open(spark, sf_dir):
    return ReadView(table(spark, sf_dir, "orders"), "o_orderkey", default_is_unbounded=True).scan(-5, 0)


@query("SELECT * FROM orders WHERE o_orderkey <= 50")
def scan_open_start(spark, sf_dir):
    return orders(spark, sf_dir).scan(end=50)


@query("SELECT * FROM orders WHERE o_orderkey >= 900")
def scan_open_end(spark, sf_dir):
    return orders(spark, sf_dir).scan(900)


@query("SELECT * FROM orders WHERE o_orderkey > 100 AND o_orderkey < 200")
def scan_exclusive(spark, sf_dir):
    return orders(spark, sf_dir).scan(100, 200, start_included=False, end_included=False)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 900 AND 100")
def scan_inverted(spark, sf_dir):
    return orders(spark, sf_dir).scan(900, 100)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def scan_reverse(spark, sf_dir):
    return orders(spark, sf_dir).scan_reverse(100, 300)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def scan_ranked(spark, sf_dir):
    return ordering.ranked(orders(spark, sf_dir).scan_unordered(100, 900).select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS rank FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def scan_reverse_ranked(spark, sf_dir):
    return ordering.ranked(orders(spark, sf_dir).scan_unordered(100, 900).select("o_orderkey"), "o_orderkey", ascending=False)


@query("SELECT * FROM events ORDER BY ts DESC LIMIT 25")
def latest_n(spark, sf_dir):
    return view(spark, sf_dir, "events", "ts").latest(25)


@query("SELECT * FROM events WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 1 HOUR FROM events) AND (SELECT min(ts) + INTERVAL 30 HOUR FROM events)")
def time_window(spark, sf_dir):
    rows = view(spark, sf_dir, "events", "ts")
    began = rows.first().first()["ts"]
    return rows.scan(began + dt.timedelta(hours=1), began + dt.timedelta(hours=30))


@query("SELECT * FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 20")
def page_desc(spark, sf_dir):
    return orders(spark, sf_dir).page(20, before=500, reverse=True)


@query("SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 20")
def page_asc(spark, sf_dir):
    return orders(spark, sf_dir).page(20, after=500)


@query("SELECT * FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 2)) AND (conv_id < 20 OR (conv_id = 20 AND turn <= 1))")
def composite_scan(spark, sf_dir):
    return view(spark, sf_dir, "conversations", ["conv_id", "turn"]).scan((3, 2), (20, 1))


@query("SELECT * FROM conversations WHERE conv_id BETWEEN 5 AND 9")
def composite_prefix_scan(spark, sf_dir):
    return view(spark, sf_dir, "conversations", ["conv_id", "turn"]).scan((5,), (9,))


@query("SELECT * FROM part WHERE p_name BETWEEN 'b' AND 'm'")
def string_key_scan(spark, sf_dir):
    return view(spark, sf_dir, "part", "p_name").scan("b", "m")


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topk_by_value(spark, sf_dir):
    return orders(spark, sf_dir).top_by("o_totalprice", 15)


# --- ends, neighbours, counts ---
@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1")
def first_row(spark, sf_dir):
    return orders(spark, sf_dir).first()


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_row(spark, sf_dir):
    return orders(spark, sf_dir).last()


@query("SELECT min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_price, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders")
def first_last(spark, sf_dir):
    return orders(spark, sf_dir).rows.agg(
        F.min("o_orderkey").alias("first_key"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.max("o_orderkey").alias("last_key"), F.max_by("o_totalprice", "o_orderkey").alias("last_price")
    )


@query("SELECT * FROM orders WHERE o_orderkey > 123 ORDER BY o_orderkey LIMIT 1")
def successor(spark, sf_dir):
    return orders(spark, sf_dir).next_after(123)


@query("SELECT * FROM orders WHERE o_orderkey < 123 ORDER BY o_orderkey DESC LIMIT 1")
def predecessor(spark, sf_dir):
    return orders(spark, sf_dir).prev_before(123)


@query("SELECT event_id, lead(event_id) OVER (ORDER BY event_id) AS next_key, lag(event_id) OVER (ORDER BY event_id) AS prev_key FROM events")
def next_prev(spark, sf_dir):
    return ordering.neighbours(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("SELECT c.c_custkey * 11 + 3 AS probe, (SELECT min(doc_id) FROM labels WHERE doc_id > c.c_custkey * 11 + 3) AS next_key, (SELECT max(doc_id) FROM labels WHERE doc_id < c.c_custkey * 11 + 3) AS prev_key FROM customer c")
def successor_batch(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 11 + 3).alias("probe"))
    return ordering.nearest(table(spark, sf_dir, "labels"), probes, "doc_id", "probe")


@query("SELECT count(*) AS n FROM lineitem")
def count(spark, sf_dir):
    return _value(spark, view(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]).count())


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def count_range(spark, sf_dir):
    return _value(spark, _stored(spark, sf_dir).count_range(100, 900))


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 500 AND 10")
def count_range_inverted(spark, sf_dir):
    return _value(spark, _stored(spark, sf_dir).count_range(500, 10))


# --- writes, as pure functions ---
#: A batch against orders: an order of each customer, some under present keys and some under new ones.
_BATCH_SQL = """(SELECT c_custkey * 13 AS o_orderkey, c_custkey AS o_custkey, 'X' AS o_orderstatus, c_acctbal AS o_totalprice,
  TIMESTAMP '1998-01-01 00:00:00' AS o_orderdate, c_mktsegment AS o_orderpriority FROM customer)"""
_KEY = ["o_orderkey"]


def _base(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _batch(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 13).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("X").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"),
        F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"), F.col("c_mktsegment").alias("o_orderpriority"),
    )


@query(f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_BATCH_SQL}) UNION ALL SELECT * FROM {_BATCH_SQL}")
def put_range(spark, sf_dir):
    base = _base(spark, sf_dir)
    return writes.put(base, _batch(spark, sf_dir), _KEY, whole=True)


@query(f"SELECT b.o_orderkey, o.o_orderkey IS NOT NULL AS existed, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' ELSE 'updated' END AS status FROM {_BATCH_SQL} b LEFT JOIN orders o USING (o_orderkey)")
def put_status(spark, sf_dir):
    out = writes.put(_base(spark, sf_dir), _batch(spark, sf_dir), _KEY)
    return out.select("o_orderkey", "existed", F.when(F.col("existed"), "updated").otherwise("inserted").alias("status"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return writes.last_wins(rows, ["user_id"], "event_id")


@query(f"SELECT * FROM orders UNION ALL SELECT * FROM {_BATCH_SQL} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def try_insert(spark, sf_dir):
    base = _base(spark, sf_dir)
    return writes.try_insert(base, _batch(spark, sf_dir), _KEY, whole=True)


@query(f"SELECT b.o_orderkey, o.o_orderkey IS NULL AS inserted FROM {_BATCH_SQL} b LEFT JOIN orders o USING (o_orderkey)")
def try_insert_status(spark, sf_dir):
    out = writes.try_insert(_base(spark, sf_dir), _batch(spark, sf_dir), _KEY)
    return out.select("o_orderkey", (F.col("op") == "put").alias("inserted"))


@query(f"SELECT o.o_orderkey, coalesce(b.o_custkey, o.o_custkey) AS o_custkey, coalesce(b.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(b.o_orderdate, o.o_orderdate) AS o_orderdate, coalesce(b.o_orderpriority, o.o_orderpriority) AS o_orderpriority FROM orders o LEFT JOIN {_BATCH_SQL} b USING (o_orderkey)")
def try_update(spark, sf_dir):
    base = _base(spark, sf_dir)
    return writes.try_update(base, _batch(spark, sf_dir), _KEY, whole=True)


@query("SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal) FROM customer")
def update_expr(spark, sf_dir):
    base = table(spark, sf_dir, "customer")
    keys = base.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return writes.update_with(base, keys, ["c_custkey"], increment("c_acctbal", 10), whole=True)


_HITS_SQL = "(SELECT user_id, count(*) AS hits FROM events GROUP BY user_id)"


@query(f"SELECT user_id, hits FROM {_HITS_SQL}")
def add_or_update_empty(spark, sf_dir):
    batch = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("hits"))
    base = batch.limit(0)
    return writes.add_or_update(base, batch, ["user_id"], add_given("hits"), whole=True)


@query(f"SELECT coalesce(c.c_custkey, h.user_id) AS user_id, CAST(CASE WHEN c.c_custkey IS NULL THEN h.hits WHEN h.user_id IS NULL THEN 1000 ELSE 1000 + h.hits END AS BIGINT) AS hits FROM customer c FULL JOIN {_HITS_SQL} h ON h.user_id = c.c_custkey")
def add_or_update(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1000).cast("long").alias("hits"))
    batch = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("hits"))
    return writes.merge(base, batch, ["user_id"], add_given("hits"))


@query(f"SELECT b.o_orderkey, coalesce(o.o_totalprice, b.o_totalprice) AS o_totalprice, o.o_orderkey IS NOT NULL AS existed FROM {_BATCH_SQL} b LEFT JOIN orders o USING (o_orderkey)")
def get_or_add(spark, sf_dir):
    return writes.get_or_add(_base(spark, sf_dir), _batch(spark, sf_dir), _KEY).select("o_orderkey", "o_totalprice", "existed")


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey * 13 FROM customer)")
def delete_keys(spark, sf_dir):
    base = _base(spark, sf_dir)
    return writes.delete(base, _probes(spark, sf_dir), _KEY, whole=True)


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT c_custkey * 13 FROM customer)")
def pop(spark, sf_dir):
    out = writes.pop(_base(spark, sf_dir), _probes(spark, sf_dir), _KEY)
    return out.where("op = 'del'").select("o_orderkey", "old.*")


@query("SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN 'S' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
def compare_and_swap(spark, sf_dir):
    base = _base(spark, sf_dir)
    batch = base.withColumn("o_orderstatus", F.lit("S")).withColumn("was", F.lit("O"))
    return writes.compare_and_swap(base, batch, _KEY, expected={"o_orderstatus": "was"}, whole=True)


@query("SELECT * FROM orders WHERE NOT o_orderkey BETWEEN 100 AND 900")
def delete_range(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.delete_range(100, 900)
    return made.rows


@query(f"SELECT coalesce(o.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change, o.o_totalprice AS before_price, b.o_totalprice AS after_price FROM orders o FULL JOIN {_BATCH_SQL} b USING (o_orderkey)")
def version_diff(spark, sf_dir):
    found = writes.version_diff(_base(spark, sf_dir), _batch(spark, sf_dir), _KEY)
    return found.select("o_orderkey", "change", F.col("before.o_totalprice").alias("before_price"), F.col("after.o_totalprice").alias("after_price"))


_APPEND_SQL = "(SELECT event_id, CAST(floor(epoch_ms(ts) / 600000) AS BIGINT) AS wanted FROM events)"


@query(f"SELECT event_id, wanted, rn + max(wanted - rn) OVER (ORDER BY rn) AS key FROM (SELECT *, row_number() OVER (ORDER BY wanted, event_id) AS rn FROM {_APPEND_SQL})")
def append_bump(spark, sf_dir):
    # slots of ten minutes from the calendar fields: a cast to an instant would follow the session's time zone
    ts = F.col("ts")
    slot = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 144 + F.hour(ts) * 6 + F.floor(F.minute(ts) / 10)
    rows = table(spark, sf_dir, "events").select("event_id", slot.cast("long").alias("wanted"))
    return ordering.append_keys(rows, "wanted", "event_id")


# --- checks ---
@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_duplicates(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) - count(DISTINCT o_orderkey) AS n_repeated, count(*) - count(o_orderkey) AS n_null FROM orders")
def validate_orders(spark, sf_dir):
    return checks.key_report(_base(spark, sf_dir), _KEY)


@query("SELECT o_orderkey // 500 AS bucket, count(*) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders GROUP BY 1")
def stats_by_range(spark, sf_dir):
    return checks.range_statistics(_base(spark, sf_dir), "o_orderkey", 500)


# --- through versioned tables ---
def _stored(spark, sf_dir, **options) -> KeyedTable:
    made = KeyedTable.create(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", _base(spark, sf_dir).schema, _KEY, Options(**options))
    made.load(_base(spark, sf_dir), unique=True)
    return made


def _again(spark, made: KeyedTable, **options) -> KeyedTable:
    """Another handle of the same table, as another process would have it."""
    return KeyedTable.open(spark, made._store.files.root, Options(**options))


def _raised(kind: type[Exception], call: Callable[[], Any]) -> bool:
    try:
        call()
    except kind:
        return True
    return False


_MERGED_SQL = f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_BATCH_SQL}) UNION ALL SELECT * FROM {_BATCH_SQL}"


@query("SELECT * FROM orders WHERE o_orderkey = 100")
def indexer(spark, sf_dir):
    made = _stored(spark, sf_dir)
    return spark.createDataFrame([made[100]], made.schema)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def iterate(spark, sf_dir):
    made = _stored(spark, sf_dir)
    return made.each(lambda rows: ((r["o_orderkey"],) for r in rows), "o_orderkey long")


@query("SELECT p.k AS o_orderkey, o.* EXCLUDE (o_orderkey), o.o_orderkey IS NOT NULL AS found FROM (SELECT c_custkey * 7 AS k FROM customer) p LEFT JOIN orders o ON o.o_orderkey = p.k")
def table_multi_get(spark, sf_dir):
    return _stored(spark, sf_dir).multi_get(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("o_orderkey")))


@query("SELECT * FROM orders WHERE o_orderkey > 500 AND o_orderkey NOT BETWEEN 505 AND 510 ORDER BY o_orderkey LIMIT 20")
def table_page(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.delete_range(505, 510)
    return made.page(20, after=500)


@query("SELECT (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 123) AS next_key, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 123) AS prev_key, (SELECT min(o_orderkey) FROM orders) AS first_key, (SELECT max(o_orderkey) FROM orders) AS last_key, (SELECT count(*) FROM orders) AS n")
def table_neighbours(spark, sf_dir):
    made = _stored(spark, sf_dir)
    ends = [x.first()["o_orderkey"] for x in (made.next_after(123), made.prev_before(123), made.first(), made.last())]
    return spark.createDataFrame([(*ends, len(made))], "next_key long, prev_key long, first_key long, last_key long, n long")


@query(_MERGED_SQL)
def commit_async(spark, sf_dir):
    made = _stored(spark, sf_dir)
    tx = made.transaction()
    tx.insert_range(_batch(spark, sf_dir))
    tx.commit_async().result()
    return made.rows


@query("SELECT count(*) AS n, true AS conflicted FROM orders WHERE o_orderkey NOT BETWEEN 0 AND 10")
def conflict_aborts(spark, sf_dir):
    made = _stored(spark, sf_dir)
    one, two = made.transaction(), made.transaction()
    one.delete_range(0, 10)
    two.delete_range(20, 30)
    one.commit()
    conflicted = _raised(ConflictError, two.commit)
    return made.rows.agg(F.count("*").alias("n")).withColumn("conflicted", F.lit(conflicted))


@query("SELECT true AS touched, false AS elsewhere, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN 0 AND 100) AS seen")
def serializable_reads(spark, sf_dir):
    made = _stored(spark, sf_dir)
    one, two = made.transaction(serializable=True), made.transaction(serializable=True)
    seen = one.count_range(0, 100)
    two.count_range(3000, 3100)
    made.delete_range(50, 60)
    seen = min(seen, one.count_range(0, 100))  # still what it was at the start
    return spark.createDataFrame([(_raised(ConflictError, one.commit), _raised(ConflictError, two.commit), seen)], "touched boolean, elsewhere boolean, seen long")


@query("SELECT * REPLACE (CASE WHEN o_orderkey = 7 THEN o_totalprice + 4 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey <= 20")
def concurrent_writers(spark, sf_dir):
    made = _stored(spark, sf_dir, retries=50)

    def work(_: int) -> None:
        mine = _again(spark, made, retries=50)
        for _ in range(2):
            mine.update_with([7], increment("o_totalprice", 1))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(work, range(2)))
    return made.scan(end=20)


@query("SELECT count(*) AS n, true AS valid FROM orders")
def recovery(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.transaction().delete_range(0, 900)  # staged and never committed: as if the process had ended here
    again = _again(spark, made)
    return again.rows.agg(F.count("*").alias("n")).withColumn("valid", F.lit(again.validate().is_valid))


@query(_MERGED_SQL)
def checkpoint_fold(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.put_range(_batch(spark, sf_dir))
    made.checkpoint()
    return _again(spark, made).rows


@query("SELECT count(*) AS n, true AS folded FROM orders WHERE o_orderkey NOT BETWEEN 0 AND 20")
def auto_checkpoint(spark, sf_dir):
    made = _stored(spark, sf_dir, fold_after=2)
    made.delete_range(0, 10)
    made.delete_range(11, 20)
    return made.rows.agg(F.count("*").alias("n")).withColumn("folded", F.lit(made.statistics().delta_files == 0))


@query(f"SELECT * FROM ({_MERGED_SQL}) WHERE o_orderkey NOT BETWEEN 200 AND 400")
def compact_beside_a_writer(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.put_range(_batch(spark, sf_dir))
    _again(spark, made, on_compaction_started=lambda: made.delete_range(200, 400)).compact()
    return made.rows


@query("SELECT count(*) AS n, CAST(11 AS BIGINT) AS deleted, true AS read_back FROM orders WHERE o_orderkey NOT BETWEEN 100 AND 110")
def vacuum_beside_a_writer(spark, sf_dir):
    made = _stored(spark, sf_dir)
    with made.transaction() as tx:
        deleted = tx.delete_range(100, 110)
        _again(spark, made).vacuum()
        tx.commit()
    return made.rows.agg(F.count("*").alias("n")).select("n", F.lit(deleted).cast("long").alias("deleted"), (F.col("n") == len(made)).alias("read_back"))


@query("SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS delta_rows, CAST(2 AS BIGINT) AS version, CAST(1 AS BIGINT) AS snapshots FROM orders WHERE o_orderkey NOT BETWEEN 100 AND 110")
def statistics(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.delete_range(100, 110)
    with made.snapshot():
        s = made.statistics()
    return spark.createDataFrame([(s.rows, s.delta_rows, s.version, s.open_snapshots)], "n_rows long, delta_rows long, version long, snapshots long")


@query("SELECT true AS valid, CAST(0 AS BIGINT) AS errors")
def validate_table(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.put_range(_batch(spark, sf_dir))
    found = made.validate()
    return spark.createDataFrame([(found.is_valid, len(found.errors))], "valid boolean, errors long")


@query("SELECT 'started,completed' AS calls, true AS saved, true AS second_rejected")
def callbacks(spark, sf_dir):
    calls: list[str] = []
    inner: list[bool] = []
    made = _stored(spark, sf_dir)
    made.delete_range(0, 100)

    def started() -> None:
        calls.append("started")
        inner.append(_raised(MaintenanceError, again.compact))

    again = _again(spark, made, on_compaction_started=started, on_compaction_completed=lambda _: calls.append("completed"))
    result = again.compact()
    return spark.createDataFrame([(",".join(calls), result.files_removed > 0, inner[0])], "calls string, saved boolean, second_rejected boolean")


@query("SELECT * FROM (VALUES ('closed', true), ('finished', true), ('null key', true), ('no table', true), ('no column', true), ('options', true), ('repeated key', true), ('absent key', true)) t(error, raised)")
def exceptions(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.flush()
    tx = made.transaction()
    tx.rollback()
    rows = _batch(spark, sf_dir).limit(1)
    found = [
        ("finished", _raised(FinishedError, lambda: tx.delete_range(0, 1))),
        ("null key", _raised(NullKeyError, lambda: made.put_range(rows.withColumn("o_orderkey", F.lit(None).cast("long"))))),
        ("no table", _raised(KeyedTableError, lambda: KeyedTable.open(spark, f"{shared_folder(spark)}/none-{uuid.uuid4().hex}"))),
        ("no column", _raised(SchemaError, lambda: made.put_range(rows.drop("o_custkey")))),
        ("options", _raised(ValueError, lambda: Options(retries=-1).validate())),
        ("repeated key", _raised(DuplicateKeyError, lambda: made.add_or_update(rows.unionByName(rows), lambda old, new: new))),
        ("absent key", _raised(KeyError, lambda: made[-1])),
    ]
    made.close()
    return spark.createDataFrame([("closed", _raised(ClosedError, made.flush)), *found], "error string, raised boolean")


@query(f"SELECT * FROM (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_BATCH_SQL}) UNION ALL SELECT * FROM {_BATCH_SQL}) WHERE o_orderkey NOT BETWEEN 200 AND 400")
def txn_read_own_writes(spark, sf_dir):
    tx = _stored(spark, sf_dir).transaction()
    tx.insert_range(_batch(spark, sf_dir))
    tx.delete_range(200, 400)
    return tx.scan()


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def snapshot_frozen(spark, sf_dir):
    made = _stored(spark, sf_dir)
    frozen = made.snapshot()
    made.put_range(_batch(spark, sf_dir))
    made.delete_range(0, 500)
    return frozen.scan(100, 900)


@query(f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_BATCH_SQL}) UNION ALL SELECT * FROM {_BATCH_SQL}")
def compact_invariance(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.put_range(_batch(spark, sf_dir))
    made.compact()
    return made.scan()


@query(f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_BATCH_SQL}) UNION ALL SELECT * FROM {_BATCH_SQL}")
def delta_overlay(spark, sf_dir):
    made = _stored(spark, sf_dir)
    made.put_range(_batch(spark, sf_dir))
    return made.scan()


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey > 900")
def scope_rollback(spark, sf_dir):
    made = _stored(spark, sf_dir)
    with made.scope() as s:
        s.delete_range(0, 900)
        s.complete()
    with made.scope() as s:
        s.delete_range(0, 10_000_000)
    return made.rows.agg(F.count("*").alias("n"))
