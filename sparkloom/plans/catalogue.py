"""Every operator as a query over the driver's tables, with the same question in SQL beside it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate, tuple_in
from ..functions.rowkey import KeyColumn, row_key
from ..operators.cursor import AT_OR_AFTER
from ..operators.scan import Scan
from ..operators.udaf import Welford
from ..operators.udaf import aggregate as own_aggregate
from ..sources import files, maintenance
from ..sources.dataset import Dataset, DatasetSet, Layout, SourceRange
from ..sources.shared import shared_folder
from ..streaming import ingest
from .estimate import estimate
from .partials import Measure, Partial, Question

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> Scan:
    return Scan.parquet(spark, f"{sf}/{name}.parquet", columns=columns)


def n(scan: Scan) -> DataFrame:
    return scan.aggregate(lambda g: {"n": g.count()})


# -- the whole shape -----------------------------------------------------------------------


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS rows, round(sum(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY ALL HAVING count(*) > 10 ORDER BY quantity DESC LIMIT 10""")
def flagship(spark, sf):
    """Filter, group, having, order, take over lineitem."""
    groups = table(spark, sf, "lineitem").where(lambda r: r.l_shipdate >= dt.datetime(1995, 6, 1)).group_by("l_returnflag", "l_linestatus").where(lambda g: g.count() > 10).order_by(lambda g: g.sum("l_quantity"), descending=True).take(10)
    out = groups.select(lambda g: {"flag": g.key.l_returnflag, "status": g.key.l_linestatus, "rows": g.count(), "quantity": g.sum("l_quantity"), "price": g.average("l_extendedprice")})
    return out.withColumns({"quantity": F.round("quantity", 4), "price": F.round("price", 4)})


# -- sources -------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def scan_typed(spark, sf):
    record = T.StructType([T.StructField("l_orderkey", T.LongType(), False), T.StructField("L_QUANTITY", T.DoubleType())])
    return Scan.parquet(spark, f"{sf}/lineitem.parquet", record=record).where(lambda r: r.L_QUANTITY > 49).df.withColumnRenamed("L_QUANTITY", "l_quantity")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_untyped(spark, sf):
    return table(spark, sf, "nation", "n_name", "n_nationkey").df


@query("SELECT n_name AS name, 0 AS part FROM nation UNION ALL SELECT r_name, 1 FROM region")
def union_sets(spark, sf):
    a = table(spark, sf, "nation").select(name="n_name")
    b = table(spark, sf, "region").select(name="r_name")
    both = Scan.union(a, b)
    return both._df.select("name", F.col("__o0").alias("part"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER () AS i FROM orders) WHERE i > 10 AND i <= 15")
def rows_by_range(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").rows(10, 15).df


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER () - 1 AS i FROM orders) WHERE i IN (3, 7, 11)")
def rows_by_id(spark, sf):
    return table(spark, sf, "orders", "o_orderkey").rows_at(7, 3, 11, 7).df


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL")
def result_as_source(spark, sf):
    first = table(spark, sf, "events").where(lambda r: r.value > 50).select("event_type", "value").df
    return Scan.of(first).group_by("event_type").select(lambda g: {"event_type": g.key, "n": g.count()})


# -- predicates ----------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_discount <> 0.05 AND l_shipdate < TIMESTAMP '1997-01-01'")
def filter_cmp(spark, sf):
    return n(table(spark, sf, "lineitem").where(lambda r: (r.l_quantity >= 30) & (r.l_discount != 0.05) & (r.l_shipdate < dt.datetime(1997, 1, 1))))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (1, 5, 9, 700)")
def filter_in(spark, sf):
    return n(table(spark, sf, "orders").where(lambda r: r.o_orderstatus.is_in(["F", None, "O"]) & r.o_custkey.is_in([1, 5, 9, 700, None])))


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_linenumber BETWEEN 2 AND 4")
def filter_between(spark, sf):
    return n(table(spark, sf, "lineitem").where(lambda r: r.l_discount.between(0.03, 0.07) & r.l_linenumber.between(2, 4)))


NULLED = "SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS w FROM events"


def nulled(spark, sf) -> Scan:
    df = spark.read.parquet(f"{sf}/events.parquet")
    v = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    return Scan.of(df.withColumns({"v": v, "w": F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(v)}), ["event_id"])


@query(f"SELECT count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v IS NOT NULL) AS some FROM ({NULLED})")
def filter_null_logic(spark, sf):
    return nulled(spark, sf).aggregate(lambda g: {"nulls": g.count(lambda r: r.v == None), "some": g.count(lambda r: r.v.is_not_null())})  # noqa: E711


@query(f"SELECT count(*) FILTER (WHERE NOT (v > 45)) AS n, count(*) FILTER (WHERE NOT (v > 45) OR value > 90) AS m FROM ({NULLED})")
def filter_not_3vl(spark, sf):
    return nulled(spark, sf).aggregate(lambda g: {"n": g.count(lambda r: ~(r.v > 45)), "m": g.count(lambda r: ~(r.v > 45) | (r.value > 90))})


@query(f"""SELECT count(*) FILTER (WHERE w > 50 AND NOT isnan(w)) AS gt, count(*) FILTER (WHERE w <= 50 AND NOT isnan(w)) AS le, count(*) FILTER (WHERE w = w AND NOT isnan(w)) AS eq,
count(*) FILTER (WHERE isnan(w) OR w <> 50) AS ne, count(*) FILTER (WHERE NOT (w > 50) OR isnan(w)) AS not_gt FROM ({NULLED})""")
def filter_nan(spark, sf):
    return nulled(spark, sf).aggregate(lambda g: {"gt": g.count(lambda r: r.w > 50), "le": g.count(lambda r: r.w <= 50), "eq": g.count(lambda r: r.w == r.w), "ne": g.count(lambda r: r.w != 50.0), "not_gt": g.count(lambda r: ~(r.w > 50))})


@query("SELECT count(*) FILTER (WHERE flag) AS t, count(*) FILTER (WHERE NOT flag) AS f FROM (SELECT value > 50 AS flag FROM events)")
def filter_bool(spark, sf):
    scan = Scan.of(spark.read.parquet(f"{sf}/events.parquet").select((F.col("value") > 50).alias("flag")))
    return scan.aggregate(lambda g: {"t": g.count(lambda r: r.flag.is_true()), "f": g.count(lambda r: r.flag.is_false())})


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'S%'")
def filter_like(spark, sf):
    return n(table(spark, sf, "part").where(lambda r: r.p_name.like("%a_e%") & ~r.p_type.like("S%")))


@query("SELECT count(*) AS n FROM documents WHERE starts_with(text, 'Th')")
def filter_starts_with(spark, sf):
    return n(table(spark, sf, "documents").where(lambda r: r.text.starts_with("Th")))


@query("SELECT count(*) AS n FROM documents WHERE contains(text, 'token = ')")
def filter_contains(spark, sf):
    return n(table(spark, sf, "documents").where(lambda r: r.text.contains("token = ")))


@query(r"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '(^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])tion([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|$)')")
def filter_has_token(spark, sf):
    return n(table(spark, sf, "documents").where(lambda r: r.text.has_token("tion")))


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount > l_tax AND l_partkey <> l_suppkey")
def filter_col_vs_col(spark, sf):
    return n(table(spark, sf, "lineitem").where(lambda r: (r.l_discount > r.l_tax) & (r.l_partkey != r.l_suppkey)))


@query("SELECT count(*) AS n FROM lineitem WHERE (l_returnflag, l_linenumber) IN (('A', 1), ('R', 3), ('N', 5))")
def tuple_in2(spark, sf):
    return n(table(spark, sf, "lineitem").where(lambda r: tuple_in([r.l_returnflag, r.l_linenumber], [("A", 1), ("R", 3), ("N", 5), (None, 2)])))


@query("SELECT count(*) FILTER (WHERE list_contains(embedding, embedding[1])) AS own, count(*) FILTER (WHERE list_contains(embedding, 7.5)) AS other FROM embeddings")
def list_contains(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    own = df.select(F.array_contains("embedding", F.col("embedding")[0]).alias("own"), "embedding")
    return Scan.of(own).aggregate(lambda g: {"own": g.count(lambda r: r.own.is_true()), "other": g.count(lambda r: r.embedding.contains(7.5))})


@query("SELECT count(*) FILTER (WHERE true) AS everything, count(*) FILTER (WHERE false) AS nothing FROM nation")
def filter_all_none(spark, sf):
    return table(spark, sf, "nation").aggregate(lambda g: {"everything": g.count(Predicate.all()), "nothing": g.count(Predicate.none())})


@query("SELECT count(*) AS n FROM customer WHERE (c_mktsegment IN ('BUILDING', 'AUTOMOBILE') OR c_name LIKE '%9') AND NOT c_acctbal < 0 AND c_nationkey IS NOT NULL")
def tool_text_filter(spark, sf):
    return n(table(spark, sf, "customer").where("""(c_mktsegment in ('BUILDING', ?0) or "c_name" like '%9') and not c_acctbal < 0 and c_nationkey is not null""", "AUTOMOBILE"))


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND (event_type, user_id) IN (('click', 3), ('view', 5), ('purchase', 7))")
def tool_text_tuples(spark, sf):
    return n(table(spark, sf, "events").where("ts >= '2024-01-10 12:00:00' and (event_type, user_id) in (('click', 3), ('view', 5), ('purchase', 7))"))


@query("""SELECT c_mktsegment, count(*) AS "count()", count(DISTINCT c_nationkey) AS "count_distinct(c_nationkey)", round(sum(c_acctbal), 4) AS "sum(c_acctbal)", min(c_acctbal) AS "min(c_acctbal)", max(c_name) AS "max(c_name)", round(avg(c_acctbal), 4) AS "avg(c_acctbal)" FROM customer GROUP BY 1""")
def tool_text_aggregate(spark, sf):
    out = table(spark, sf, "customer").group_by("c_mktsegment").text("count()", "count_distinct(c_nationkey)", "sum(c_acctbal)", "min(c_acctbal)", "max(c_name)", "avg(c_acctbal)")
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 4) for c in ("sum(c_acctbal)", "avg(c_acctbal)")})


# -- semi-joins ----------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark, sf):
    chosen = table(spark, sf, "customer").where(lambda r: r.c_mktsegment == "BUILDING").select("c_custkey")
    return n(table(spark, sf, "orders").where_in("o_custkey", chosen))


@query("SELECT count(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_quantity = 50 AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey)")
def semi_join_tuple2(spark, sf):
    items = table(spark, sf, "lineitem")
    return n(items.where_in(["l_partkey", "l_suppkey"], items.where(lambda r: r.l_quantity == 50).select("l_partkey", "l_suppkey")))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_in(spark, sf):
    return n(table(spark, sf, "customer").where_in("c_custkey", table(spark, sf, "orders").select("o_custkey"), negated=True))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, count(*) AS n FROM orders GROUP BY 1")
def map_lookup(spark, sf):
    return table(spark, sf, "orders").group_by(status=lambda r: r.o_orderstatus.map({"F": "filled", "O": "open"})).select(lambda g: {"status": g.key, "n": g.count()})


# -- projections, order, windows -------------------------------------------------------------


@query("SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders WHERE o_totalprice > 400000")
def project(spark, sf):
    return table(spark, sf, "orders").where(lambda r: r.o_totalprice > 400000).select(k="o_orderkey", m=lambda r: r.o_orderdate.truncate("month")).df


@query("SELECT s.x AS x, s.y.z AS z FROM (SELECT {'x': n_nationkey, 'y': {'z': n_name}} AS s FROM nation) WHERE s.y.z > 'F'")
def nested_field(spark, sf):
    df = spark.read.parquet(f"{sf}/nation.parquet").select(F.struct(F.col("n_nationkey").alias("x"), F.struct(F.col("n_name").alias("z")).alias("y")).alias("s"))
    return Scan.of(df).where(lambda r: r.s.y.z > "F").select(x=lambda r: r.s.x, z=lambda r: r.s.y.z).df


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct().df


@query(f"SELECT v, event_id FROM ({NULLED}) ORDER BY v DESC NULLS LAST, event_id DESC LIMIT 20")
def order_take(spark, sf):
    return nulled(spark, sf).order_by("v", descending=True).take(20).select("v", "event_id").df


@query(f"SELECT v, event_id FROM ({NULLED}) ORDER BY v ASC NULLS LAST, event_id LIMIT 15 OFFSET 30")
def skip_take(spark, sf):
    return nulled(spark, sf).order_by("v").skip(30).take(15).select("v", "event_id").df


# -- aggregates ----------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count(spark, sf):
    scan = table(spark, sf, "lineitem").where(lambda r: r.l_returnflag == "R")
    return spark.createDataFrame([(scan.count(),)], "n long")


@query("SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) AS some, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 5000) AS none")
def any_rows(spark, sf):
    scan = table(spark, sf, "lineitem")
    return spark.createDataFrame([(scan.where(lambda r: r.l_quantity > 49).any(), scan.where(lambda r: r.l_quantity > 5000).any())], "some boolean, none boolean")


@query(f"SELECT min(w) FILTER (WHERE NOT isnan(w)) AS lo, max(w) FILTER (WHERE NOT isnan(w)) AS hi, min(event_type) AS first_type, max(ts) AS last_ts FROM ({NULLED})")
def min_max(spark, sf):
    return nulled(spark, sf).aggregate(lambda g: {"lo": g.min("w"), "hi": g.max("w"), "first_type": g.min("event_type"), "last_ts": g.max("ts")})


@query("SELECT sum(l_linenumber)::BIGINT AS small, sum(l_orderkey)::BIGINT AS wide, round(sum(l_quantity), 4) AS floating, coalesce(sum(l_orderkey) FILTER (WHERE l_quantity > 5000), 0)::BIGINT AS nothing FROM lineitem")
def sum_widen(spark, sf):
    out = table(spark, sf, "lineitem").aggregate(lambda g: {"small": g.sum("l_linenumber"), "wide": g.sum("l_orderkey"), "floating": g.sum("l_quantity"), "nothing": g.where(lambda r: r.l_quantity > 5000).sum("l_orderkey")})
    return out.withColumn("floating", F.round("floating", 4))


@query("SELECT sum(l_orderkey::HUGEINT * 1000000000000)::DECIMAL(38,0)::VARCHAR AS total FROM lineitem")
def sum_int128(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey").cast("decimal(20,0)") * F.lit(1000000000000).cast("decimal(13,0)")).cast("decimal(38,0)").alias("x"))
    return Scan.of(df).aggregate(lambda g: {"total": g.sum("x")}).select(F.col("total").cast("string").alias("total"))


@query("SELECT l_returnflag, sum(CAST(l_extendedprice * 100 AS DECIMAL(18,0)))::DECIMAL(38,0)::DOUBLE AS cents FROM lineitem GROUP BY 1")
def sum_decimal(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", F.round(F.col("l_extendedprice") * 100, 0).cast("decimal(18,0)").alias("x"))
    return Scan.of(df).group_by("l_returnflag").select(lambda g: {"l_returnflag": g.key, "cents": g.sum("x")}).withColumn("cents", F.col("cents").cast("double"))


@query("SELECT l_returnflag, round(fsum(l_extendedprice), 4) AS total FROM lineitem GROUP BY 1")
def sum_exact(spark, sf):
    out = table(spark, sf, "lineitem").group_by("l_returnflag").select(lambda g: {"l_returnflag": g.key, "total": g.sum("l_extendedprice", exact=True)})
    return out.withColumn("total", F.round("total", 4))


@query(f"SELECT event_type, round(avg(w) FILTER (WHERE NOT isnan(w)), 6) AS mean FROM ({NULLED}) GROUP BY 1")
def avg(spark, sf):
    return nulled(spark, sf).group_by("event_type").select(lambda g: {"event_type": g.key, "mean": g.average("w")}).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS deviation FROM events GROUP BY 1")
def variance_stddev(spark, sf):
    out = table(spark, sf, "events").group_by("event_type").select(lambda g: {"event_type": g.key, "variance": g.variance("value"), "deviation": g.standard_deviation("value")})
    return out.withColumns({"variance": F.round("variance", 4), "deviation": F.round("deviation", 4)})


@query(f"SELECT count(DISTINCT user_id) AS users, count(DISTINCT w) AS values FROM ({NULLED})")
def count_distinct(spark, sf):
    return nulled(spark, sf).aggregate(lambda g: {"users": g.count_distinct("user_id"), "values": g.count_distinct("w")})


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").group_by("l_returnflag").select(lambda g: {"l_returnflag": g.key, "parts": g.approximate_count_distinct("l_partkey")})


@query("SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE l_quantity > 25) AS big, round(avg(l_extendedprice) FILTER (WHERE l_quantity > 25), 4) AS mean, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25 AND l_tax > 0.04) AS suppliers FROM lineitem GROUP BY 1")
def filtered_agg(spark, sf):
    out = table(spark, sf, "lineitem").group_by("l_returnflag").select(lambda g: {"l_returnflag": g.key, "rows": g.count(), "big": g.count(lambda r: r.l_quantity > 25), "mean": g.where(lambda r: r.l_quantity > 25).average("l_extendedprice"), "suppliers": g.where(lambda r: r.l_quantity > 25).where(lambda r: r.l_tax > 0.04).count_distinct("l_suppkey")})
    return out.withColumn("mean", F.round("mean", 4))


@query(f"SELECT event_type, count(*) FILTER (WHERE v > 99) > 0 AS any_top, count(*) FILTER (WHERE (v >= 0) IS NOT TRUE) = 0 AS all_there, count(*) FILTER (WHERE (value >= 0) IS NOT TRUE) = 0 AS all_positive FROM ({NULLED}) GROUP BY 1")
def any_all(spark, sf):
    return nulled(spark, sf).group_by("event_type").select(lambda g: {"event_type": g.key, "any_top": g.any(lambda r: r.v > 99), "all_there": g.all(lambda r: r.v >= 0), "all_positive": g.all(lambda r: r.value >= 0)})


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def group_composite(spark, sf):
    return table(spark, sf, "lineitem").group_by("l_returnflag", "l_linestatus", "l_linenumber").select(lambda g: {"l_returnflag": g.key.l_returnflag, "l_linestatus": g.key.l_linestatus, "l_linenumber": g.key.l_linenumber, "n": g.count()})


@query(f"SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS k, count(*) AS n FROM ({NULLED}) GROUP BY 1")
def group_null_key(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("k"))
    return Scan.of(df).group_by("k").select(lambda g: {"k": g.key, "n": g.count()})


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60 AND user_id > 10")
def group_having(spark, sf):
    return table(spark, sf, "events").group_by("user_id").where(lambda g: (g.count() > 60) & (g.key > 10)).select(lambda g: {"user_id": g.key, "n": g.count()})


@query("SELECT l_suppkey, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 10 OFFSET 5")
def group_order_take(spark, sf):
    out = table(spark, sf, "lineitem").group_by("l_suppkey").order_by(lambda g: g.sum("l_quantity"), descending=True).then_by(lambda g: g.key).skip(5).take(10).select(lambda g: {"l_suppkey": g.key, "q": g.sum("l_quantity")})
    return out.withColumn("q", F.round("q", 4))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 7")
def group_top_keys(spark, sf):
    return table(spark, sf, "lineitem").group_by("l_suppkey").order_by(lambda g: g.key).take(7).select(lambda g: {"l_suppkey": g.key, "n": g.count()})


@query("SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def group_of_groups(spark, sf):
    first = table(spark, sf, "events").group_by("user_id").select(lambda g: {"user_id": g.key, "n": g.count()})
    return Scan.of(first).group_by("n").select(lambda g: {"n": g.key, "users": g.count()})


@query(f"SELECT event_type, first(event_id ORDER BY event_id) AS f, first(v ORDER BY event_id) AS fv, last(event_id ORDER BY event_id) AS l, last(v ORDER BY event_id) AS lv FROM ({NULLED}) GROUP BY 1")
def chosen_first_last(spark, sf):
    return nulled(spark, sf).group_by("event_type").select(lambda g: {"event_type": g.key, "f": g.first().event_id, "fv": g.first().v, "l": g.last().event_id, "lv": g.last().v})


@query(f"""SELECT event_type, first(event_id ORDER BY w, event_id) FILTER (WHERE NOT isnan(w)) AS lo, first(event_id ORDER BY w DESC, event_id) FILTER (WHERE NOT isnan(w)) AS hi,
first(user_id ORDER BY w DESC, event_id) FILTER (WHERE NOT isnan(w)) AS hi_user FROM ({NULLED}) GROUP BY 1""")
def min_by_max_by(spark, sf):
    return nulled(spark, sf).group_by("event_type").select(lambda g: {"event_type": g.key, "lo": g.min_by("w").event_id, "hi": g.max_by("w").event_id, "hi_user": g.max_by("w").user_id})


@query("""SELECT event_type, sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END)::BIGINT AS growth FROM
(SELECT event_type, v, lag(v) OVER (PARTITION BY event_type ORDER BY ts, v) AS p FROM (SELECT event_type, ts, CAST(floor(value) AS BIGINT) AS v FROM events)) GROUP BY 1""")
def growth_increase(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("v", F.floor("value"))
    return Scan.of(df, ["event_id"]).group_by("event_type").select(lambda g: {"event_type": g.key, "growth": g.ordered_by("ts").increase("v")})


@query("SELECT event_type, first(value ORDER BY ts, value) AS f, last(value ORDER BY ts, value) AS l FROM events GROUP BY 1")
def ordered_first_last(spark, sf):
    return table(spark, sf, "events").group_by("event_type").select(lambda g: {"event_type": g.key, "f": g.ordered_by("ts").first("value"), "l": g.ordered_by("ts").last("value")})


def log_buckets(column: str, source: str, by: str = "") -> str:
    """The log-linear buckets of 64 parts in SQL, for positive values: power and part."""
    return f"SELECT {by} power, part, count(*) AS n FROM (SELECT {by} power, floor(({column} / pow(2, power) - 1) * 64) AS part FROM (SELECT *, floor(log2({column})) AS power FROM {source} WHERE {column} > 0)) GROUP BY ALL"


@query(f"""SELECT l_returnflag, min(pow(2, power) * (1 + (part + 0.5) / 64)) AS median FROM
(SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY power, part) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM ({log_buckets("l_extendedprice", "lineitem", "l_returnflag,")})) WHERE upto > 0.5 * (total - 1) GROUP BY 1""")
def quantile(spark, sf):
    return table(spark, sf, "lineitem").group_by("l_returnflag").select(lambda g: {"l_returnflag": g.key, "median": g.quantile("l_extendedprice", 0.5)})


@query(f"SELECT pow(2, power) * (1 + part / 64) AS lower, n FROM ({log_buckets('o_totalprice', 'orders')})")
def distribution_histogram(spark, sf):
    return table(spark, sf, "orders").distribution("o_totalprice").select("lower", "n")


@query("SELECT l_linestatus, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def own_aggregator(spark, sf):
    out = own_aggregate(table(spark, sf, "lineitem"), {"l_linestatus": "l_linestatus"}, "l_quantity", Welford(), T.DoubleType(), "variance")
    return out.withColumn("variance", F.round("variance", 6))


# -- calendar and buckets ------------------------------------------------------------------


def truncation(unit: str) -> None:
    def run(spark, sf):
        return table(spark, sf, "events").group_by(t=lambda r: r.ts.truncate(unit)).select(lambda g: {"t": g.key, "n": g.count()})

    run.__name__ = f"truncate_{unit}"
    query(f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1")(run)


for _unit in ("minute", "hour", "day", "week", "month", "quarter", "year"):
    truncation(_unit)


@query("SELECT (date_trunc('day', ts + INTERVAL 1 HOUR) - INTERVAL 1 HOUR)::TIMESTAMP AS t, count(*) AS n FROM events GROUP BY 1")
def truncate_tz(spark, sf):
    """The events lie in January, when Paris is an hour ahead."""
    return table(spark, sf, "events").group_by(t=lambda r: r.ts.truncate("day", "Europe/Paris")).select(lambda g: {"t": g.key, "n": g.count()})


@query("SELECT date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS t, count(*) AS n FROM orders GROUP BY 1")
def truncate_date(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("d"))
    return Scan.of(df).group_by(t=lambda r: r.d.truncate("quarter")).select(lambda g: {"t": g.key, "n": g.count()}).withColumn("t", F.col("t").cast("string"))


@query("SELECT count(*) AS n FROM events WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-05' OR date_trunc('hour', ts) > TIMESTAMP '2024-01-20 10:30:00'")
def function_predicate(spark, sf):
    return n(table(spark, sf, "events").where(lambda r: (r.ts.truncate("day") == dt.datetime(2024, 1, 5)) | (r.ts.truncate("hour") > dt.datetime(2024, 1, 20, 10, 30))))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS t, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def bucket_time(spark, sf):
    return table(spark, sf, "events").group_by(t=lambda r: r.ts.bucket(dt.timedelta(minutes=15))).select(lambda g: {"t": g.key, "n": g.count(), "lo": g.min("value"), "hi": g.max("value")})


@query("SELECT (user_id - 70) - (((user_id - 70) % 15 + 15) % 15) AS b, count(*) AS n FROM events GROUP BY 1")
def bucket_int(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") - 70).alias("x"))
    return Scan.of(df).group_by(b=lambda r: r.x.bucket(15)).select(lambda g: {"b": g.key, "n": g.count()})


@query("SELECT floor((value - 50) / 2.5) * 2.5 AS b, count(*) AS n FROM events GROUP BY 1")
def bucket_float(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select((F.col("value") - 50).alias("x"))
    return Scan.of(df).group_by(b=lambda r: r.x.bucket(2.5)).select(lambda g: {"b": g.key, "n": g.count()})


# -- variants ------------------------------------------------------------------------------


def variant_events(spark, sf) -> Scan:
    """props, but every third row holds the number as text, every fifth a nested record."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a.b": {"c": ['), k, F.lit(', true]}, "z": null}'))).otherwise(F.col("props"))
    return Scan.of(df.select("event_id", F.parse_json(text).alias("v")), ["event_id"])


VARIANT = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS is_text, event_id % 3 <> 0 AND event_id % 5 = 0 AS is_nested FROM events"


@query(f"SELECT count(*) FILTER (WHERE k >= 50 AND NOT is_text AND NOT is_nested) AS n, sum(k) FILTER (WHERE NOT is_text AND NOT is_nested)::BIGINT AS total FROM ({VARIANT})")
def variant_as_int(spark, sf):
    return variant_events(spark, sf).aggregate(lambda g: {"n": g.count(lambda r: r.v["k"].as_int64() >= 50), "total": g.sum(g._fields().v["k"].as_int64())})


@query(f"SELECT count(*) FILTER (WHERE k >= 50 AND NOT is_nested) AS n, count(*) FILTER (WHERE is_text) AS texts FROM ({VARIANT})")
def variant_to_int(spark, sf):
    return variant_events(spark, sf).aggregate(lambda g: {"n": g.count(lambda r: r.v["k"].to_int64() >= 50), "texts": g.count(lambda r: r.v["k"].as_string().is_not_null())})


@query(f"SELECT count(*) FILTER (WHERE NOT is_nested) AS k, count(*) FILTER (WHERE is_nested) AS c, count(*) FILTER (WHERE is_nested) AS z, count(*) FILTER (WHERE is_nested AND k > 30) AS first FROM ({VARIANT})")
def variant_has(spark, sf):
    from .grammar import parse

    scan = variant_events(spark, sf)
    return scan.aggregate(lambda g: {"k": g.count(lambda r: r.v["k"].exists()), "c": g.count(lambda r: r.v["a.b"].has("c")), "z": g.count(parse("v['z'] exists", scan.schema)), "first": g.count(parse("v['a.b']['c'][0] > 30", scan.schema))})


@query(f"""SELECT path, class, rows FROM (SELECT '' AS path, 'Object' AS class, count(*) AS rows FROM ({VARIANT}) UNION ALL SELECT 'k', 'Integer', count(*) FROM ({VARIANT}) WHERE NOT is_text AND NOT is_nested
UNION ALL SELECT 'k', 'String', count(*) FROM ({VARIANT}) WHERE is_text UNION ALL SELECT 'a.b', 'Object', count(*) FROM ({VARIANT}) WHERE is_nested UNION ALL SELECT 'a.b/c', 'List', count(*) FROM ({VARIANT}) WHERE is_nested
UNION ALL SELECT 'z', 'Null', count(*) FROM ({VARIANT}) WHERE is_nested)""")
def variant_paths(spark, sf):
    return variant_events(spark, sf).paths("v").select(F.concat_ws("/", "path").alias("path"), "class", "rows")


# -- ordered access ------------------------------------------------------------------------


@query("SELECT (SELECT min(l_quantity) FROM lineitem WHERE l_quantity >= 17.5) AS at_or_after, (SELECT count(*) FROM lineitem WHERE l_quantity < 20) AS rank, (SELECT count(*) FROM lineitem WHERE l_quantity = 20) AS at, (SELECT max(l_quantity) FROM lineitem WHERE l_quantity < (SELECT max(l_quantity) FROM lineitem)) AS before_last")
def key_cursor(spark, sf):
    cursor = table(spark, sf, "lineitem").keys("l_quantity")
    cursor.seek(17.5, AT_OR_AFTER)
    after = cursor.key
    cursor.last()
    cursor.previous_key()
    return spark.createDataFrame([(after, cursor.rank(20.0), cursor.count_at(20.0), cursor.key)], "at_or_after double, rank long, at long, before_last double")


@query("SELECT l_quantity AS key FROM lineitem ORDER BY l_quantity LIMIT 1 OFFSET 1000")
def key_seek_rank(spark, sf):
    cursor = table(spark, sf, "lineitem").keys("l_quantity")
    cursor.seek_rank(1000)
    return spark.createDataFrame([(cursor.key,)], "key double")


@query("SELECT i, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS i, o_orderkey FROM orders)")
def row_key_order(spark, sf):
    """Rows ranked by the bytes of their row keys."""
    from ..operators.scan import numbered

    df = spark.read.parquet(f"{sf}/orders.parquet")
    keyed = df.select("o_orderkey", row_key(df, [KeyColumn("o_totalprice", descending=True, nulls_first=False), KeyColumn("o_orderkey")]).alias("key"))
    return numbered(keyed, [F.col("key")], "i").select("i", "o_orderkey")


# -- parts and estimates -------------------------------------------------------------------

HOURLY = [Measure("n", "count"), Measure("orders", "sum", "l_orderkey"), Measure("mean", "average", "l_extendedprice"), Measure("lo", "min", "l_quantity"), Measure("hi", "max", "l_shipdate"), Measure("median", "quantile", "l_extendedprice", 0.5)]


@query(f"""SELECT a.l_returnflag, n, orders, mean, lo, hi, median FROM
(SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, round(avg(l_extendedprice), 4) AS mean, min(l_quantity) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1) a JOIN ({ORACLE_SQL["quantile"]}) b USING (l_returnflag)""")
def partials_merge(spark, sf):
    """Two halves as partials, one of them over the wire, merged."""
    question = Question({"l_returnflag": "l_returnflag"}, *HOURLY)
    scan = table(spark, sf, "lineitem")
    odd = question.partial(scan.where(lambda r: r.l_linenumber.is_in([1, 3, 5, 7])))
    even = question.partial(scan.where(lambda r: ~r.l_linenumber.is_in([1, 3, 5, 7])))
    sent = Partial.from_bytes(spark, odd.to_bytes())
    return question.merge([sent, even]).withColumn("mean", F.round("mean", 4))


@query("SELECT event_type, count(*)::DOUBLE AS rows, 0.0::DOUBLE AS rows_margin, round(sum(value), 4) AS v, 0.0::DOUBLE AS v_margin, round(avg(value), 4) AS v_mean, 0.0::DOUBLE AS v_mean_margin FROM events GROUP BY 1")
def estimate_exact_tier(spark, sf):
    tiers = list(estimate(table(spark, sf, "events"), {"event_type": "event_type"}, {"v": "value"}, shares=(0.1,), range_rows=64))
    return tiers[-1].answers.withColumns({"v": F.round("v", 4), "v_mean": F.round("v_mean", 4)})


@query()
def estimate_first_tier(spark, sf):
    return next(estimate(table(spark, sf, "lineitem"), {"l_returnflag": "l_returnflag"}, {"q": "l_quantity"}, shares=(0.1,), range_rows=64)).answers


# -- versioned datasets --------------------------------------------------------------------


def orders_dataset(spark, sf, layout: Layout | None = None) -> Dataset:
    """Orders in two appends, in a folder of their own."""
    df = spark.read.parquet(f"{sf}/orders.parquet")
    dataset = Dataset.create(spark, shared_folder(spark), df.schema, layout)
    dataset.append(df.where("o_orderkey % 2 = 0"), [SourceRange("orders", 0, 1)])
    dataset.append(df.where("o_orderkey % 2 = 1"), [SourceRange("orders", 1, 2)])
    return dataset


STATUS = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {} GROUP BY 1"


def by_status(scan: Scan, total: str = "o_totalprice") -> DataFrame:
    return scan.group_by("o_orderstatus").select(lambda g: {"o_orderstatus": g.key, "n": g.count(), "total": g.sum(total)}).withColumn("total", F.round("total", 2))


@query(STATUS.format("orders"))
def table_append(spark, sf):
    return by_status(orders_dataset(spark, sf, Layout(("o_orderdate", "year"), ("o_custkey",))).scan())


@query(STATUS.format("orders WHERE o_orderkey % 2 = 0"))
def table_time_travel(spark, sf):
    dataset = orders_dataset(spark, sf)
    return by_status(Dataset.open(spark, dataset.store.root, 2).scan())


@query(STATUS.format("orders"))
def table_sources_once(spark, sf):
    """A range that is counted already adds nothing."""
    dataset = orders_dataset(spark, sf)
    again = dataset.append(spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 2 = 1"), [SourceRange("orders", 1, 2)])
    assert again.outcome == "AlreadyThere" and dataset.source_offset("orders") == 2
    return by_status(dataset.scan())


@query(STATUS.format("orders WHERE NOT (o_custkey < 500 AND o_orderstatus = 'F')"))
def table_delete(spark, sf):
    dataset = orders_dataset(spark, sf, Layout(sort_key=("o_custkey",)))
    dataset.delete(lambda r: (r.o_custkey < 500) & (r.o_orderstatus == "F"))
    return by_status(dataset.scan())


@query(STATUS.format("orders WHERE NOT o_custkey < 300 AND o_orderkey % 10 <> 3"))
def table_delete_marked(spark, sf):
    dataset = orders_dataset(spark, sf, Layout(sort_key=("o_custkey",)))
    dataset.delete(lambda r: r.o_custkey < 300, mark=True)
    keys = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 10 = 3").select("o_orderkey")
    dataset.delete_in("o_orderkey", keys, mark=True)
    maintenance.compact(dataset, target_rows=1 << 20)
    return by_status(dataset.scan())


@query(STATUS.format("(SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_custkey >= 700 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)"))
def table_update(spark, sf):
    dataset = orders_dataset(spark, sf)
    dataset.update(lambda r: (r.o_orderstatus == "O") & (r.o_custkey >= 700), {"o_totalprice": lambda c: c("o_totalprice") + 1})
    return by_status(dataset.scan())


@query("SELECT o_orderstatus AS state, count(*) AS n, count(*) FILTER (WHERE added) AS known FROM (SELECT o_orderstatus, false AS added FROM orders UNION ALL SELECT o_orderstatus, true FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def table_evolve(spark, sf):
    """A column renamed and one added: rows from before read it as null."""
    dataset = orders_dataset(spark, sf)
    old = dataset.schema
    new = T.StructType([*(T.StructField("state", f.dataType) if f.name == "o_orderstatus" else f for f in old), T.StructField("score", T.IntegerType())])
    dataset.evolve(new, {"state": "o_orderstatus"})
    more = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 = 0").withColumnRenamed("o_orderstatus", "state").withColumn("score", F.lit(5))
    dataset.append(more)
    return dataset.scan().group_by("state").select(lambda g: {"state": g.key, "n": g.count(), "known": g.count(lambda r: r.score == 5)})


@query(STATUS.format("orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"))
def table_expire(spark, sf):
    """Whole years go by their summaries; nothing is read."""
    dataset = orders_dataset(spark, sf, Layout(("o_orderdate", "year"), ("o_orderdate",)))
    dataset.expire(lambda r: r.o_orderdate < dt.datetime(1997, 1, 1))
    return by_status(dataset.scan())


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey BETWEEN 100 AND 200 GROUP BY 1")
def table_pruned_scan(spark, sf):
    return by_status(orders_dataset(spark, sf, Layout(sort_key=("o_custkey",))).scan(where=lambda r: r.o_custkey.between(100, 200)))


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS rows, true AS may, false AS may_not, 0::BIGINT AS findings, true AS fewer, true AS same_change")
def table_compaction(spark, sf):
    dataset = orders_dataset(spark, sf, Layout(sort_key=("o_custkey",)))
    before, changed = dataset.object_count, dataset.last_data_change
    maintenance.compact(dataset, target_rows=1 << 20)
    maintenance.consolidate(dataset, None)
    maintenance.vacuum(dataset, keep_versions=1, older_than_s=0)
    findings = maintenance.verify(dataset).count()
    return spark.createDataFrame([(dataset.scan().count(), dataset.may_match(lambda r: r.o_custkey == 5), dataset.may_match(lambda r: r.o_custkey == -5), findings, dataset.object_count < before, dataset.last_data_change == changed)], "rows long, may boolean, may_not boolean, findings long, fewer boolean, same_change boolean")


@query("SELECT o_orderstatus, count(*) AS rows, sum(o_custkey)::BIGINT AS o_custkey FROM orders GROUP BY 1")
def table_rollup(spark, sf):
    dataset = orders_dataset(spark, sf)
    return maintenance.Rollup(dataset, "status", ["o_orderstatus", "o_orderpriority"], ["o_custkey"]).ask("o_orderstatus")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def table_set(spark, sf):
    whole = orders_dataset(spark, sf)
    half = Dataset.open(spark, whole.store.root, 2)
    return by_status(DatasetSet(whole, half).scan())


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders) GROUP BY 1")
def table_import(spark, sf):
    dataset = orders_dataset(spark, sf)
    dataset.import_file(f"{sf}/orders.parquet")
    return by_status(dataset.scan())


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1")
def table_ask_by_values(spark, sf):
    dataset = orders_dataset(spark, sf, Layout(("o_orderdate", "year")))
    return spark.createDataFrame([(int(value[:4]), answer) for value, answer, _ in dataset.ask_by_values(lambda scan: scan.count())], "year long, n long")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1")
def stream_ingest(spark, sf):
    """Files as a stream into a dataset, each batch counted once."""
    folder = shared_folder(spark)
    df = spark.read.parquet(f"{sf}/events.parquet")
    df.repartition(3).write.parquet(f"{folder}/in")
    dataset = Dataset.create(spark, f"{folder}/dataset", df.schema)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.files_stream(spark, f"{folder}/in", df.schema, 1), dataset.store.root, "events", f"{folder}/checkpoint", once=True).awaitTermination()
    dataset.refresh()
    out = dataset.scan().group_by("event_type").select(lambda g: {"event_type": g.key, "n": g.count(), "v": g.sum("value")})
    return out.withColumn("v", F.round("v", 4))


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS rows, 'GZIP' AS codec, count(*)::BIGINT AS n FROM part WHERE p_size = 7")
def write_parquet(spark, sf):
    path = f"{shared_folder(spark)}/part"
    report = files.write(spark.read.parquet(f"{sf}/part.parquet"), path, codec="gzip", bloom=["p_size"], sort=["p_size"], files=2)
    codec = files.metadata(spark, path).select("codec").distinct().first()[0]
    n = Scan.parquet(spark, path).where(lambda r: r.p_size == 7).count()
    return spark.createDataFrame([(report.rows, codec, n)], "rows long, codec string, n long")
