"""More of the catalogue: kinds of values, ways of delivery, refusals, and the upkeep of datasets."""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as schemas
from ..errors import EngineError, FilterSyntaxError, QueryError, SchemaError, TooManyValuesError
from ..functions import variant
from ..functions.predicates import tuple_in
from ..operators.scan import Scan
from ..sources import files, maintenance
from ..sources.dataset import DATA, Dataset, DatasetSet, Layout
from ..sources.shared import shared_folder
from ..streaming import ingest
from .catalogue import NULLED, STATUS, by_status, n, nulled, orders_dataset, query, table

# -- predicates and semi-joins ---------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus, l_linenumber) IN (('A', 'F', 1), ('R', 'F', 3), ('N', 'O', 5))")
def tuple_in3(spark, sf):
    return n(table(spark, sf, "lineitem").where(lambda r: tuple_in([r.l_returnflag, r.l_linestatus, r.l_linenumber], [("A", "F", 1), ("R", "F", 3), ("N", "O", 5), ("N", None, 5)])))


@query("SELECT count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus, l_linenumber, l_quantity) IN (('A', 'F', 1, 10), ('R', 'F', 3, 20), ('N', 'O', 5, 30))")
def tuple_in4(spark, sf):
    return n(table(spark, sf, "lineitem").where(lambda r: tuple_in([r.l_returnflag, r.l_linestatus, r.l_linenumber, r.l_quantity], [("A", "F", 1, 10.0), ("R", "F", 3, 20.0), ("N", "O", 5, 30.0), ("N", "O", 5, float("nan"))])))


@query("SELECT count(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_quantity = 50 AND m.l_returnflag = l.l_returnflag AND m.l_linenumber = l.l_linenumber AND m.l_suppkey = l.l_suppkey)")
def semi_join_tuple3(spark, sf):
    items, key = table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_suppkey"]
    return n(items.where_in(key, items.where(lambda r: r.l_quantity == 50).select(*key)))


@query("SELECT count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_quantity > 30 AND m.l_returnflag = l.l_returnflag AND m.l_linestatus = l.l_linestatus AND m.l_linenumber = l.l_linenumber AND m.l_suppkey = l.l_suppkey)")
def anti_in_tuple4(spark, sf):
    items, key = table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    return n(items.where_in(key, items.where(lambda r: r.l_quantity > 30).select(*key), negated=True))


@query("SELECT count(*) FILTER (WHERE s IS NULL) AS gone, count(*) FILTER (WHERE s IS NOT NULL) AS there, count(*) FILTER (WHERE s.y IS NULL) AS no_field FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE {'y': CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END} END AS s FROM events)")
def struct_null(spark, sf):
    s = F.when(F.col("event_id") % 3 != 0, F.struct(F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("y")))
    scan = Scan.of(spark.read.parquet(f"{sf}/events.parquet").select(s.alias("s")))
    return scan.aggregate(lambda g: {"gone": g.count(lambda r: r.s.is_null()), "there": g.count(lambda r: r.s.is_not_null()), "no_field": g.count(lambda r: r.s.y.is_null())})


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderstatus = 'F' AND o_totalprice > 1000.5 AND o_custkey IN (1, 2, 3, 40, 500)")
def text_parameters(spark, sf):
    """Typed values in the places of a text filter."""
    return n(table(spark, sf, "orders").where("o_orderdate >= ?0 and o_orderstatus = ?1 and o_totalprice > ?2 and o_custkey in (?3, 2, 3, 40, 500)", dt.datetime(1996, 3, 1), "F", 1000.5, 1))


# -- rows and their delivery -------------------------------------------------------------------


@query("SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_custkey DESC, o_orderkey DESC LIMIT 25")
def order_several(spark, sf):
    return table(spark, sf, "orders", "o_orderstatus", "o_custkey", "o_orderkey").in_order("o_orderstatus", "o_custkey", "o_orderkey", descending=True).take(25).df


@query("SELECT count(*)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS keys, true AS bounded FROM orders WHERE o_totalprice > 100000")
def batches_of_rows(spark, sf):
    """Arrow batches of at most 100 rows, one after another."""
    rows = keys = most = 0
    for batch in table(spark, sf, "orders").where(lambda r: r.o_totalprice > 100_000).select("o_orderkey").batches(rows=100, ahead=True):
        rows, keys, most = rows + batch.num_rows, keys + sum(batch.column(0).to_pylist()), max(most, batch.num_rows)
    return spark.createDataFrame([(rows, keys, most <= 100)], "rows long, keys long, bounded boolean")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 2")
def records_one_by_one(spark, sf):
    scan = table(spark, sf, "nation").where(lambda r: r.n_regionkey == 2).select(k="n_nationkey", name="n_name")
    return spark.createDataFrame([tuple(r) for r in scan.records()], scan.schema)


@query("SELECT o_totalprice AS value FROM orders ORDER BY o_totalprice LIMIT 12")
def values_in_order(spark, sf):
    values = table(spark, sf, "orders").order_by("o_totalprice").take(12).select("o_totalprice").to_list()
    return spark.createDataFrame([(v,) for v in values], "value double")


@query("SELECT count(*)::BIGINT AS rows, true AS pushed, true AS narrow FROM orders WHERE o_custkey < 100")
def explain_and_observe(spark, sf):
    """What the plan says it pushes and reads, and the rows counted as it ran."""
    scan = table(spark, sf, "orders").where(lambda r: r.o_custkey < 100).select("o_orderkey")
    plan = scan.explain()
    df, seen = scan.observed("orders")
    df.write.format("noop").mode("overwrite").save()
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    return spark.createDataFrame([(seen.get["rows"], "LessThan(o_custkey,100)" in plan, "o_comment" not in read and "o_totalprice" not in read)], "rows long, pushed boolean, narrow boolean")


# -- groups and aggregates ----------------------------------------------------------------------


@query("SELECT k + 0.0 AS k, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN -0.0 WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE floor(value / 10) END AS k FROM events) GROUP BY 1")
def group_float_key(spark, sf):
    """NaNs are one key, and both zeros."""
    m = F.col("event_id") % 5
    k = F.when(m == 0, float("nan")).when(m == 1, F.lit(-0.0)).when(m == 2, F.lit(0.0)).when(m == 4, F.floor(F.col("value") / 10).cast("double"))
    return Scan.of(spark.read.parquet(f"{sf}/events.parquet").select(k.alias("k"))).group_by("k").select(lambda g: {"k": g.key, "n": g.count()})


@query("SELECT l_linenumber, count(DISTINCT l_returnflag || l_linestatus) AS few, count(DISTINCT l_quantity) AS some FROM lineitem GROUP BY 1")
def approx_distinct_of_few(spark, sf):
    """Exact as long as there are few values."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("f", F.concat("l_returnflag", "l_linestatus"))
    return Scan.of(df).group_by("l_linenumber").select(lambda g: {"l_linenumber": g.key, "few": g.approximate_count_distinct("f"), "some": g.approximate_count_distinct("l_quantity")})


@query(f"SELECT sum(w) FILTER (WHERE w = 1e9) IS NULL AS none, round(max(value), 6) AS top FROM ({NULLED})")
def answers_of_nothing(spark, sf):
    out = nulled(spark, sf).aggregate(lambda g: {"none": g.where(lambda r: r.w == 1e9).max("w"), "top": g.max("value")})
    return out.select(F.col("none").isNull().alias("none"), F.round("top", 6).alias("top"))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1")
def group_suppkey(spark, sf):
    out = table(spark, sf, "lineitem").group_by("l_suppkey").select(lambda g: {"l_suppkey": g.key, "n": g.count(), "q": g.sum("l_quantity")})
    return out.withColumn("q", F.round("q", 4))


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def group_orderkey(spark, sf):
    return table(spark, sf, "lineitem").group_by("l_orderkey").select(lambda g: {"l_orderkey": g.key, "n": g.count(), "last": g.max("l_linenumber")})


@query("SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def group_six_keys(spark, sf):
    keys = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return table(spark, sf, "lineitem").group_by(*keys).select(lambda g: {**{k: g.key[i] for i, k in enumerate(keys)}, "n": g.count()})


@query("SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS largest, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem")
def least_and_largest(spark, sf):
    return table(spark, sf, "lineitem").aggregate(lambda g: {"least": g.min("l_extendedprice"), "largest": g.max("l_extendedprice"), "first_day": g.min("l_shipdate"), "last_day": g.max("l_shipdate")})


# -- variants -----------------------------------------------------------------------------------


def readings(spark, sf) -> Scan:
    """A variant of a double, a text, a truth, an instant, a whole number, a decimal, bytes and a date."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    built = F.struct(F.col("value").alias("d"), F.col("event_type").alias("s"), (F.col("value") > 50).alias("b"), F.col("ts").cast("timestamp").alias("t"), F.col("user_id").alias("i"), F.col("value").cast("decimal(10,2)").alias("m"), F.col("event_type").cast("binary").alias("x"), F.col("ts").cast("date").alias("y"))
    return Scan.of(df.select("event_id", variant.build(built).alias("v")), ["event_id"])


@query("""SELECT round(sum(value), 4) AS doubles, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS truths, max(ts)::TIMESTAMP AS latest, round(sum(user_id)::DOUBLE, 4) AS converted,
0::BIGINT AS of_another_class FROM events""")
def variant_reads(spark, sf):
    v = variant.Path
    scan = readings(spark, sf)
    out = scan.aggregate(lambda g: {
        "doubles": g.sum(v(scan.fields.v, ("d",)).as_double()), "clicks": g.count(lambda r: v(r.v, ("s",)).as_string() == "click"), "truths": g.count(lambda r: v(r.v, ("b",)).as_bool().is_true()),
        "latest": g.max(v(scan.fields.v, ("t",)).as_timestamp()), "converted": g.sum(v(scan.fields.v, ("i",)).to_double()), "of_another_class": g.count(lambda r: v(r.v, ("s",)).as_double().is_not_null()),
    })
    return out.withColumns({"doubles": F.round("doubles", 4), "converted": F.round("converted", 4), "latest": F.col("latest").cast("timestamp_ntz")})


@query("SELECT sum(value::DECIMAL(10,2))::DOUBLE AS money, count(*) FILTER (WHERE event_type = 'click') AS bytes, count(DISTINCT ts::DATE) AS days FROM events")
def variant_values(spark, sf):
    v = variant.Path
    scan = readings(spark, sf)
    read = scan.select(m=lambda r: v(r.v, ("m",)).value_as("decimal"), x=lambda r: v(r.v, ("x",)).value_as("binary"), y=lambda r: v(r.v, ("y",)).value_as("date")).df
    return read.agg(F.sum("m").cast("double").alias("money"), F.count_if(F.col("x") == F.lit(b"click")).alias("bytes"), F.countDistinct("y").alias("days"))


@query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def variant_json(spark, sf):
    """JSON of a built variant, read again, holds what was built."""
    df = spark.read.parquet(f"{sf}/nation.parquet").select("n_regionkey", variant.build(F.struct("n_name", "n_regionkey")).alias("v"))
    again = df.select("n_regionkey", variant.from_json(variant.to_json(F.col("v"))).alias("v"))
    return n(Scan.of(again).where(lambda r: variant.Path(r.v, ("n_regionkey",)).as_int64() == 1))


@query("SELECT event_type AS s, round(sum(value), 4) AS total FROM events GROUP BY 1")
def variant_side_columns(spark, sf):
    df = variant.side_columns(readings(spark, sf).df, "v", {"s": (("s",), "AsString"), "d": (("d",), "AsDouble")})
    out = Scan.of(df).group_by("s").select(lambda g: {"s": g.key, "total": g.sum("d")})
    return out.withColumn("total", F.round("total", 4))


# -- files ----------------------------------------------------------------------------------------


@query("SELECT codec, (SELECT count(*) FROM supplier)::BIGINT AS rows, 0::BIGINT AS findings FROM (VALUES ('UNCOMPRESSED'), ('SNAPPY'), ('GZIP'), ('ZSTD'), ('LZ4')) AS c(codec)")
def parquet_codecs(spark, sf):
    """Written, verified and read again by each codec, with pages of the second version."""
    out = []
    for codec in ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw"):
        path = f"{shared_folder(spark)}/supplier"
        files.write(spark.read.parquet(f"{sf}/supplier.parquet"), path, codec=codec, page_version=2, files=1)
        told = files.metadata(spark, path).select("codec").distinct().first()[0]
        out.append((told.replace("LZ4_RAW", "LZ4"), Scan.parquet(spark, path).count(), len(files.verify(spark, path))))
    return spark.createDataFrame(out, "codec string, rows long, findings long")


@query("SELECT 1::BIGINT AS removed, count(*)::BIGINT AS rows FROM region")
def parquet_repair(spark, sf):
    """A torn append goes, the rest stays."""
    path = f"{shared_folder(spark)}/region"
    files.write(spark.read.parquet(f"{sf}/region.parquet"), path, files=1)
    spark.range(1).select(F.lit("torn").alias("value")).coalesce(1).write.mode("append").text(path)
    torn = files.Store(spark, path)
    name = next(x for x, _, _ in torn.list("") if x.endswith(".txt"))
    torn.put(name.replace(".txt", ".parquet"), "torn")
    torn.delete(name)
    return spark.createDataFrame([(len(files.repair(spark, path)), Scan.parquet(spark, path).count())], "removed long, rows long")


@query("SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS cents FROM orders WHERE o_orderkey < 100")
def extension_type(spark, sf):
    """Money of one's own over a stored whole number."""
    schemas.register_extension("cents", T.LongType(), lambda stored: decimal.Decimal(stored) / 100, lambda value: int(value * 100))
    field = schemas.extension("cents", "cents")
    df = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 100").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents", metadata=field.metadata))
    rows = [(r.k, schemas.write_value(df.schema["cents"], schemas.read_value(df.schema["cents"], r.cents))) for r in df.collect()]
    return spark.createDataFrame(rows, "k long, cents long")


# -- refusals -----------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('no such column', 'SchemaError'), ('a text for a number', 'SchemaError'), ('broken text', 'FilterSyntaxError'), ('rows of rows', 'QueryError'), ('rows in order', 'QueryError'), ('an aggregate in a filter of rows', 'QueryError'), ('too many values', 'TooManyValuesError')) AS x(what, error)")
def refusals(spark, sf):
    """Questions without a meaning are refused before any row is read, each by its class."""
    scan = table(spark, sf, "orders")
    asked = {
        "no such column": (SchemaError, lambda: scan.where(lambda r: r.o_nothing == 1)),
        "a text for a number": (SchemaError, lambda: scan.where(lambda r: r.o_custkey == "x")),
        "broken text": (FilterSyntaxError, lambda: scan.where("o_custkey > (3")),
        "rows of rows": (QueryError, lambda: scan.rows(0, 5).rows(0, 2)),
        "rows in order": (QueryError, lambda: scan.rows(0, 5).order_by("o_custkey")),
        "an aggregate in a filter of rows": (QueryError, lambda: scan.group_by("o_custkey").where(lambda g: scan.where(g.count() > 3))),
        "too many values": (TooManyValuesError, lambda: scan.where_in("o_orderkey", scan.select("o_orderkey"), most=3)),
    }
    out = []
    for what, (_, ask) in asked.items():
        try:
            found = ask()
            if hasattr(found, "select"):
                found.select(lambda g: {"k": g.key})
            out.append((what, "none"))
        except EngineError as error:
            out.append((what, type(error).__name__))
    return spark.createDataFrame(out, "what string, error string")


# -- streams --------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY ALL")
def stream_closing_groups(spark, sf):
    """Days of a stream, given out once no row may come for them any more."""
    folder = shared_folder(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").repartition(1).write.parquet(f"{folder}/in")
    stream = ingest.files_stream(spark, f"{folder}/in", schema).withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))"))
    closed = ingest.closing_groups(stream, "ts", "1 day", "6 hours", "event_type", n=F.count("*"))
    closed = closed.withColumn("bucket", F.convert_timezone(F.lit(spark.conf.get("spark.sql.session.timeZone")), F.lit("UTC"), F.col("bucket").cast("timestamp_ntz")))
    closed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{folder}/out").select("bucket", "event_type", "n")


# -- walks ----------------------------------------------------------------------------------------


@query(f"""SELECT (SELECT w FROM t ORDER BY w LIMIT 1) AS least, (SELECT w FROM t WHERE w > 50 ORDER BY w LIMIT 1) AS after, (SELECT count(*) FROM t WHERE w < 50) AS below, (SELECT w FROM t ORDER BY w, event_id LIMIT 1 OFFSET 500) AS ranked
FROM (SELECT 1), (SELECT 1) LIMIT 1""".replace("FROM t", f"FROM (SELECT * FROM ({NULLED}) WHERE w IS NOT NULL AND NOT isnan(w))"))
def key_cursor_floats(spark, sf):
    """NaNs lie above all numbers, nulls nowhere."""
    cursor = nulled(spark, sf).keys("w")
    cursor.first()
    least = cursor.key
    cursor.seek(50.0, "after")
    after = cursor.key
    below = cursor.rank(50.0)
    cursor.seek_rank(500)
    return spark.createDataFrame([(least, after, below, cursor.key)], "least double, after double, below long, ranked double")


# -- datasets -------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS rows, true AS sized, true AS names")
def table_objects(spark, sf):
    """The list of objects counts the rows."""
    dataset = orders_dataset(spark, sf)
    listed = dataset.object_table()
    told = listed.agg(F.sum("rows").alias("rows"), F.min("bytes").alias("least"), F.countDistinct("key").alias("names")).first()
    return spark.createDataFrame([(told.rows, told.least > 0, told.names == dataset.object_count)], "rows long, sized boolean, names boolean")


@query(STATUS.format("(SELECT o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 = 1)"))
def table_replace_objects(spark, sf):
    """The objects of the second append go for other rows; said twice, it is done once."""
    dataset = orders_dataset(spark, sf)
    second = sorted({o.key for o in dataset.objects()} - {o.key for o in Dataset.open(spark, dataset.store.root, 2).objects()})
    rows = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 4 = 1")
    assert dataset.replace_objects(second, rows).outcome == "Applied"
    assert dataset.replace_objects(second, rows).outcome == "AlreadyThere"
    return by_status(dataset.scan())


@query(STATUS.format("orders WHERE o_orderkey % 2 = 0"))
def table_remove_objects(spark, sf):
    dataset = orders_dataset(spark, sf)
    dataset.remove_objects({o.key for o in dataset.objects()} - {o.key for o in Dataset.open(spark, dataset.store.root, 2).objects()})
    return by_status(dataset.scan())


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey IN (1, 3, 7, 32, 33) GROUP BY 1")
def table_index(spark, sf):
    """Bloom filters put on a column afterwards."""
    dataset = orders_dataset(spark, sf)
    maintenance.index(dataset, "o_orderkey")
    return by_status(dataset.scan(where=lambda r: r.o_orderkey.is_in([1, 3, 7, 32, 33])))


@query(STATUS.format("orders WHERE o_custkey >= 60"))
def table_erase(spark, sf):
    """Rows that are gone from the files as well."""
    dataset = orders_dataset(spark, sf)
    maintenance.erase(dataset, lambda r: r.o_custkey < 60)
    left = spark.read.parquet(*(dataset.store.path(name) for name, _, _ in dataset.store.list(DATA, deep=True) if name.endswith(".parquet")))
    assert left.count() == dataset.row_count
    return by_status(dataset.scan())


@query("SELECT count(*)::BIGINT AS rows, 'o_custkey' AS advised, true AS calm FROM orders")
def table_upkeep(spark, sf):
    """A loop of compactions that comes to rest, and the column that a layout should sort by."""
    dataset = orders_dataset(spark, sf)
    advised = maintenance.advice(dataset, [lambda r: r.o_custkey < 10, lambda r: r.o_custkey == 5, lambda r: r.o_totalprice > 1e9])[0][0]
    done = maintenance.run_compaction(dataset, 3, target_rows=1 << 20)
    return spark.createDataFrame([(dataset.row_count, advised, done[-1].outcome == "AlreadyThere")], "rows long, advised string, calm boolean")


@query("SELECT count(*)::BIGINT AS rows, true AS apart, true AS sorted FROM orders")
def table_levels(spark, sf):
    """Leveled compaction: objects of a level above the first share no key."""
    dataset = orders_dataset(spark, sf, Layout(sort_key=("o_custkey",)))
    maintenance.compact_levels(dataset, target_rows=max(1, dataset.row_count // 4))
    ranges = sorted(dataset._summaries(o)["o_custkey"][:2] for o in dataset.objects() if o.level == 1)
    return spark.createDataFrame([(dataset.scan().count(), len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False)), maintenance.verify(dataset).isEmpty())], "rows long, apart boolean, sorted boolean")


@query("SELECT count(*)::BIGINT + (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0)::BIGINT AS rows, 'Abandoned' AS late FROM orders")
def table_two_writers(spark, sf):
    """Two handles of one dataset: both appends are there, and what rests on a version that went is abandoned."""
    one = orders_dataset(spark, sf)
    two = Dataset.open(spark, one.store.root)
    keys = [o.key for o in two.objects()][:2]
    one.append(spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 5 = 0"))
    one.remove_objects(keys[:1])
    late = two.replace_objects(keys, None)
    gone = Dataset.open(spark, one.store.root, 3)
    lost = {o.key: o.rows for o in gone.objects()}[keys[0]]
    two.refresh()
    return spark.createDataFrame([(two.row_count + lost, late.outcome)], "rows long, late string")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders) WHERE o_totalprice > 200000")
def table_set_refresh(spark, sf):
    whole = orders_dataset(spark, sf)
    both = DatasetSet(Dataset.open(spark, whole.store.root, 2), Dataset.open(spark, whole.store.root))
    return n(both.scan().where(lambda r: r.o_totalprice > 200_000))
