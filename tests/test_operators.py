"""Aggregates, groups, cursors, row keys, parts, estimates."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import schema as schemas
from sparkloom.errors import EngineError, QueryError, SchemaError, TooManyValuesError, UnsupportedError
from sparkloom.functions.rowkey import KeyColumn, encode, row_key
from sparkloom.operators import cursor as cursors
from sparkloom.operators.scan import Scan
from sparkloom.operators.udaf import Welford, aggregate
from sparkloom.plans.estimate import estimate
from sparkloom.plans.partials import Measure, Partial, Question

NAN = float("nan")


def points(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.randrange(50), rng.choice([None, NAN, 0.0, -0.0, 1e16, -1e16, 1.0, 0.1, 3.3]), rng.randrange(-(2**62), 2**62)) for i in range(n)]


SCHEMA = "id long, k string, e int, x double, big long"


@pytest.fixture(scope="module")
def scan(spark):
    return Scan.of(spark.createDataFrame(points(), SCHEMA).repartition(7), ["id"])


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_aggregates_against_python(scan):
    got = {r.k: r for r in scan.group_by("k").select(lambda g: {"k": g.key, "n": g.count(), "s": g.sum("x", exact=True), "lo": g.min("x"), "hi": g.max("x"), "mean": g.average("e"), "v": g.variance("e"), "d": g.count_distinct("x"), "f": g.first().x, "l": g.last().x, "mb": g.max_by("x").id, "mi": g.min_by("x").id, "any": g.any(lambda r: r.x > 2), "all": g.all(lambda r: r.e >= 0), "allx": g.all(lambda r: r.x > -1e20), "inc": g.ordered_by("e").increase("x"), "of": g.ordered_by("e").first("x"), "ol": g.ordered_by("e").last("x"), "q": g.quantile("e", 0.5), "ad": g.approximate_count_distinct("e")}).collect()}
    for k, rows in by_key(points()).items():
        r, some = got[k], [p[3] for p in rows if p[3] is not None and p[3] == p[3]]
        assert r.n == len(rows) and r.s == math.fsum(some)
        assert r.lo == min(some) and r.hi == max(some)
        assert r.mean == pytest.approx(sum(p[2] for p in rows) / len(rows))
        mean = sum(p[2] for p in rows) / len(rows)
        assert r.v == pytest.approx(sum((p[2] - mean) ** 2 for p in rows) / (len(rows) - 1))
        assert r.d == len(set(some)) + any(p[3] != p[3] for p in rows if p[3] is not None)
        first, last = rows[0][3], rows[-1][3]
        assert (r.f == first or (first != first and r.f != r.f)) and (r.l == last or (last != last and r.l != r.l))
        valid = [p for p in rows if p[3] is not None and p[3] == p[3]]
        assert r.mb == min(valid, key=lambda p: (-p[3], p[0]))[0] and r.mi == min(valid, key=lambda p: (p[3], p[0]))[0]
        assert r["any"] == any(v > 2 for v in some) and r["all"] and not r.allx
        order = sorted((p[2], p[3] + 0.0) for p in valid)
        growth = sum(b - a if b >= a else b for (_, a), (_, b) in zip(order, order[1:]))  # noqa: B905
        assert r.inc == pytest.approx(growth, rel=1e-9) and (r.of, r.ol) == (order[0][1], order[-1][1])
        e = sorted(p[2] for p in rows)
        assert r.q == pytest.approx(e[math.floor(0.5 * (len(e) - 1))] or 0, rel=0.05, abs=0.01) or r.q == pytest.approx(e[math.ceil(0.5 * (len(e) - 1))], rel=0.05)
        assert abs(r.ad - len(set(e))) <= 2


def test_zeros_have_an_order(spark):
    for rows in ([0.0, -0.0], [-0.0, 0.0], [-0.0, NAN, 0.0]):
        r = Scan.of(spark.createDataFrame([(v,) for v in rows], "x double").coalesce(1)).aggregate(lambda g: {"lo": g.min("x"), "hi": g.max("x"), "d": g.count_distinct("x")}).first()
        assert math.copysign(1, r.lo) == -1 and math.copysign(1, r.hi) == 1 and r.d == 1 + any(v != v for v in rows)


def test_long_sums_overflow_only_at_the_end(spark):
    top = 2**63 - 1
    scan = Scan.of(spark.createDataFrame([(top,), (top,), (-top,), (-5,)], "v long"))
    assert scan.sum("v") == top - 5
    with pytest.raises(Exception, match="(?i)overflow"):
        Scan.of(spark.createDataFrame([(top,), (1,)], "v long")).sum("v")
    assert scan.aggregate(lambda g: {"s": g.sum(scan.fields.v.as_int128())}).first().s == top - 5
    assert Scan.of(spark.createDataFrame([], "v long")).sum("v") == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_same_bits_however_cut(spark, parts):
    rng = random.Random(parts)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(500)] + [5e-324, -5e-324 * 3, 1e-310]
    want = math.fsum(values)
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    assert struct.pack("d", Scan.of(df).sum("x", exact=True)) == struct.pack("d", want)


@pytest.mark.parametrize("parts", ["1", "5"])
def test_growth_however_cut(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(300), rng.randrange(100)) for _ in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.k: r.g for r in Scan.of(spark.createDataFrame(rows, "k string, e int, v long")).group_by("k").select(lambda g: {"k": g.key, "g": g.ordered_by("e").increase("v")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in "ab":
        order = sorted((e, v) for c, e, v in rows if c == k)
        assert got[k] == sum(b - a if b >= a else b for (_, a), (_, b) in zip(order, order[1:]))  # noqa: B905


def test_example_growth(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([100, 130, 160, 5, 20])], "e int, v long")
    r = Scan.of(df).aggregate(lambda g: {"g": g.ordered_by("e").increase("v"), "none": g.where(lambda r: r.v > 999).ordered_by("e").increase("v"), "one": g.where(lambda r: r.v > 150).ordered_by("e").increase("v")}).first()
    assert (r.g, r.none, r.one) == (80, None, 0)


def test_quantiles_of_a_column_share_one_histogram(spark):
    rows = [(i % 3, float(i), None if i % 3 == 2 else float(-i)) for i in range(300)]
    scan = Scan(spark.createDataFrame(rows, "k int, x double, y double"))
    few = scan.group_by("k").select(lambda g: {"k": g.key, "a": g.quantile("x", 0.5)})
    many = scan.group_by("k").select(lambda g: {"k": g.key, "a": g.quantile("x", 0.5), "b": g.quantile("x", 0.0), "c": g.quantile("x", 1.0)})
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (few, many)]
    assert shuffles[0] == shuffles[1]
    apart = {r.k: r for r in scan.group_by("k").select(lambda g: {"k": g.key, "a": g.quantile("x", 0.5), "y": g.quantile("y", 0.5), "rough": g.quantile("x", 1.0, 0.3), "late": g.where(lambda r: r.x > 150).quantile("x", 0.0), "none": g.where(lambda r: r.x > 999).quantile("x", 0.5)}).collect()}
    for r in many.collect():
        own = [x for k, x, _ in rows if k == r.k]
        for got, q in ((r.a, 0.5), (r.b, 0.0), (r.c, 1.0), (apart[r.k].a, 0.5)):
            assert abs(got - own[math.floor(q * (len(own) - 1))]) <= 0.01 * got
        assert (apart[r.k].y is None) == (r.k == 2) and apart[r.k].none is None
        assert abs(apart[r.k].rough - own[-1]) <= 0.3 * own[-1] and abs(apart[r.k].late - min(x for x in own if x > 150)) <= 2


def test_quantiles_are_near(spark):
    rng = random.Random(5)
    values = [rng.lognormvariate(0, 3) * rng.choice([1, 1, -1]) for _ in range(4000)] + [0.0] * 50
    scan = Scan.of(spark.createDataFrame([(v,) for v in values], "x double"))
    values.sort()
    for q in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
        got, want = scan.aggregate(lambda g: {"q": g.quantile("x", q)}).first().q, values[math.floor(q * (len(values) - 1))]  # noqa: B023
        near = [v for v in values[max(0, math.floor(q * (len(values) - 1)) - 1) : math.ceil(q * (len(values) - 1)) + 2]]
        assert any(abs(got - v) <= 0.0079 * abs(v) + 1e-300 for v in [want, *near])
    assert scan.distribution("x").agg(F.sum("n")).first()[0] == len(values)


def test_group_steps_in_written_order(scan):
    base = scan.group_by("e").order_by(lambda g: g.count(), descending=True).then_by(lambda g: g.key)
    ask = lambda g: {"e": g.key, "n": g.count()}
    every = base.select(ask).collect()
    assert [tuple(r) for r in every] == sorted((tuple(r) for r in every), key=lambda r: (-r[1], r[0]))
    assert base.take(10).where(lambda g: g.key > 20).select(ask).collect() == [r for r in every[:10] if r.e > 20]
    assert base.where(lambda g: g.key > 20).take(10).select(ask).collect() == [r for r in every if r.e > 20][:10]
    assert base.skip(3).take(4).select(ask).collect() == every[3:7]
    nulls = scan.group_by("k").order_by(lambda g: g.key, descending=True).select(lambda g: {"k": g.key}).collect()
    assert [r.k for r in nulls] == ["b", "a", None]


def test_refusals(scan, spark):
    with pytest.raises(QueryError):
        scan.order_by("e").rows(0, 3)
    with pytest.raises(QueryError):
        scan.rows(0, 3).rows_at(1)
    with pytest.raises(QueryError):
        scan.group_by("k").text("count()", "count()")
    with pytest.raises(QueryError):
        Scan.of(spark.range(3)).aggregate(lambda g: {"x": g.first().id})
    with pytest.raises(SchemaError):
        scan.aggregate(lambda g: {"x": g.sum("k")})
    with pytest.raises(QueryError):
        scan.aggregate(lambda g: {"x": g.sum(g.count())})
    with pytest.raises(TooManyValuesError):
        scan.where_in("id", scan.select("id"), most=5)
    with pytest.raises(SchemaError):
        scan.where_in("k", scan.select("id"))
    with pytest.raises(UnsupportedError):
        Question({}, Measure("x", "variance", "x"))


def test_rows_by_number(spark, tmp_path):
    spark.range(1000).repartitionByRange(3, "id").write.parquet(str(tmp_path / "r"))
    scan = Scan.parquet(spark, str(tmp_path / "r"))
    every = scan.to_list()
    assert sorted(every) == list(range(1000))
    assert scan.rows(990, 2000).to_list() == every[990:] and scan.rows_at(5, 999, 5, 333).to_list() == [every[5], every[333], every[999]]
    assert scan.take(3).to_list() == every[:3] and scan.skip(997).to_list() == every[997:]
    assert Scan.of(spark.range(100).select((-F.col("id")).alias("v")), ["v"]).rows(2, 4).to_list() == [-97, -96]


def test_cursor(scan):
    entries = sorted((p[2], p[0]) for p in points())
    c = scan.keys("e")
    assert c.first() and (c.key, *c.row) == entries[0] and not c.previous()
    assert c.seek(25, cursors.AT_OR_AFTER)
    at = entries.index((c.key, *c.row))
    assert entries[at - 1][0] < 25 <= c.key
    for _ in range(3):
        assert c.next()
        at += 1
        assert (c.key, *c.row) == entries[at]
    assert c.previous() and (c.key, *c.row) == entries[at - 1]
    assert c.rank(30) == sum(k < 30 for k, _ in entries) and c.count_at(30) == sum(k == 30 for k, _ in entries)
    assert c.seek_rank(100) and (c.key, *c.row) == entries[100] and not c.seek_rank(10_000)
    assert c.seek(30, cursors.BEFORE) and (c.key, *c.row) == max(x for x in entries if x[0] < 30)
    assert c.last() and (c.key, *c.row) == entries[-1] and c.previous_key() and (c.key, *c.row) == max(x for x in entries if x[0] < entries[-1][0])
    assert not c.seek(1000) and not c.valid
    with pytest.raises(QueryError):
        c.key  # noqa: B018


def total(v, kind):
    if isinstance(v, float):
        bits = struct.unpack(">q", struct.pack(">d", v))[0]
        return bits if bits >= 0 else -(2**63) - 1 - bits
    return v.encode() if isinstance(v, str) else v


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_first", [False, True])
def test_row_keys_sort(descending, nulls_first):
    rng = random.Random(1)
    columns = [KeyColumn("a", descending, nulls_first), KeyColumn("b", not descending, nulls_first), KeyColumn("c", descending, not nulls_first)]
    kinds = [T.StringType(), T.IntegerType(), T.DoubleType()]
    rows = [(rng.choice([None, "", "a", "a" * 32, "a" * 33, "a" * 64, "ab", "é", "\x00"]), rng.choice([None, -5, 0, 2**31 - 1, -(2**31)]), rng.choice([None, -0.0, 0.0, 1.5, -math.inf, math.inf, NAN])) for _ in range(400)]

    def order(row):
        out = []
        for v, c, k in zip(row, columns, kinds, strict=True):
            x = total(v, k)
            if v is None:
                out.append((0 if c.nulls_first else 2, 0))
            else:
                out.append((1, Reverse(x) if c.descending else x))
        return out

    keyed = lambda row: b"".join(encode(v, k, c) for v, k, c in zip(row, kinds, columns, strict=True))
    assert [keyed(r) for r in sorted(rows, key=order)] == sorted(map(keyed, rows))


class Reverse:
    def __init__(self, v):
        self.v = v

    def __lt__(self, o):
        return o.v < self.v

    def __eq__(self, o):
        return o.v == self.v


def test_row_key_column(spark):
    df = spark.sql("SELECT id, IF(id % 3 = 0, NULL, CAST(id AS STRING)) s, DATE '2020-01-01' + CAST(id AS INT) d, CAST(TIMESTAMP_NTZ '1969-12-31 23:00:00' + MAKE_INTERVAL(0,0,0,0,CAST(id AS INT)) AS TIMESTAMP_NTZ) t, CAST(id - 20 AS DECIMAL(12,3)) m FROM range(50)")
    for name in ("s", "d", "t", "m", "id"):
        keyed = df.select("id", name, row_key(df, [KeyColumn(name), KeyColumn("id", True)]).alias("key")) if name != "id" else df.select("id", row_key(df, [KeyColumn("id")]).alias("key"))
        by_bytes = [r.id for r in keyed.orderBy("key").collect()]
        assert by_bytes == [r.id for r in df.orderBy(F.col(name).asc_nulls_first(), F.desc("id")).collect()]
    with pytest.raises(SchemaError):
        row_key(spark.createDataFrame([([1],)], "l array<int>"), [KeyColumn("l")])


def test_own_aggregators(scan):
    got = {r.k: r.value for r in aggregate(scan, {"k": "k"}, "e", Welford(), T.DoubleType()).collect()}
    want = {r.k: r.v for r in scan.group_by("k").select(lambda g: {"k": g.key, "v": g.variance("e")}).collect()}
    assert got == pytest.approx(want)


def test_parts_merge_in_any_tree(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(6).write.parquet(str(tmp_path / "l"))
    scan = Scan.parquet(spark, str(tmp_path / "l"))
    question = Question({"f": "l_returnflag", "m": lambda r: r.l_shipdate.truncate("year")}, Measure("n", "count"), Measure("s", "sum", "l_orderkey"), Measure("hi", "max", "l_quantity"), Measure("q", "quantile", "l_extendedprice", 0.9), Measure("d", "approximate_count_distinct", "l_partkey"))
    whole = sorted(map(tuple, question.ask(scan).collect()))
    parts = question.parts(scan, 3)
    assert len(parts) == 3
    a, b, c = (Partial.from_bytes(spark, question.partial(p).to_bytes()) for p in parts)
    assert sorted(map(tuple, question.merge([a, b, c]).collect())) == whole
    assert sorted(map(tuple, question.merge([question.merged([c, a]), b]).collect())) == whole
    with pytest.raises(EngineError):
        Question({}, Measure("n", "count")).merge([a])


def test_estimates_cover(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.gauss(10 + i / 4000, 3)) for i in range(20_000)]
    spark.createDataFrame(rows, "i int, k string, v double").coalesce(1).write.parquet(str(tmp_path / "e"))
    scan = Scan.parquet(spark, str(tmp_path / "e"))
    exact = {r.k: r for r in list(estimate(scan, {"k": "k"}, {"v": "v"}, shares=()))[-1].answers.collect()}
    assert all(r.rows_margin == 0 for r in exact.values())
    held = []
    for seed in range(12):
        for r in next(estimate(scan, {"k": "k"}, {"v": "v"}, shares=(0.1,), range_rows=50, stratum_ranges=40, seed=seed)).answers.collect():
            e = exact[r.k]
            held += [abs(r.rows - e.rows) <= r.rows_margin, abs(r.v - e.v) <= r.v_margin, abs(r.v_mean - e.v_mean) <= r.v_mean_margin]
    assert 0.85 <= sum(held) / len(held) <= 1
    tiers = list(estimate(scan, {}, {"v": "v"}, exact_under_s=1e6))
    assert len(tiers) == 1 and tiers[0].exact


def test_binding(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "Id int, score float, note string")
    want = T.StructType([schemas.declared("id", "i64", nullable=True), schemas.declared("score", "f64")])
    assert schemas.bind(df, want).schema.simpleString() == "struct<id:bigint,score:double>"
    for bad in ([schemas.declared("note", "i64")], [schemas.declared("gone", "i64")], [schemas.declared("id", "i64", nullable=False)], [schemas.declared("score", "f32"), schemas.declared("id", "i16")]):
        with pytest.raises(SchemaError):
            schemas.bind(df, T.StructType(bad))
    with pytest.raises(SchemaError):
        schemas.declared("wide", "decimal", precision=76, scale=10)
    assert schemas.declared("u", "u64").dataType == T.DecimalType(20, 0)
    twice = spark.createDataFrame([(1, 2)], "a int, b int").withColumnRenamed("b", "A2")
    assert schemas.resolve(twice.schema, "a2") == "A2"


def test_edge_sizes(spark):
    for n in (0, 1, 1023, 1024, 1025, 8193):
        scan = Scan.of(spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v")), ["id"])
        r = scan.aggregate(lambda g: {"n": g.count(), "s": g.sum("v"), "lo": g.min("v"), "any": g.any(lambda r: r.v >= 0), "all": g.all(lambda r: r.id >= 0)}).first()
        assert tuple(r) == (n, sum(range(0, n, 2)), 0 if n else None, n > 0, True)


def test_orders_of_several_columns(scan):
    got = [(r.e, r.k, r.id) for r in scan.in_order("e", "k").take(30).df.collect()]
    want = sorted(((p[2], p[1], p[0]) for p in points()), key=lambda r: (r[0], r[1] is None, r[1] or "", r[2]))[:30]
    assert got == want


def test_extensions():
    import uuid

    schemas.register_extension("order", T.StringType(), uuid.UUID, str)
    field = schemas.extension("id", "order")
    value = uuid.uuid4()
    assert schemas.read_value(field, schemas.write_value(field, value)) == value and schemas.read_value(field, None) is None
    with pytest.raises(SchemaError):
        schemas.extension("x", "nothing")


def test_cancelled_jobs_end(spark):
    import threading
    import time

    from sparkloom.operators.scan import cancellable

    with cancellable(spark, "slow") as cancel:
        threading.Timer(3, cancel).start()
        began = time.time()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 10**15, 1, 4).selectExpr("sum(hash(id) % 7) AS s").collect()
        assert time.time() - began < 60


def test_variant_values(spark):
    from sparkloom.functions import variant

    df = spark.sql("SELECT parse_json('{\"a\": 1.25, \"b\": true, \"c\": \"x\"}') AS v UNION ALL SELECT CAST(NULL AS VARIANT)")
    scan = Scan.of(df)
    got = [tuple(r) for r in scan.select(a=lambda r: r.v["a"].value_as("decimal"), b=lambda r: r.v["b"].as_bool(), c=lambda r: r.v["c"].value_as("decimal"), d=lambda r: r.v["a"].as_double()).df.collect()]
    assert [tuple(None if v is None else float(v) for v in r) for r in got] == [(1.25, 1.0, None, 1.25), (None,) * 4]
    built = spark.range(1).select(variant.to_json(variant.build(F.struct(F.lit(1).alias("k")))).alias("j"), variant.from_json(F.lit("{")).alias("n")).first()
    assert built.j == '{"k":1}' and built.n is None


def test_observed_and_explained(scan):
    df, seen = scan.where(lambda r: r.e < 10).observed()
    n = len(df.collect())
    assert seen.get["rows"] == n and "Filter" in scan.where("e < 10").explain() and scan.cost() >= 0
