"""The row language against a row-by-row evaluation in Python."""

import datetime as dt
import decimal
import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import EngineError, FilterSyntaxError, QueryError, SchemaError, UnsupportedError
from sparkloom.functions.predicates import Fields, Predicate, tuple_in
from sparkloom.operators.scan import Scan
from sparkloom.plans.grammar import parse

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("id", T.LongType()), ("i", T.IntegerType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("s", T.StringType()), ("b", T.BooleanType()), ("l", T.ArrayType(T.IntegerType())), ("t", T.TimestampNTZType()), ("d", T.DateType()), ("m", T.DecimalType(9, 2)))])
NAN = float("nan")


def sample() -> list:
    rng = random.Random(1)
    pick = lambda *v: rng.choice(v)
    return [
        (n, pick(None, -3, 0, 1, 2, 7), pick(None, NAN, -0.0, 0.0, 1.5, 2.0, math.inf, -math.inf), pick(None, NAN, 0.0, 1.5, 3.0), pick(None, "", "a_b", "A%", "paris", "pa", "a\\b", "naïve word", "word"), pick(None, True, False), pick(None, [], [1, None], [2, 7], [None]), pick(None, dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 31, 2, 30, 0, 5), dt.datetime(1969, 12, 31, 23, 59, 59)), pick(None, dt.date(2024, 2, 29), dt.date(1970, 1, 1)), pick(None, decimal.Decimal("1.10"), decimal.Decimal("-2.00")))
        for n in range(240)
    ]


@pytest.fixture(scope="module")
def scan(spark):
    return Scan.of(spark.createDataFrame(sample(), SCHEMA), ["id"])


def kept(scan, question) -> set:
    return {r.id for r in scan.where(question).df.select("id").collect()}


def expected(test) -> set:
    return {r[0] for r in sample() if test(dict(zip(SCHEMA.fieldNames(), r, strict=True))) is True}


def cmp(op, a, b):
    """Three values and IEEE's NaN."""
    if a is None or b is None:
        return None
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def no(v):
    return None if v is None else not v


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("column,value", [("i", 1), ("x", 1.5), ("x", 0.0), ("x", NAN), ("x", math.inf), ("s", "pa"), ("t", dt.datetime(2024, 1, 1)), ("d", dt.date(2024, 2, 29)), ("m", decimal.Decimal("1.1")), ("m", decimal.Decimal("1.105")), ("i", decimal.Decimal("1.5"))])
def test_comparisons(scan, op, column, value):
    assert kept(scan, lambda r: OPS[op](r[column], value)) == expected(lambda r: cmp(op, r[column], value))
    assert kept(scan, lambda r: ~OPS[op](r[column], value)) == expected(lambda r: no(cmp(op, r[column], value)))


@pytest.mark.parametrize("op", OPS)
def test_columns(scan, op):
    assert kept(scan, lambda r: OPS[op](r.x, r.y)) == expected(lambda r: cmp(op, r["x"], r["y"]))
    assert kept(scan, lambda r: ~OPS[op](r.x, r.y)) == expected(lambda r: no(cmp(op, r["x"], r["y"])))


def test_sets_and_nulls(scan):
    member = lambda v, s: None if v is None else v in s
    assert kept(scan, lambda r: r.i.is_in([1, None, 7])) == expected(lambda r: member(r["i"], {1, 7}))
    assert kept(scan, lambda r: ~r.i.is_in([1, None, 7])) == expected(lambda r: no(member(r["i"], {1, 7})))
    assert kept(scan, lambda r: ~r.x.is_in([NAN, 1.5])) == expected(lambda r: no(None if r["x"] is None else r["x"] == 1.5))
    assert kept(scan, lambda r: r.i.is_in([])) == set()
    assert kept(scan, lambda r: ~r.i.is_in([None])) == expected(lambda r: r["i"] is not None)
    assert kept(scan, lambda r: r.x == None) == expected(lambda r: r["x"] is None)  # noqa: E711
    assert kept(scan, lambda r: r.x != None) == expected(lambda r: r["x"] is not None)  # noqa: E711
    assert kept(scan, lambda r: r.i < None) == set() == kept(scan, lambda r: ~(r.i < None))
    assert kept(scan, lambda r: r.b.is_true() | r.b.is_false()) == expected(lambda r: r["b"] is not None)


def test_text(scan):
    assert kept(scan, lambda r: r.s.starts_with("pa")) == expected(lambda r: r["s"] is not None and r["s"].startswith("pa"))
    assert kept(scan, lambda r: r.s.contains("a")) == expected(lambda r: r["s"] is not None and "a" in r["s"])
    for pattern, escape, fits in (("a_b", "\\", {"a_b", "a\\b"}), ("a\\_b", "\\", {"a_b"}), ("%!%", "!", {"A%"}), ("%", "\\", {"", "a_b", "A%", "paris", "pa", "a\\b", "naïve word", "word"}), ("na_ve%", "\\", {"naïve word"}), ("pa%", "\\", {"pa", "paris"}), ("%\\\\%", "\\", {"a\\b"}), ("a!\\b", "!", {"a\\b"}), ("a\\b", "!", {"a\\b"}), ("_\\_", "!", {"a\\b"}), ("%d", "\\", {"naïve word", "word"}), ("p%s", "\\", {"paris"}), ("\\pa", "\\", {"pa"}), ("", "\\", {""})):
        assert kept(scan, lambda r: r.s.like(pattern, escape)) == expected(lambda r: r["s"] in fits), pattern  # noqa: B023
    assert kept(scan, lambda r: r.s.has_token("word")) == expected(lambda r: r["s"] in ("naïve word", "word"))
    assert kept(scan, lambda r: r.s.has_token("na")) == set()


def test_lists(scan):
    holds = lambda v, e: None if v is None else e in [x for x in v if x is not None]
    assert kept(scan, lambda r: r.l.contains(7)) == expected(lambda r: holds(r["l"], 7))
    assert kept(scan, lambda r: ~r.l.contains(7)) == expected(lambda r: no(holds(r["l"], 7)))
    assert kept(scan, lambda r: r.l.contains(None)) == set() == kept(scan, lambda r: ~r.l.contains(None))


def test_tuples(scan):
    pairs = [(1, "pa"), (7, ""), (None, "pa"), (0, None)]

    def member(r):
        out = False
        for a, b in pairs:
            if a is None or b is None:
                continue
            one, two = cmp("=", r["i"], a), cmp("=", r["s"], b)
            both = False if one is False or two is False else None if one is None or two is None else True
            out = True if out is True or both is True else None if out is None or both is None else False
        return out

    assert kept(scan, lambda r: tuple_in([r.i, r.s], pairs)) == expected(member)
    assert kept(scan, lambda r: ~tuple_in([r.i, r.s], pairs)) == expected(lambda r: no(member(r)))
    assert kept(scan, "(i, s) in ((1, 'pa'), (7, ''))") == expected(member)


def test_pushdown_does_not_change_answers(spark, scan, tmp_path):
    path = str(tmp_path / "p")
    scan.df.repartition(3).write.parquet(path)
    questions = ["x > 1 and i <= 2", "not (x > 1.5) or s like 'pa%'", "i in (1, 2) and not b = true", "t >= '2024-01-01' and d < '2024-12-31'", "m >= 1.10"]
    for q in questions:
        answers = []
        for on in ("true", "false"):
            spark.conf.set("spark.sql.parquet.filterPushdown", on)
            answers.append(kept(Scan.parquet(spark, path), q))
        spark.conf.set("spark.sql.parquet.filterPushdown", "true")
        assert answers[0] == answers[1] == kept(scan, q)


def test_filters_reach_the_files(spark, sf):
    scan = Scan.parquet(spark, f"{sf}/events.parquet", columns=["ts", "value"])
    plan = scan.where(lambda r: (r.value > 45) & (r.ts.truncate("day") == dt.datetime(2024, 1, 3))).explain()
    assert "GreaterThan(value,45.0)" in plan and "LessThan(ts,2024-01-04T00:00)" in plan
    assert "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]


# -- refusals ----------------------------------------------------------------------------------


@pytest.mark.parametrize("ask", [
    lambda r: r.i + 1 > 2, lambda r: r.i % 2 == 0, lambda r: abs(r.x) > 1, lambda r: len(r.s) > 3, lambda r: r.i == "1", lambda r: r.s > 3, lambda r: r.x == r.i, lambda r: r.b == 1, lambda r: r.i == True, lambda r: r.nothing == 1,
    lambda r: (r.i > 1) and (r.i < 3), lambda r: r.i.starts_with("a"), lambda r: r.s.has_token("two words"), lambda r: r.s.like("a\\"), lambda r: r.m.bucket(2) == 1, lambda r: r.d.truncate("hour") == dt.date(2024, 1, 1), lambda r: r.i, lambda r: tuple_in([r.i], [(1,)]), lambda r: r.i["k"].as_int64() == 1,
])
def test_must_not_build(scan, ask):
    with pytest.raises((EngineError, TypeError)):
        scan.where(ask)


def test_predicates_are_not_booleans(scan):
    with pytest.raises(QueryError):
        bool(scan.fields.i > 1)
    with pytest.raises(UnsupportedError):
        scan.fields.m.bucket(1)


# -- the text grammar ----------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "i >", "i = 1 2", "i ~ 3", "and i = 1", "i in ()", "i in (1", "(i = 1", "i = 'x", "s like", "i is nul", "i + 1 = 2", "not", "i = ?0", "l starts with 'a'", "nothing = 1", "d = 'yesterday'", "i exists", "i not like 'a'", "'a' = s", "i = 1 or", "((((i = 1)))"])
def test_bad_text(text):
    with pytest.raises((FilterSyntaxError, SchemaError)):
        parse(text, SCHEMA)


def test_deep_nesting_is_refused():
    with pytest.raises(FilterSyntaxError):
        parse("(" * 5000 + "i = 1" + ")" * 5000, SCHEMA)
    assert isinstance(parse(" or ".join(["i = 1"] * 150), SCHEMA), Predicate)


def leaf(rng: random.Random) -> str:
    return rng.choice(["i = 1", "i <> -3", 'x >= 1.5', "x < 2e0", "s = 'it''s'", "s like 'a!_b' escape '!'", "s starts with 'pa'", "s contains 'a'", "i is null", "b is not null", "i in (1, 2, null)", "i not in (7)", "t > '2024-01-01 00:00:00'", '"d" = \'2024-02-29\'', "m <= 1.10", "b = true", "x != y", "l contains 7", "(i, s) in ((1, 'pa'), (2, 'x'))", "s has token 'word'"])


def grown(rng: random.Random, depth: int) -> str:
    if depth == 0 or rng.random() < 0.3:
        return leaf(rng)
    kind = rng.randrange(3)
    if kind == 0:
        return f"not ({grown(rng, depth - 1)})"
    return f"({grown(rng, depth - 1)}) {'and' if kind == 1 else 'OR'} ({grown(rng, depth - 1)})"


@pytest.mark.parametrize("seed", range(8))
def test_text_round_trip(scan, seed):
    rng = random.Random(seed)
    for _ in range(3):
        text = grown(rng, 3)
        first = parse(text, SCHEMA)
        again = parse(first.text, SCHEMA)
        assert again.text == first.text
        assert kept(scan, first) == kept(scan, again)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ixs ()'\"=<>!,.?0123notadril", max_size=30))
def test_any_text_parses_or_is_refused(spark, text):
    try:
        assert isinstance(parse(text, SCHEMA), Predicate)
    except (FilterSyntaxError, SchemaError):
        pass


def test_summaries_tell_no_lies(scan):
    """What a predicate says of a file's summaries holds for its rows."""
    rows = [dict(zip(SCHEMA.fieldNames(), r, strict=True)) for r in sample()]
    rng = random.Random(6)
    fields = Fields(SCHEMA)
    for _ in range(400):
        part = rng.sample(rows, rng.randrange(1, 6))
        summaries = {}
        for c in ("i", "x", "s", "d"):
            some = [r[c] for r in part if r[c] is not None and r[c] == r[c]]
            summaries[c] = (min(some, default=None), max(some, default=None), sum(r[c] is None for r in part), len(part))
        op, (c, v) = rng.choice(list(OPS)), rng.choice([("i", 1), ("x", 1.5), ("s", "pa"), ("d", dt.date(1970, 1, 1))])
        other, (k, w) = rng.choice(list(OPS)), rng.choice([("i", 2), ("x", 0.0)])
        p, q = OPS[op](fields[c], v), OPS[other](fields[k], w)
        for predicate, truth in ((p, lambda r: cmp(op, r[c], v)), (~p, lambda r: no(cmp(op, r[c], v))), (p & q, lambda r: both(cmp(op, r[c], v), cmp(other, r[k], w))), (~(p | q), lambda r: both(no(cmp(op, r[c], v)), no(cmp(other, r[k], w))))):  # noqa: B023
            true, false, unknown = predicate.outcomes(summaries)
            seen = [truth(r) for r in part]
            assert (True not in seen or true) and (False not in seen or false) and (None not in seen or unknown)


def both(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


# -- functions of columns --------------------------------------------------------------------------


def test_paris_autumn_keeps_two_hours(spark):
    utc = [dt.datetime(2026, 10, 24, 21, 30) + dt.timedelta(minutes=30 * i) for i in range(60)]
    scan = Scan.of(spark.createDataFrame([(u,) for u in utc], T.StructType([T.StructField("t", T.TimestampNTZType())])))
    hours = scan.group_by(h=lambda r: r.t.truncate("hour", "Europe/Paris")).select(lambda g: {"h": g.key, "n": g.count()}).collect()
    assert len(hours) == len({u.replace(minute=0) for u in utc}) and {r.n for r in hours} <= {1, 2}
    days = sorted((r.h, r.n) for r in scan.group_by(h=lambda r: r.t.truncate("day", "Europe/Paris")).select(lambda g: {"h": g.key, "n": g.count()}).collect())
    assert days == [(dt.datetime(2026, 10, 23, 22), 1), (dt.datetime(2026, 10, 24, 22), 50), (dt.datetime(2026, 10, 25, 23), 9)]


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "week", "month", "quarter", "year"])
def test_zoned_instants(spark, unit):
    field = T.StructField("t", T.TimestampType(), True, {"tz": "Europe/Paris"})
    instants = [dt.datetime(2024, 3, 31, 0, 15, tzinfo=dt.UTC) + dt.timedelta(hours=7 * i) for i in range(40)]
    scan = Scan.of(spark.createDataFrame([(u,) for u in instants], T.StructType([field])))
    assert scan.fields.t.zone == "Europe/Paris"
    from zoneinfo import ZoneInfo

    got = {r.t: r.x for r in scan._df.select("t", scan.fields.t.truncate(unit).column.alias("x")).select(F.unix_micros("t").alias("t"), F.unix_micros("x").alias("x")).collect()}
    for u in instants:
        wall = u.astimezone(ZoneInfo("Europe/Paris"))
        start = wall.replace(second=0, microsecond=0)
        if unit != "minute":
            start = start.replace(minute=0)
        if unit not in ("minute", "hour"):
            start = start.replace(hour=0)
        if unit == "week":
            start -= dt.timedelta(days=start.weekday())
        if unit in ("month", "quarter", "year"):
            start = start.replace(day=1, month={"month": start.month, "quarter": (start.month - 1) // 3 * 3 + 1, "year": 1}[unit])
        if unit not in ("minute", "hour"):
            start = start.replace(fold=0, tzinfo=ZoneInfo("Europe/Paris"))
        assert got[int(u.timestamp() * 1e6)] == int(start.timestamp() * 1e6), (unit, u)


@pytest.mark.parametrize("unit,op", list(itertools.product(["hour", "week", "month", "quarter", "year"], OPS)))
def test_ranges_for_functions(spark, unit, op):
    """A rewritten comparison answers as the function itself."""
    rng = random.Random(3)
    times = [dt.datetime(2023, 11, 1) + dt.timedelta(minutes=rng.randrange(400_000)) for _ in range(300)] + [None]
    scan = Scan.of(spark.createDataFrame([(t,) for t in times], T.StructType([T.StructField("t", T.TimestampNTZType())])))
    for value in (dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 7, 5, 17)):
        f = scan.fields.t.truncate(unit)
        direct = scan._df.where(OPS[op](f.column, F.lit(value.isoformat(" ")).cast("timestamp_ntz"))).count()
        assert scan.where(OPS[op](f, value)).count() == direct
        b = scan.fields.t.bucket(dt.timedelta(hours=5))
        assert scan.where(OPS[op](b, value)).count() == scan._df.where(OPS[op](b.column, F.lit(value.isoformat(" ")).cast("timestamp_ntz"))).count()


def test_number_buckets(spark):
    scan = Scan.of(spark.createDataFrame([(v, float(v) / 4 if v is not None else None) for v in [*range(-20, 20), None]], "i int, x double"))
    for r in scan.select("i", b=lambda r: r.i.bucket(7), y="x", c=lambda r: r.x.bucket(0.75)).df.collect():
        assert r.b == (None if r.i is None else r.i // 7 * 7)
        assert r.c == (None if r.y is None else math.floor(r.y / 0.75) * 0.75)
    special = Scan.of(spark.createDataFrame([(NAN,), (math.inf,), (1e300,)], "x double"))
    assert [str(v) for v in special.select(b=lambda r: r.x.bucket(2.0)).to_list()] == ["nan", "inf", "1e+300"]
