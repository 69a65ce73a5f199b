"""What a table's upkeep holds at once does not grow with the table."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import SchemaError, TooManyValuesError
from sparkloom.operators.scan import Scan, explained
from sparkloom.plans import catalogue
from sparkloom.sources import dataset as datasets
from sparkloom.sources import maintenance
from sparkloom.sources.dataset import Dataset, Layout

PAIRS = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("at", T.TimestampType())])


@pytest.fixture
def pairs(spark, tmp_path):
    dataset = Dataset.create(spark, str(tmp_path / "pairs"), PAIRS, Layout(sort_key=("key",)))
    df = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("n"), F.col("id") % 7).alias("name"), F.when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("double")).alias("x"), F.timestamp_seconds("id").alias("at"))
    dataset.append(df)
    return dataset


@pytest.mark.parametrize("mark", [False, True])
@pytest.mark.parametrize("sent", [datasets.MARKS_SENT, 0])
def test_delete_in(spark, pairs, monkeypatch, mark, sent):
    monkeypatch.setattr(datasets, "MARKS_SENT", sent)
    model = [tuple(r) for r in pairs.scan().df.collect()]

    def gone(columns, values, schema, match):
        nonlocal model
        done = pairs.delete_in(columns, spark.createDataFrame(values, schema), mark=mark)
        assert done.rows == sum(map(match, model))
        model = [r for r in model if not match(r)]
        assert sorted(map(tuple, pairs.scan().df.collect())) == sorted(model) and pairs.row_count == len(model)

    gone("key", [(k,) for k in [*range(0, 2000, 10), *range(0, 2000, 20), 5000]] + [(None,)], "k long", lambda r: r[0] % 10 == 0)
    gone(["name", "x"], [("n1", 3.0), ("n2", float("nan")), ("n3", None), (None, 4.0), ("n4", 5.0)], "n string, x double", lambda r: r[1:3] in [("n1", 3.0), ("n4", 5.0)])
    gone("key", [(None,)], "k long", lambda r: False)
    at = model[5][3]
    gone("at", [(at,)], "t timestamp", lambda r: r[3] == at)
    maintenance.compact(pairs, target_rows=300)
    assert sorted(map(tuple, pairs.scan().df.collect())) == sorted(model) and maintenance.verify(pairs).isEmpty()
    with pytest.raises(SchemaError):
        pairs.delete_in("key", spark.createDataFrame([("1",)], "k string"))


def test_deleted_keys_stay_off_the_driver(spark, monkeypatch):
    """the keys of table_delete_marked were collected and written into a plan."""
    for kind in {c for c in type(spark.range(1)).__mro__ if "collect" in vars(c)}:
        monkeypatch.setattr(kind, "collect", lambda df, own=vars(kind)["collect"]: few_of(own, df))
    assert catalogue.QUERIES["table_delete_marked"](spark, "/root/testdata/sf0.01").count() == 3


def few_of(collect, df):
    rows = collect(df)
    assert len(rows) <= 1000
    return rows


def test_semi_join_of_many_values(spark):
    """more than 2 ** 20 values were refused, which anti_in_tuple4 has on 1 GB."""
    many = Scan.of(spark.range(3 << 20).select("id", (F.col("id") % 2).cast("int").alias("odd")))
    some = many.where(lambda r: r.id >= 1 << 20).select("id", "odd")
    assert many.where_in(["id", "odd"], some).count() == 2 << 20
    assert many.where_in(["id", "odd"], some, negated=True).count() == 1 << 20
    with pytest.raises(TooManyValuesError):
        many.where_in("id", some.select("id"), most=1 << 20)


def test_summaries_sort_no_rows(spark, tmp_path):
    """the least and greatest text of a file took a sort of all its rows."""
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("name"), F.lit("x" * 80).alias("long"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    dataset = Dataset.create(spark, str(tmp_path / "set"), df.schema)
    names = {"0": "id", "1": "name", "2": "long"}
    assert "Sort" not in explained(dataset._summary(read, names))
    dataset.append(read)
    for o in dataset.objects():
        own = spark.read.parquet(dataset.store.path(o.key)).collect()
        texts = [r[1] for r in own if r[1] is not None]
        assert o.rows == len(own) and o.summaries == {"0": [min(r[0] for r in own), max(r[0] for r in own), 0], "1": [min(texts), max(texts), len(own) - len(texts)], "2": [None, None, 0]}


def test_objects_are_what_a_task_sorts(spark, pairs, monkeypatch):
    """a level's target that grows with the table made tasks that sort more with it."""
    monkeypatch.setattr(datasets, "SORTED", 100)
    model = sorted(map(tuple, pairs.scan().df.collect()))
    pairs.append(spark.createDataFrame(model[:500], PAIRS))  # an append counts its rows
    assert max(o.rows for o in pairs.objects()[-5:]) < 250
    maintenance.compact_levels(pairs, target_rows=1000)
    assert max(o.rows for o in pairs.objects()) < 250 and {o.level for o in pairs.objects()} == {1}
    ranges = sorted(pairs._summaries(o)["key"][:2] for o in pairs.objects())
    assert len(ranges) > 12 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sorted(map(tuple, pairs.scan().df.collect())) == sorted(model + model[:500]) and maintenance.verify(pairs).isEmpty()
    assert maintenance.run_compaction(pairs, 4, target_rows=1000)[-1].outcome == "AlreadyThere"  # it comes to rest
    monkeypatch.setattr(datasets, "SORTED", 1 << 20)
    maintenance.consolidate(pairs, None)
    assert pairs.object_count == 1
    pairs.delete(lambda r: r.key < 3, mark=True)
    monkeypatch.setattr(datasets, "SORTED", 100)
    maintenance.compact(pairs, target_rows=1000)  # one object that is more than a task sorts
    assert max(o.rows for o in pairs.objects()) < 250 and pairs.row_count == 2500 - 6


@pytest.mark.parametrize("wrong", [None, 16, 17, 40, 99])
def test_order_is_verified_by_blocks(spark, tmp_path, monkeypatch, wrong):
    """A row that is out of order, within a block or across two, is found; marked rows leave gaps."""
    monkeypatch.setattr(maintenance, "BLOCK", 16)
    keys = list(range(1, 101))
    if wrong is not None:
        keys[wrong] = 0
    dataset = Dataset.create(spark, str(tmp_path / "set"), T.StructType([T.StructField("key", T.LongType())]))
    dataset.append(spark.createDataFrame([(k,) for k in keys], "key long").coalesce(1))
    dataset.delete(lambda r: r.key.is_in([15, 16, 32, 33]), mark=True)
    dataset._state.layout = Layout(sort_key=("key",))
    assert [r.finding for r in maintenance.verify(dataset).collect()] == ([] if wrong is None else ["not in the order of the sort key"])


def test_verify_leaves_no_object_to_a_task(spark, pairs):
    """the order of an object's rows was a window over all of them."""
    plan = explained(maintenance.verify(pairs))
    windows = [line for line in plan.splitlines() if "lag(k" in line and "windowspecdefinition(" in line]
    assert windows and any("windowspecdefinition(number" in line and "block" in line for line in windows)
