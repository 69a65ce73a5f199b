"""Versioned datasets against a list in memory."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import CommitConflictError, IntegrityError, SchemaError, SourceOffsetConflictError
from sparkloom.sources import files, maintenance
from sparkloom.sources.dataset import ABANDONED, ALREADY_THERE, APPLIED, Dataset, DatasetSet, Layout, SourceRange
from sparkloom.streaming import ingest

SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("place", T.StringType()), T.StructField("warm", T.DoubleType()), T.StructField("at", T.TimestampNTZType())])
START = dt.datetime(2024, 1, 1)


def made(rng, n):
    return [(rng.randrange(100), rng.choice([None, "nice", "lyon", "x" * 80]), rng.choice([None, 1.5, 2.5, -3.0]), START + dt.timedelta(hours=rng.randrange(100))) for _ in range(n)]


def rows(dataset):
    return sorted(map(tuple, dataset.scan().df.collect()), key=repr)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "data set+1")


@pytest.mark.parametrize("seed", range(3))
def test_changes_fuzz(spark, root, seed):
    rng = random.Random(seed)
    layout = rng.choice([None, Layout(sort_key=("key",)), Layout(("at", "day"), ("key", "at")), Layout("place", ("at",))])
    dataset = Dataset.create(spark, root, SCHEMA, layout)
    model, versions = [], {}
    for _ in range(9):
        what = rng.choice(["append", "append", "delete", "mark", "update", "compact", "refresh", "consolidate"])
        k = rng.randrange(100)
        if what == "append":
            new = made(rng, rng.randrange(1, 40))
            assert dataset.append(spark.createDataFrame(new, SCHEMA)).outcome == APPLIED
            model += new
        elif what in ("delete", "mark"):
            commit = dataset.delete(lambda r: (r.key < k) & (r.warm > 0), mark=what == "mark")  # noqa: B023
            gone = [r for r in model if r[0] < k and r[2] is not None and r[2] > 0]
            assert commit.rows == len(gone)
            model = [r for r in model if r not in gone]
        elif what == "update":
            dataset.update(lambda r: r.key >= k, {"warm": lambda c: c("warm") + 1, "place": F.lit("new")})  # noqa: B023
            model = [(r[0], "new", r[2] + 1 if r[2] is not None else None, r[3]) if r[0] >= k else r for r in model]
        elif what == "compact":
            changed = dataset.last_data_change
            maintenance.compact(dataset, target_rows=rng.choice([30, 1000]))
            assert dataset.last_data_change == changed
        elif what == "consolidate" and dataset.objects():
            maintenance.consolidate(dataset, rng.choice(dataset.objects()).partition, target_rows=50)
        else:
            dataset = Dataset.open(spark, root)
        assert rows(dataset) == sorted(model, key=repr) and dataset.row_count == len(model)
        assert dataset.scan(where=lambda r: r.key < k).count() == sum(r[0] < k for r in model) == dataset.scan(where=lambda r: r.key < k, pruned=False).count()  # noqa: B023
        versions[dataset.version] = sorted(model, key=repr)
    assert maintenance.verify(dataset).collect() == []
    for version, want in rng.sample(sorted(versions.items()), min(3, len(versions))):
        assert rows(Dataset.open(spark, root, version)) == want
    maintenance.vacuum(dataset, keep_versions=1, older_than_s=0)
    assert rows(Dataset.open(spark, root)) == sorted(model, key=repr)


def test_checkpoints(spark, root):
    dataset = Dataset.create(spark, root, SCHEMA)
    for i in range(18):
        dataset.append(spark.createDataFrame([(i, None, None, None)], SCHEMA).coalesce(1))
    assert any("checkpoint" in n for n, _, _ in dataset.store.list("_log"))
    assert sorted(r[0] for r in rows(Dataset.open(spark, root))) == list(range(18))
    assert sorted(r[0] for r in rows(Dataset.open(spark, root, 5))) == list(range(4))
    assert [r.operation for r in maintenance.history(dataset).orderBy("version").limit(2).collect()] == ["create", "append"]


def test_snapshots(spark, root):
    one = Dataset.create(spark, root, SCHEMA)
    one.append(spark.createDataFrame(made(random.Random(1), 10), SCHEMA))
    two = Dataset.open(spark, root)
    before = two.scan()
    one.append(spark.createDataFrame(made(random.Random(2), 5), SCHEMA))
    assert before.count() == two.scan().count() == 10 and one.scan().count() == 15
    assert two.refresh() == 3 and two.scan().count() == 15
    with pytest.raises(IntegrityError):
        Dataset.open(spark, root, 99)
    with pytest.raises(CommitConflictError):
        Dataset.create(spark, root, SCHEMA)


def test_concurrent_appends_all_land(spark, root):
    Dataset.create(spark, root, SCHEMA)

    def work(i):
        return Dataset.open(spark, root).append(spark.createDataFrame([(i, None, None, None)], SCHEMA).coalesce(1)).version

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(work, range(8)))
    assert sorted(versions) == list(range(2, 10)) and sorted(r[0] for r in rows(Dataset.open(spark, root))) == list(range(8))


def test_delete_meets_an_append(spark, root):
    one = Dataset.create(spark, root, SCHEMA)
    one.append(spark.createDataFrame([(i, None, None, None) for i in range(10)], SCHEMA))
    two = Dataset.open(spark, root)
    one.append(spark.createDataFrame([(i, None, None, None) for i in range(5, 15)], SCHEMA))
    two.delete(lambda r: r.key >= 8)  # decided again on the version it lands on
    assert sorted(r[0] for r in rows(Dataset.open(spark, root))) == sorted([*range(8), 5, 6, 7])


def test_sources_count_once(spark, root):
    a = Dataset.create(spark, root, T.StructType([T.StructField("spans", T.LongType())]))
    b = Dataset.open(spark, root)

    def append(dataset, start, stop):
        return dataset.append(spark.createDataFrame([(stop - start,)], "spans long").coalesce(1), [SourceRange("raw/17", start, stop)])

    assert append(a, 0, 41_200).outcome == APPLIED
    assert append(b, 41_200, 42_300).outcome == APPLIED if b.refresh() else False
    late = append(a, 41_200, 41_950)
    assert late.outcome == ALREADY_THERE and a.source_offset("raw/17") == 42_300
    assert append(a, 42_300, 42_900).outcome == APPLIED
    with pytest.raises(SourceOffsetConflictError) as conflict:
        append(b, 42_300, 43_000)
    assert conflict.value.recorded == 42_900
    assert append(b, 42_900, 43_000).outcome == APPLIED
    assert Dataset.open(spark, root).scan().sum("spans") == 43_000
    assert b.append(None, [SourceRange("raw/17", 43_000, 43_100)]).outcome == APPLIED
    b.forget_sources("raw/17")
    assert b.source_offset("raw/17") == 0


def test_schema_evolution(spark, root):
    dataset = Dataset.create(spark, root, SCHEMA, Layout(sort_key=("key",)))
    dataset.append(spark.createDataFrame([(1, "nice", 1.0, START)], SCHEMA))
    new = T.StructType([SCHEMA["key"], T.StructField("town", T.StringType()), SCHEMA["at"], T.StructField("humid", T.IntegerType())])
    dataset.evolve(new, {"town": "place"})
    dataset.append(spark.createDataFrame([(2, "lyon", START, 60)], new))
    assert rows(dataset) == [(1, "nice", START, None), (2, "lyon", START, 60)]
    assert dataset.scan().where(lambda r: r.humid.is_null()).count() == 1 and not dataset.may_match(lambda r: r.humid > 70)
    dataset.update(lambda r: r.key == 1, {"humid": F.lit(5)})
    assert rows(dataset)[0] == (1, "nice", START, 5)
    for bad in (T.StructType([*new, T.StructField("warm", T.DoubleType())]), T.StructType([*new, T.StructField("place", T.StringType())]), T.StructType([T.StructField("key", T.StringType()), *new[1:]]), new[1:]):
        with pytest.raises(SchemaError):
            dataset.evolve(bad)
    with pytest.raises(SchemaError):
        dataset.append(spark.createDataFrame([(1, "x")], "key long, place string"))


def test_objects(spark, root, tmp_path):
    dataset = Dataset.create(spark, root, SCHEMA)
    dataset.append(spark.createDataFrame([(i, None, None, None) for i in range(10)], SCHEMA).coalesce(1))
    first = dataset.objects()[0]
    spark.createDataFrame([(50, "in")], "key long, place string").coalesce(1).write.parquet(str(tmp_path / "file"))
    path = next(str(p) for p in (tmp_path / "file").glob("*.parquet"))
    dataset.import_file(path)
    assert (50, "in", None, None) in rows(dataset) and dataset.object_table().count() == 2
    assert dataset.replace_objects([first.key], dataset.scan().where(lambda r: r.key.between(3, 4)).df).outcome == APPLIED
    assert sorted(r[0] for r in rows(dataset)) == [3, 4, 50]
    assert dataset.remove_objects([first.key]).outcome == ALREADY_THERE
    assert dataset.remove_objects([first.key, dataset.objects()[0].key]).outcome == ABANDONED
    dataset.remove_objects([o.key for o in dataset.objects()])
    assert rows(dataset) == [] and dataset.scan().columns == SCHEMA.fieldNames()


def test_expiry_needs_proof(spark, root):
    dataset = Dataset.create(spark, root, SCHEMA, Layout(("at", "day"), ("at",)))
    dataset.append(spark.createDataFrame([(i, "p", 1.0, START + dt.timedelta(hours=i)) for i in range(96)], SCHEMA))
    dataset.append(spark.createDataFrame([(7, "p", None, None)], SCHEMA))
    dataset.expire(lambda r: r.at < START + dt.timedelta(days=2, hours=5))
    assert sorted(r[0] for r in rows(dataset)) == sorted([*range(48, 96), 7])
    assert dataset.expire(lambda r: r.place == "p").outcome == ALREADY_THERE
    assert dataset.expire(lambda r: r.warm > 0).outcome == ALREADY_THERE  # a NaN or null may hide
    assert [v for v, _, _ in dataset.ask_by_values(lambda s: s.count())][0].startswith("2024-01-04")


def test_verify_finds(spark, root):
    dataset = Dataset.create(spark, root, SCHEMA, Layout(sort_key=("key",)))
    dataset.append(spark.createDataFrame([(i, None, None, None) for i in range(40)], SCHEMA))
    assert maintenance.verify(dataset).collect() == []
    dataset.store.delete(dataset.objects()[0].key)
    assert [r.finding for r in maintenance.verify(dataset).collect()] == ["missing"]


def test_indexes_and_rollups_change_no_answer(spark, root):
    dataset = Dataset.create(spark, root, SCHEMA)
    dataset.append(spark.createDataFrame(made(random.Random(4), 50), SCHEMA))
    before = rows(dataset)
    rollup = maintenance.Rollup(dataset, "place", ["place"], ["key"])
    first = sorted(map(repr, rollup.ask("place").collect()))
    maintenance.index(dataset, "key")
    assert rows(dataset) == before and sorted(map(repr, rollup.ask("place").collect())) == first
    dataset.append(spark.createDataFrame([(5, "nice", None, None)], SCHEMA))
    got = {r.place: (r.rows, r.key) for r in rollup.ask("place").collect()}
    want = {r.place: (r.n, r.s) for r in dataset.scan().group_by("place").select(lambda g: {"place": g.key, "n": g.count(), "s": g.sum("key")}).collect()}
    assert got == want and maintenance.advice(dataset, ["key = 3"])[0][0] == "key"


def test_sets(spark, tmp_path):
    parts = [Dataset.create(spark, str(tmp_path / str(i)), SCHEMA) for i in range(2)]
    for i, d in enumerate(parts):
        d.append(spark.createDataFrame([(10 * i + j, None, None, None) for j in range(3)], SCHEMA).coalesce(1))
    both = DatasetSet(*parts)
    assert [r[0] for r in both.scan().to_list()] == [0, 1, 2, 10, 11, 12] and both.row_count == 6
    assert both.scan().rows(2, 4).select("key").to_list() == [2, 10]
    assert both.scan().aggregate(lambda g: {"f": g.first().key, "l": g.last().key}).first() == (0, 12)


def test_stream_counts_once(spark, root, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(made(random.Random(5), 30), SCHEMA).repartition(3).write.parquet(folder)
    dataset = Dataset.create(spark, root, SCHEMA)
    seen = []
    for checkpoint in ("a", "a", "b"):  # again, then with a lost checkpoint: the batches are run again
        ingest.ingest(ingest.files_stream(spark, folder, SCHEMA, 1), root, "in", str(tmp_path / checkpoint), once=True, on_commit=seen.append).awaitTermination()
    dataset.refresh()
    assert dataset.row_count == 30 and [c.outcome for c in seen] == [APPLIED] * 3 + [ALREADY_THERE] * 3


def test_files(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    report = files.write(df, path, codec="snappy", bloom=["k"], sort=["k"], files=2, page_version=2)
    assert report.rows == 1000 and report.files == 2
    assert {r.codec for r in files.metadata(spark, path).collect()} == {"SNAPPY"}
    assert files.write(df, path, append=True, files=1).files == 1
    assert files.verify(spark, path) == []
    (tmp_path / "f" / "torn.parquet").write_bytes(b"PAR1 torn")
    assert files.verify(spark, path) != [] and files.repair(spark, path) == ["torn.parquet"]
    assert spark.read.parquet(path).count() == 2000
    with pytest.raises(SchemaError):
        files.write(df, path, codec="lzma")


def test_erased_rows_leave_the_disk(spark, root):
    dataset = Dataset.create(spark, root, SCHEMA)
    dataset.append(spark.createDataFrame([(i, f"secret{i}", None, None) for i in range(20)], SCHEMA).coalesce(2))
    dataset.delete(lambda r: r.key == 3, mark=True)
    maintenance.erase(dataset, lambda r: r.key == 4)
    left = {r[1] for r in spark.read.option("recursiveFileLookup", "true").parquet(root + "/data").collect()}
    assert left == {f"secret{i}" for i in range(20) if i not in (3, 4)} == {r[1] for r in rows(dataset)}
