"""A set that grows by deltas, and first times over micro-batches and restarts."""

from pyspark.sql import functions as F

from tessera.sources import unions
from tessera.streaming import registry

SCHEMA = "lib string, literal string"


def test_deltas(spark, tmp_path):
    root, held = str(tmp_path), set()
    assert unions.read_union(spark, root, SCHEMA).count() == 0 and unions.version_of(spark, root) == (0, [])
    deltas = [[("a", "x"), ("a", "x"), ("b", None)], [("a", "x"), ("b", None)], [], [("a", "y"), ("b", None), (None, None)], *[[("c", str(k))] for k in range(6)]]
    for k, rows in enumerate(deltas):
        before = unions.version_of(spark, root)
        number = unions.add_to_union(spark.createDataFrame(rows, SCHEMA), root, most_parts=4)
        news = set(rows) - held
        held |= news
        assert number == before[0] + bool(news)
        got = [tuple(r) for r in unions.read_union(spark, root, SCHEMA).collect()]
        assert len(got) == len(held) and set(got) == held
        parts = unions.version_of(spark, root)[1]
        assert len(parts) <= 4 + 1
        if news and len(before[1]) < 4:
            (new,) = set(parts) - set(before[1])
            assert {tuple(r) for r in spark.read.parquet(f"{root}/rows/{new}").collect()} == news


def test_a_slower_writer_merges_again(spark, tmp_path, monkeypatch):
    root, calls = str(tmp_path), []
    unions.add_to_union(spark.createDataFrame([("a", "x")], SCHEMA), root)

    def raced(*args, f=unions._commit):
        calls.append(args[2])
        if len(calls) == 1:  # another writer comes in between
            monkeypatch.setattr(unions, "_commit", f)
            unions.add_to_union(spark.createDataFrame([("a", "y")], SCHEMA), root)
            monkeypatch.setattr(unions, "_commit", raced)
        return f(*args)

    monkeypatch.setattr(unions, "_commit", raced)
    assert unions.add_to_union(spark.createDataFrame([("a", "y"), ("a", "z")], SCHEMA), root) == 3 and calls == [2, 3]
    rows = [tuple(r) for r in unions.read_union(spark, root, SCHEMA).collect()]
    assert sorted(rows) == [("a", "x"), ("a", "y"), ("a", "z")]


def test_first_times(spark, tmp_path):
    schema = "name string, version string, time_raw string, seq long"
    batches = [[("a", "1.0.0", "t2", 5), ("a", "1.0.0", "t1", 3), ("b", "1.0.0", None, 1)], [("a", "1.0.0", "t0", 1), ("a", "1.0.0", "t1", 9), ("a", "2.0.0", "t9", 2)], [("b", "1.0.0", "unknown", 7), ("b", "1.0.0", "t3", 8), ("b", "1.0.0", "t3", 9)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # a second start adds nothing
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            registry.write_first_times(registry.first_times(stream), f"{tmp_path}/first", f"{tmp_path}/conflicts", f"{tmp_path}/c").awaitTermination()
    first = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/first").select("name", "version", "time_raw").collect())
    assert first == [("a", "1.0.0", "t1"), ("a", "2.0.0", "t9"), ("b", "1.0.0", "unknown")]
    other = spark.read.parquet(f"{tmp_path}/conflicts").select("name", "version", "time_raw", "other", F.col("n").cast("int")).collect()
    assert sorted(map(tuple, other)) == [("a", "1.0.0", "t1", "t0", 1), ("a", "1.0.0", "t1", "t2", 1), ("b", "1.0.0", "unknown", "t3", 2)]


def test_first_times_keep_state_for_buckets_of_names(spark, tmp_path, monkeypatch):
    """Many versions take few calls, whatever their number, and stay apart within a bucket."""
    monkeypatch.setattr(registry, "BUCKETS", 3)
    schema = "name string, version string, time_raw string, seq long"
    rows = [(f"n{k % 40}", f"1.{k % 120}.0", f"t{k}", k) for k in range(240)]
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = registry.write_first_times(registry.first_times(stream), f"{tmp_path}/first", f"{tmp_path}/conflicts", f"{tmp_path}/c")
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] < 20  # a few for each bucket, not one for each of 120 versions
    first = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/first").select("name", "version", "time_raw").collect())
    assert first == sorted((n, v, t) for n, v, t, _ in rows[:120])
    other = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/conflicts").select("name", "version", "other").collect())
    assert other == sorted((n, v, t) for n, v, t, _ in rows[120:])
