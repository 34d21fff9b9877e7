from pyspark.sql import functions as F

from threadloom import streaming


def source(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_sessions_and_deduplication(spark, tmp_path):
    df = spark.sql("select k, id, timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) ts from values (1, 'a', 0), (1, 'a', 5), (1, 'b', 172800), (1, 'c', 900000), (2, 'd', 5000000) as t(k, id, s)")
    got = streaming.run_available(streaming.sessions(source(spark, tmp_path, df, "s"), "k", "ts"), "sessions_out", str(tmp_path / "c1"), "complete")
    assert sorted((r.k, r.events) for r in got.collect()) == [(1, 1), (1, 3), (2, 1)]
    once = streaming.run_available(streaming.deduplicated(source(spark, tmp_path, df, "d"), ["id"], "ts"), "dedup_out", str(tmp_path / "c2"))
    assert sorted(r.id for r in once.collect()) == ["a", "b", "c", "d"]


def test_windows(spark, tmp_path):
    df = spark.sql("select timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, s, 0) ts, 'x' k from values (0), (1), (7) as t(s)")
    got = streaming.run_available(streaming.windowed(source(spark, tmp_path, df, "w"), "ts", "5 minutes", None, ["k"]), "windows_out", str(tmp_path / "c3"), "complete")
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_history_and_gate(spark, tmp_path):
    streaming.use_rocksdb(spark)
    df = spark.sql("select u user_id, q question, repeat('a', 700) answer, timestamp'2026-01-01' + make_dt_interval(0, 0, 0, s) ts from values (1, 'one', 1), (1, 'two', 2), (1, 'three', 3), (2, 'x', 1), (2, '/reset', 2) as t(u, q, s)")
    got = streaming.run_available(streaming.history(source(spark, tmp_path, df, "h"), most=2), "history_out", str(tmp_path / "c4"), "update")
    assert sorted((r.user_id, r.turns, r.last_question) for r in got.collect()) == [(1, 2, "three"), (2, 0, None)]
    acts = spark.sql("select 1L user_id, kind, timestamp'2026-01-01' + make_dt_interval(0, 0, 0, s) ts from values ('ask', 1), ('ask', 2), ('rate', 3), ('ask', 4) as t(kind, s)")
    gate = streaming.run_available(streaming.rating_gate(source(spark, tmp_path, acts, "g")), "gate_out", str(tmp_path / "c5"), "update")
    assert [(r.passed, r.blocked, r.rated) for r in gate.collect()] == [(2, 1, 1)]


def test_sync_batches(spark, tmp_path):
    state = {"points": spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "chunk_id string, content_sha256 string, text string")}
    snap = spark.createDataFrame([("b", "3", "z"), ("c", "4", "w")], "chunk_id string, content_sha256 string, text string").coalesce(1)
    q = streaming.sync_batches(source(spark, tmp_path, snap, "m"), lambda: state["points"], lambda df: state.update(points=spark.createDataFrame(df.collect(), df.schema)), lambda df: df)
    q = q.option("checkpointLocation", str(tmp_path / "c6")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert sorted(map(tuple, state["points"].collect())) == [("b", "3", "z"), ("c", "4", "w")]


def test_clamp(spark):
    assert spark.range(1).select(streaming.clamped(F.lit(99)).alias("v")).first()["v"] == 20
