import json

from pyspark.sql import functions as F

from fourfold.__main__ import main
from fourfold.sources.database import Database
from fourfold.streaming import events
from fourfold.streaming.follow import Follower, change_stream, latest_per_key


def test_cli(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/db"
    assert main([root, "put", "a:1", '{"x": 1, "vec": [1, 0]}'], spark) == 0
    assert main([root, "put", "a:2", '{"x": 2}'], spark) == 0 and main([root, "link", "a:1", "to", "a:2"], spark) == 0
    for args, want in ((["get", "a:2"], {"x": 2}), (["walk", "a:1", "1"], {"key": "a:2", "depth": 1}), (["nearest", "a", "[1, 0]", "3"], {"key": "a:1", "distance": 0.0}), (["sql", "SELECT count(*) AS n FROM a"], {"n": 2}), (["version"], None)):
        capsys.readouterr()
        assert main([root, *args], spark) == 0
        got = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert want is None or got == want
    assert main([root, "get", "a:9"], spark) == 1 and "not found" in capsys.readouterr().err


def test_follower(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    follower, seen = Follower(db), []
    db.put("a:1", {"x": 1})
    db.put("a:2", {"x": 2})
    take = lambda t, df: seen.extend((t, r.key) for r in df.select("key").collect())
    assert follower.poll(take) == 2 and seen == [("a", "a:1"), ("a", "a:2")] and follower.poll(take) == 0
    db.put("a:3", {"x": 3})
    assert follower.poll(take) == 1 and seen[-1] == ("a", "a:3")


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2026-01-01 00:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(200)], "event_id long, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = "event_id long, ts timestamp_ntz, user_id int, event_type string, value double"
    for name, make in (("t", lambda x: events.tumbling(x, "10 minutes")), ("l", lambda x: latest_per_key(x, "user_id", "event_id")), ("s", lambda x: events.sliding(x, "20 minutes", "10 minutes"))):
        q = make(change_stream(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(f"out_{name}").collect())) == sorted(map(str, make(df).collect()))
