import numpy as np

from fourfold.operators import vectors


def test_any_number_of_queries(spark):
    rng = np.random.default_rng(4)
    table = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(60)] + [(90, [1.0, 2.0]), (91, None)]
    asked = [(i % 4_500, [float(x) for x in rng.integers(1, 9, 3)]) for i in range(4_600)] + [(5_000, [3.0, 1.0]), (5_001, None)]
    frame = lambda rows: spark.createDataFrame(rows, "key long, vec array<float>").repartition(3)
    got = vectors.nearest_many(frame(table), frame(asked), 4).collect()

    def brute(q):
        near = []
        for key, v in table:
            if v is not None and len(v) == len(q):
                lengths = np.linalg.norm(v) * np.linalg.norm(q)
                near.append((round(1 - float(np.dot(v, q)) / lengths, 6) if lengths else 1.0, key))
        return sorted(near)[:4]

    want = sorted((q, round(d, 6)) for q, v in asked if v is not None for d, _ in brute(v))
    assert sorted((r.query, round(r.distance, 6) + 0.0) for r in got) == want
    assert {r.query for r in got} == {q for q, v in asked if v is not None}


def test_ties_go_by_key(spark):
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "key long, vec array<float>").repartition(2)
    got = vectors.nearest_many(table, spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0])], "key long, vec array<float>"), 3)
    assert sorted((r.key, r["rank"]) for r in got.collect()) == [(0, 1), (0, 1), (1, 2), (1, 2), (2, 3), (2, 3)]
