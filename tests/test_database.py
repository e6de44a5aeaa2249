import math

import pytest
from pyspark.sql import functions as F

from fourfold.errors import FourfoldError, InvalidError, NotFoundError, QueryError
from fourfold.sources.database import Database

TOOLS = {
    "tool:saw": dict(label="Bow saw", kind="cut", grams=450, price=12.5, vec=[1.0, 0.0, 0.0]),
    "tool:axe": dict(label="axe", kind="cut", grams=900, price=-0.0, vec=[0.6, 0.8, 0.0], photo=b"\x07\x00"),
    "tool:ruler": dict(label="Ruler_30%", kind="measure", grams=35, vec=[0.0, 0.0, 2.0]),
    "tool:pen": dict(label="", kind="mark", price=1e-7),
    "tool:öl": dict(label="Öl", grams=-3, price=2.0**70),
}
MAKERS = {"maker:a": dict(label="Anvil & <Co>", since=1901), "maker:b": dict(label="Bolt"), "maker:c": dict(since=1987)}
LINKS = [("maker:a", "makes", "tool:saw"), ("maker:a", "makes", "tool:axe"), ("maker:b", "makes", "tool:ruler"), ("tool:saw", "beside", "tool:axe"), ("tool:axe", "beside", "tool:pen"), ("tool:pen", "beside", "tool:saw"), ("maker:b", "owns", "maker:a"), ("tool:ruler", "beside", "tool:ruler")]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, f"file://{tmp_path_factory.mktemp('db')}/main")

    def fill(tx):
        for k, v in {**TOOLS, **MAKERS}.items():
            tx.put(k, v)
        for link in LINKS:
            tx.link(*link)

    db.update(fill)
    return db


def rows(db, sql, *args):
    return [tuple(r) for r in db.query(sql, args).collect()]


#: What SQLite has no form for; the rest is held against SQLite in test_dialect.
CASES = [
    ("SELECT key FROM tool", [(k,) for k in sorted(TOOLS, key=str.encode)]),
    ("SELECT key FROM tool WHERE label LIKE '%r!_3%' ESCAPE '!'", [("tool:ruler",)]),
    ("SELECT key FROM tool WHERE label LIKE 'ö%'", []),
    ("SELECT 9223372036854775807 + 1, 9007199254740993 > 9007199254740992.0, 1 = 1.0", [(2.0**63, 1, 1)]),
    ("SELECT CAST(price AS TEXT) FROM tool WHERE price IS NOT NULL", [("0.0",), ("1.0e-07",), ("12.5",), ("1.1805916207174113e+21",)]),
    ("SELECT typeof(vec), length(vec) FROM tool WHERE key = 'tool:axe'", [("blob", 12)]),
    ("SELECT key, depth FROM walk('maker:a', 2)", [("tool:axe", 1), ("tool:saw", 1), ("tool:pen", 2)]),
    ("SELECT key, depth FROM walk('maker:b', 3, 'makes')", [("tool:ruler", 1)]),
    ("SELECT t.label FROM walk('maker:b', 3) w JOIN tool t ON t.key = w.key WHERE t.grams > 0", [("Ruler_30%",), ("axe",), ("Bow saw",)]),
    ("SELECT key FROM tool WHERE key IN (SELECT key FROM walk('tool:pen', 1))", [("tool:saw",)]),
    ("SELECT key FROM tool WHERE key NOT IN (SELECT value FROM json_each(walk('tool:pen', 9, 'beside', 'in')))", [("tool:pen",), ("tool:ruler",), ("tool:öl",)]),
    ("SELECT walk('maker:b', 1), walk('tool:öl', 1)", [('["maker:a","tool:ruler"]', "[]")]),
    ("SELECT (SELECT label FROM maker WHERE key = 'maker:a'), (SELECT label FROM maker WHERE key = 'maker:z')", [("Anvil & <Co>", None)]),
    ("SELECT key FROM tool WHERE vec IS NOT NULL ORDER BY distance(vec, vector('[1,0,0]')), key LIMIT 2", [("tool:saw",), ("tool:axe",)]),
    ("SELECT round(distance(vec, vector('[1,0,0]')), 6) AS d, count(*) FROM tool WHERE vec IS NOT NULL GROUP BY d ORDER BY 1", [(0.0, 1), (0.4, 1), (1.0, 1)]),
    ("SELECT key AS k FROM maker UNION SELECT dst FROM links WHERE type = 'owns' ORDER BY k LIMIT 2", [("maker:a",), ("maker:b",)]),
]


@pytest.mark.parametrize("sql, want", CASES, ids=[c[0][:60] for c in CASES])
def test_select(db, sql, want):
    assert rows(db, sql) == want


@pytest.mark.parametrize("sql, args", [("SELECT weight FROM tool", ()), ("SELECT key FROM shed", ()), ("SELECT ?", ()), ("SELECT 1", (2,)), ("SELECT 1; SELECT 2", ()), ("SELEKT 1", ()), ("SELECT key FROM tool WHERE count(*) > 1", ()), ("SELECT key FROM tool ORDER BY 3", ()), ("SELECT key FROM tool LIMIT 'x'", ()), ("SELECT * FROM walk('tool:axe', 33)", ()), ("SELECT 'a", ())])
def test_query_errors(db, sql, args):
    with pytest.raises(QueryError):
        db.query(sql, args).collect()


def test_marks_and_names(db):
    df = db.query('SELECT grams + ?, label AS t, "kind" FROM tool WHERE key = ?', (1, "tool:saw"))
    assert df.columns == ["grams + ?", "t", "kind"] and [tuple(r) for r in df.collect()] == [(451, "Bow saw", "cut")]


def test_records_links_and_rules(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.put("a:1", {"x": 1, "y": "t", "flag": True, "list": [1, 2]})
    db.put("a:1", {"y": None, "z": 2.5})
    assert db.get("a:1") == {"x": 1, "flag": 1, "list": "[1,2]", "z": 2.5}
    db.put_many({"a:2": {}, "b:1": {"vec": [1, 0]}})
    db.link("a:1", "to", "b:1"), db.link("a:1", "to", "b:1"), db.link("a:2", "see", "a:2")
    assert db.neighbours("a:1") == [("a:1", "to", "b:1")] and db.neighbours("a:2", "both") == [("a:2", "see", "a:2")]
    for bad in (lambda: db.put("A:1", {}), lambda: db.put("a:", {}), lambda: db.put("a:1", {"key": 1}), lambda: db.put("a:1", {"X": 1, "x": 2}), lambda: db.put("b:2", {"vec": [1, 2, 3]}), lambda: db.put("b:2", {"vec": [0, 0]}), lambda: db.put("a:1", {"x": math.inf}), lambda: db.link("a:1", "", "a:2"), lambda: db.nearest("b", [1.0], 1), lambda: db.walk("a:1", 33)):
        with pytest.raises(InvalidError):
            bad()
    for missing in (lambda: db.get("a:9"), lambda: db.delete("a:9"), lambda: db.link("a:1", "to", "a:9"), lambda: db.unlink("a:1", "no", "b:1"), lambda: db.drop("zz"), lambda: db.walk("a:9", 1)):
        with pytest.raises(NotFoundError):
            missing()

    def failing(tx):
        tx.put("a:3", {"x": 9})
        assert tx.get("a:3") == {"x": 9}
        mark = tx.mark()
        tx.delete("a:3")
        tx.rollback_to(mark)
        assert tx.get("a:3") == {"x": 9}
        raise RuntimeError

    with pytest.raises(RuntimeError):
        db.update(failing)
    assert [r["key"] for r in db.scan("a:")] == ["a:1", "a:2"] and [r["key"] for r in db.scan("a:", after="a:1", limit=1)] == ["a:2"]
    pinned = db.snapshot()
    db.delete("b:1")
    assert db.snapshot().links().count() == 1 and pinned.links().count() == 2
    db.put("b:1", {"vec": [0, 1]})
    assert db.nearest("b", [0.0, 1.0], 5) == [("b:1", 0.0)] and db.nearest("b", "b:1", 1) == [("b:1", 0.0)]
    before = db.check()
    db.compact()
    assert db.check() == before == {"tables": 2, "records": 3, "links": 1, "vectors": 1, "problems": []} and db.get("a:1")["z"] == 2.5
    assert db.execute("INSERT INTO a (key, x, y) VALUES ('a:7', 1 + 1, ?), ('a:8', 3, 'q')", ("p",)) == 2
    assert db.execute("UPDATE a SET x = x * 10, y = 'n' WHERE x >= 2") == 2 and db.get("a:8") == {"x": 30, "y": "n"}
    assert db.execute("DELETE FROM a WHERE x > 15") == 2 and db.execute("DELETE FROM a WHERE x > 15") == 0
    with pytest.raises(InvalidError):
        db.execute("INSERT INTO a (key, x) VALUES ('a:50', 1), ('a:1', 2)")
    assert [r["key"] for r in db.scan("a:")] == ["a:1", "a:2"]
    db.drop("a")
    assert db.snapshot().tables() == ["b"] and db.snapshot().links().count() == 0


def test_walks(spark):
    from fourfold.operators.graph import walk

    edges = spark.createDataFrame([("n:a", "next", "n:b"), ("n:b", "next", "n:c"), ("n:c", "next", "n:d"), ("n:d", "next", "n:a"), ("n:a", "see", "n:x")], "src string, type string, dst string")
    cases = [("n:a", "out", None, 1, "n:b@1 n:x@1"), ("n:a", "out", "next", 2, "n:b@1 n:c@2"), ("n:a", "out", None, 10, "n:b@1 n:x@1 n:c@2 n:d@3"), ("n:a", "in", None, 1, "n:d@1"), ("n:a", "in", None, 3, "n:d@1 n:c@2 n:b@3"), ("n:c", "both", "next", 1, "n:b@1 n:d@1"), ("n:x", "both", None, 2, "n:a@1 n:b@2 n:d@2"), ("n:x", "out", None, 5, "")]
    for start, way, kind, depth, want in cases:
        got = walk(edges, start, depth, kind, way).orderBy("depth", "key").collect()
        assert " ".join(f"{r.key}@{r.depth}" for r in got) == want, (start, way)


def test_adopt_export_import(spark, tmp_path, db):
    from fourfold.sources.jsonl import export, import_

    other = Database(spark, f"file://{tmp_path}/o")
    other.adopt("t", spark.createDataFrame([(1, True, [1.0, 2.0]), (2, None, None)], "id int, ok boolean, v array<double>"), "id", vec="v")
    assert other.get("t:1") == {"id": 1, "ok": 1, "vec": [1.0, 2.0]} if "id" in other.get("t:1") else other.get("t:1") == {"ok": 1, "vec": [1.0, 2.0]}
    export(db.snapshot(), f"file://{tmp_path}/dump")
    copy = Database(spark, f"file://{tmp_path}/copy")
    import_(copy, f"file://{tmp_path}/dump")
    for t in ("tool", "maker"):
        a, b = ({r.key: {k: v for k, v in r.asDict().items() if v is not None} for r in x.snapshot().table(t).collect()} for x in (db, copy))
        assert a == b
    assert sorted(copy.snapshot().links().collect()) == sorted(db.snapshot().links().collect())
    export(copy.snapshot(), f"file://{tmp_path}/again")
    read = lambda at: [r.value for r in spark.read.text(f"file://{tmp_path}/{at}").collect()]
    assert sorted(read("dump")) == sorted(read("again"))


def test_import_refuses_what_is_wrong(spark, tmp_path):
    from fourfold.sources.jsonl import import_

    head, end = '{"fourfold":"export","version":1}', '{"end":{"tables":1,"records":2,"links":1}}'
    body = ['{"table":"a","dims":2,"fields":["y","x"]}', '{"key":"a:1","fields":{"x":1,"vec":[1,0]}}', '{"key":"a:2","fields":{"x":2.5,"y":"t"}}', '{"from":"a:1","type":"to","to":"a:2"}']

    def load(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        db = Database(spark, f"file://{tmp_path}/db-{name}")
        return db, lambda: import_(db, f"file://{tmp_path}/{name}")

    db, run = load("good", head, *body, end)
    assert run() == {"tables": 1, "records": 2, "links": 1} and db.get("a:1") == {"x": 1.0, "vec": [1.0, 0.0]} and db.get("a:2") == {"x": 2.5, "y": "t"}
    assert db.snapshot().table("a").columns == ["key", "y", "x", "vec"] and db.neighbours("a:1") == [("a:1", "to", "a:2")] and db.check()["problems"] == []
    wrong = {
        "count": [head, *body[:2], *body[3:], end], "twice": [head, *body[:2], body[1], body[3], end], "end": [head, *body], "header": [*body, end], "link": [head, *body[:3], body[3].replace("a:2", "a:9"), end], "member": [head, body[0], '{"key":"a:1","fields":{"x":1,"x":2}}', *body[2:], end],
        "bool": [head, body[0], '{"key":"a:1","fields":{"x":true}}', *body[2:], end], "kinds": [head, body[0], '{"key":"a:1","fields":{"x":"t"}}', *body[2:], end], "table": [head, '{"table":"b","fields":[]}', *body[1:], end], "json": [head, "{", *body, end], "dims": [head, body[0].replace("2", "3"), *body[1:], end],
    }
    for name, lines in wrong.items():
        db, run = load(name, *lines)
        with pytest.raises(Exception) as e:
            run()
        assert isinstance(e.value, FourfoldError) and db.snapshot().tables() == [] and db.files.names(f"{db.root}/data") == [], name


def test_staging_is_linear_and_link_ends_are_checked_at_the_commit(spark, tmp_path):
    import time

    db = Database(spark, f"file://{tmp_path}/db")
    with db.begin() as tx:
        began = time.perf_counter()
        for i in range(20_000):
            tx.put(f"a:{i}", {"x": i})
            tx.link(f"a:{i}", "to", f"a:{i // 2}")
        assert time.perf_counter() - began < 10
    assert db.snapshot().links().count() == 20_000
    with pytest.raises(NotFoundError):
        db.update(lambda tx: [tx.put("a:new", {}), tx.link("a:new", "to", "a:77"), tx.link("a:5", "to", "a:none")])
    assert db.snapshot().table("a").count() == 20_000
    pinned = db.snapshot()
    db.put("a:x", {"x": 0})
    old = db.snapshot()
    db.compact()
    assert old.table("a").count() == 20_001 and db.walk("a:3", 2, None, "in")[:2] == [("a:6", 1), ("a:7", 1)]
    assert [r.key for r in db.snapshot().walked("a:0", 1, None, "both").collect()] == ["a:1"] and db.snapshot().manifest.links.reverse
    db.compact()
    assert pinned.manifest.version not in db._versions() and db.check()["problems"] == []


def _runs(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_adopt_checks_keys_while_it_writes(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    before = _runs(spark)
    db.adopt("a", spark.createDataFrame([(i, i * 2) for i in range(1_000)], "id long, x int").repartition(7), "id")
    assert _runs(spark) - before == 1  # one pass over the records, no second one to count keys
    files = sorted(f"{r.f}" for r in db.snapshot().table("a").select(F.input_file_name().alias("f")).distinct().collect())
    assert [r.key for f in files for r in spark.read.parquet(f).collect()] == sorted(f"a:{i}" for i in range(1_000))
    db.adopt("none", spark.createDataFrame([], "id long, x int"), "id")
    assert db.snapshot().table("none").count() == 0
    for rows in ([(str(i), 0) for i in range(500)] + [("77", 1)], [("1", 0), (None, 1)], [("", 0)], [("x\0y", 0)], [("k" * 1_023, 0)]):
        with pytest.raises(InvalidError):
            db.adopt("b", spark.createDataFrame(rows, "id string, x int"), "id")
    db.adopt("b", spark.createDataFrame([("k" * 1_022, 0)], "id string, x int"), "id")
    assert len(db.files.names(f"{db.root}/data")) == 3 and db.check()["problems"] == []


def test_first_links_in_bulk_are_read_without_a_fold(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    for t in ("a", "b", "c"):
        db.adopt(t, spark.range(50), "id")
    link = lambda *rows: spark.createDataFrame(rows, "src string, type string, dst string")
    for wrong in (("a:1", "to", "b:50"), ("none:1", "to", "b:1"), ("a:1", "to", None), (None, "to", "b:1"), ("a:1", "to", "b")):
        with pytest.raises(NotFoundError):
            db.add_links(link(("a:1", "to", "b:1"), wrong))
    assert db.snapshot().links().count() == 0 and len(db.files.names(f"{db.root}/data")) == 3
    db.add_links(link(("a:1", "to", "b:1"), ("a:1", "to", "b:1"), ("a:2", "to", "b:1"), ("b:1", "to", "a:3")))
    links = db.snapshot().links()
    assert links.count() == 3 and "Aggregate" not in links._jdf.queryExecution().toString()
    db.add_links(link(("a:1", "to", "b:1"), ("c:1", "of", "a:1")))
    assert db.snapshot().links().count() == 4
    db.delete("a:2")
    assert sorted(map(tuple, db.snapshot().links().collect())) == [("a:1", "to", "b:1"), ("b:1", "to", "a:3"), ("c:1", "of", "a:1")]
    assert db.walk("c:1", 4) == [("a:1", 1), ("b:1", 2), ("a:3", 3)]
    other = Database(spark, f"file://{tmp_path}/other")
    other.adopt("a", spark.range(9), "id")
    other.add_links(link(("a:2", "to", "a:1"), ("a:1", "to", "a:2")))
    other.compact()
    assert other.snapshot().manifest.links.reverse and [r.src for r in other.snapshot().links().collect()] == ["a:1", "a:2"]
    assert other.walk("a:1", 1, None, "in") == [("a:2", 1)] and other.check()["problems"] == []
