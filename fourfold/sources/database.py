"""The database: record tables and links under one folder, versioned by manifests.

<root>/manifests/<version>.json lists each table's base and delta folders, fields and vector size, and those of the links. A commit writes
its changes as one delta per table and then creates the next manifest in one step, so readers see whole commits; a second writer finds
its version taken and fails. A read pins one manifest. Deltas are folded over the base by key when read, each field by the latest
change that set it; ``compact`` rewrites base and deltas, sorted by key. Nothing is rewritten by a put.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FourfoldError, InvalidError, NotFoundError
from ..operators import graph, vectors
from ..operators.rules import check_fields, check_table, check_type, table_of, valid_key, valid_rest
from .files import Files

FORMAT = 1
_SEQ, _DEL, _SET, _NORM = "__seq", "__del", "__set", "__norm"
#: Names that no field can have, and the text by which a failed write is known.
_ID, _NTH, _WRONG_KEY = "the id", "the nth", "fourfold: a key is not valid or not distinct"
LINK_SCHEMA = "src string, type string, dst string"


@dataclass
class TableInfo:
    """What a manifest knows of a table."""

    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)
    dims: int | None = None
    adopted: bool = False
    #: Of links: a copy of the base in the order of dst. Of a table with vectors: whether the base has their norms.
    reverse: str | None = None
    normed: bool = False


@dataclass
class Manifest:
    version: int
    tables: dict[str, TableInfo]
    links: TableInfo
    seq: int = 0

    def dump(self) -> str:
        return json.dumps({"format": FORMAT, "version": self.version, "seq": self.seq, "tables": {k: v.__dict__ for k, v in self.tables.items()}, "links": self.links.__dict__}, sort_keys=True)

    @classmethod
    def load(cls, text: str) -> Manifest:
        raw = json.loads(text)
        if raw["format"] > FORMAT:
            raise FourfoldError(f"the database has format {raw['format']}, newer than {FORMAT}")
        return cls(raw["version"], {k: TableInfo(**v) for k, v in raw["tables"].items()}, TableInfo(**raw["links"]), raw["seq"])


def _spark_type(value: Any) -> str:
    if isinstance(value, list):
        return "array<float>"
    return {bool: "bigint", int: "bigint", float: "double", str: "string", bytes: "binary"}[type(value)]


class Snapshot:
    """One moment of the database: DataFrames over files that no later commit changes."""

    def __init__(self, db: Database, manifest: Manifest):
        self.db, self.manifest, self.spark = db, manifest, db.spark

    def tables(self) -> list[str]:
        return sorted(self.manifest.tables)

    def has(self, table: str) -> bool:
        return table in self.manifest.tables

    def _info(self, table: str) -> TableInfo:
        if table not in self.manifest.tables:
            raise NotFoundError(f"there is no table {table!r}")
        return self.manifest.tables[table]

    def _schema(self, info: TableInfo) -> str:
        return ", ".join(["key string", *(f"`{f}` {info.kinds[f]}" for f in info.fields)])

    def table(self, table: str) -> DataFrame:
        """The records of a table: key and its fields in order."""
        info = self._info(table)
        wanted = self._schema(info)
        base = self.spark.read.schema(wanted).parquet(info.base) if info.base else self.spark.createDataFrame([], wanted)
        if not info.deltas:
            return base
        changes = self.spark.read.schema(f"{wanted}, {_SEQ} long, {_DEL} boolean, {_SET} array<string>").parquet(*info.deltas)
        old = base.withColumns({_SEQ: F.lit(0).cast("long"), _DEL: F.lit(False), _SET: F.array(*map(F.lit, info.fields)).cast("array<string>")})
        return fold(old.unionByName(changes), info.fields).select("key", *info.fields)

    def links(self, by: str = "src") -> DataFrame:
        """All links; read from the copy in the order of src or dst, if there is one."""
        info = self.manifest.links
        base = self.spark.read.schema(LINK_SCHEMA).parquet(info.reverse if by == "dst" and info.reverse else info.base) if info.base else self.spark.createDataFrame([], LINK_SCHEMA)
        if not info.deltas:
            return base
        changes = self.spark.read.schema(f"{LINK_SCHEMA}, {_SEQ} long, {_DEL} boolean").parquet(*info.deltas)
        both = base.withColumns({_SEQ: F.lit(0).cast("long"), _DEL: F.lit(False)}).unionByName(changes)
        last = both.where("type IS NOT NULL").groupBy("src", "type", "dst").agg(F.max(F.struct(_SEQ, _DEL)).alias("x"))
        cut_ = changes.where("type IS NULL").groupBy(F.col("src").alias("key")).agg(F.max(_SEQ).alias("gone"))  # a record that was deleted
        rows = last.where(~F.col("x")[_DEL])
        for end in ("src", "dst"):
            rows = rows.join(cut_.select(F.col("key").alias(end), F.col("gone").alias(f"gone_{end}")), end, "left").where(F.coalesce(F.col(f"gone_{end}"), F.lit(-1)) < F.col("x")[_SEQ])
        return rows.select("src", "type", "dst")

    def keys(self) -> DataFrame:
        out = self.spark.createDataFrame([], "key string")
        for t in self.tables():
            out = out.unionAll(self.table(t).select("key"))
        return out

    def get(self, key: str) -> dict[str, Any]:
        table = table_of(key)
        rows = self.table(table).where(F.col("key") == key).take(1) if self.has(table) else []
        if not rows:
            raise NotFoundError(f"there is no record {key!r}")
        return {k: v for k, v in rows[0].asDict().items() if k != "key" and v is not None}

    def scan(self, prefix: str, after: str = "", limit: int = 1000) -> list[dict[str, Any]]:
        """Records whose keys start with ``prefix`` and come after ``after``, in key order, without vectors."""
        table = check_table(prefix.partition(":")[0])
        if limit < 1:
            raise InvalidError("a scan's limit is 1 at least")
        if not self.has(table):
            return []
        rows = self.table(table).where(F.col("key").startswith(prefix) & (F.col("key") > after))
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows.drop("vec").orderBy("key").limit(limit).collect()]

    def neighbours(self, key: str, direction: str = "out", type_: str | None = None) -> list[tuple[str, str, str]]:
        self.get(key)
        return [tuple(r) for r in graph.neighbours(self.links(), key, direction, type_, self.links("dst")).collect()]

    def walk(self, start: str, depth: int, type_: str | None = None, direction: str | None = "out") -> DataFrame:
        graph.direction_of(direction)
        if not 1 <= depth <= graph.MAX_DEPTH:
            raise InvalidError(f"a walk's depth is from 1 to {graph.MAX_DEPTH}")
        self.get(start)
        return self.walked(start, depth, type_, direction).orderBy("depth", "key")

    def walked(self, start: str, depth: int, type_: str | None = None, direction: str | None = "out") -> DataFrame:
        """The rows of a walk, in no order; a start that is not there reaches nothing."""
        return graph.walk(self.links(), start, depth, type_, direction, self.links("dst"))

    def nearest(self, table: str, query: Sequence[float] | str, k: int, where: Column | str | None = None) -> DataFrame:
        """The k nearest records; ``query`` is a vector or the key of a record that has one."""
        check_table(table)
        if isinstance(query, str):
            query = self.get(query).get("vec") or []
        q = vectors.check_vector(query)
        if not 1 <= k <= vectors.MAX_K:
            raise InvalidError(f"k must be from 1 to {vectors.MAX_K}")
        info = self._info(table)
        if info.dims is None:
            return self.spark.createDataFrame([], "key string, distance double")
        if len(q) != info.dims:
            raise InvalidError(f"the query has {len(q)} values, the table's vectors {info.dims}")
        if info.normed and not info.deltas:
            rows = self.spark.read.schema(f"{self._schema(info)}, {_NORM} double").parquet(info.base)
            return vectors.nearest(rows, q, k, where, norms=_NORM)
        return vectors.nearest(self.table(table), q, k, where)

    def sql(self, text: str, args: Sequence[Any] = ()) -> DataFrame:
        from ..plans.sql import select

        return select(self, text, list(args))


def fold(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The records that a change list leaves: per key the latest value of each field since the last deletion. One shuffle, combined first."""
    seq, dead = F.col(_SEQ), F.col(_DEL)
    latest = [F.max(F.when(~dead & F.array_contains(_SET, f), F.struct(seq.alias("s"), F.col(f"`{f}`").alias("v")))).alias(f) if f != "vec" else F.max_by(F.struct(seq.alias("s"), F.col("vec").alias("v")), F.when(~dead & F.array_contains(_SET, "vec"), seq)).alias("vec") for f in fields]
    per = changes.groupBy("key").agg(F.coalesce(F.max(F.when(dead, seq)), F.lit(-1)).alias("__gone"), F.coalesce(F.max(F.when(~dead, seq)), F.lit(-1)).alias("__put"), *latest)
    return per.where(F.col("__put") > F.col("__gone")).select("key", *(F.when(F.col(f"`{f}`.s") > F.col("__gone"), F.col(f"`{f}`.v")).alias(f) for f in fields))


class Transaction:
    """Staged changes over one snapshot; reads see them. Marks undo what came after. What is staged is found by key, so that a put costs the same
    whatever was staged before; that the ends of links are stored is checked once, at the commit."""

    def __init__(self, snapshot: Snapshot):
        self.base = snapshot
        self.ops: list[tuple] = []
        self._reset()

    def _reset(self) -> None:
        self._by_key: dict[str, list[tuple]] = {}
        self._dropped: set[str] = set()
        self._fields: dict[str, tuple[dict[str, str], int | None]] = {}
        self._bulk = False
        self._seen = 0

    def _index(self) -> None:
        """Take in what was staged since the last look."""
        for op in self.ops[self._seen :]:
            if op[0] in ("put", "delete"):
                self._by_key.setdefault(op[1], []).append(op)
            if op[0] == "put":
                names, dims = self._table_state(table_of(op[1]))
                for f, v in op[2].items():
                    names.setdefault(f.lower(), f)
                    if f == "vec" and v is not None and dims is None:
                        dims = len(v)
                self._fields[table_of(op[1])] = names, dims
            elif op[0] == "drop":
                self._dropped.add(op[1])
                self._fields[op[1]] = {}, None
                for key in [k for k in self._by_key if table_of(k) == op[1]]:
                    del self._by_key[key]
            self._bulk |= op[0] == "bulk"
        self._seen = len(self.ops)

    def _table_state(self, table: str) -> tuple[dict[str, str], int | None]:
        """Fields by lower-cased name, and the vector size, with staged puts counted in."""
        if table not in self._fields:
            info = self.base.manifest.tables.get(table)
            self._fields[table] = ({f.lower(): f for f in info.fields}, info.dims) if info else ({}, None)
        return self._fields[table]

    def mark(self) -> int:
        return len(self.ops)

    def rollback_to(self, mark: int) -> None:
        del self.ops[mark:]
        self._reset()

    def _about(self, key: str) -> list[tuple]:
        self._index()
        if self._bulk:
            raise FourfoldError("a write statement's records are seen once it is committed")
        return ([("drop",)] if table_of(key) in self._dropped else []) + self._by_key.get(key, [])

    def get(self, key: str) -> dict[str, Any]:
        found: dict[str, Any] | None = None
        loaded = False
        for op in self._about(key):
            if op[0] == "put":
                if not loaded and found is None:
                    found = self._stored(key) or {}
                loaded = True
                found = {k: v for k, v in {**(found or {}), **op[2]}.items() if v is not None}
            else:
                found, loaded = None, True
        if not loaded:
            found = self._stored(key)
        if found is None:
            raise NotFoundError(f"there is no record {key!r}")
        return found

    def _stored(self, key: str) -> dict[str, Any] | None:
        try:
            return self.base.get(key)
        except NotFoundError:
            return None

    def exists(self, key: str) -> bool:
        about = self._about(key)
        return about[-1][0] == "put" if about else self._stored(key) is not None

    def put(self, key: str, fields: Mapping[str, Any]) -> None:
        """Given fields replace, others stay, None clears; the table and new fields appear."""
        table = table_of(key)
        checked = check_fields(fields)
        self._index()
        names, dims = self._table_state(table)
        checked = {names.get(f.lower(), f): v for f, v in checked.items()}
        if checked.get("vec") is not None and dims is not None:
            vectors.check_vector(checked["vec"], dims)
        self.ops.append(("put", key, checked))

    def delete(self, key: str) -> None:
        """The record and its links both ways."""
        if not self.exists(key):
            raise NotFoundError(f"there is no record {key!r}")
        self.ops.append(("delete", key))

    def drop(self, table: str) -> None:
        check_table(table)
        if not self.base.has(table) and not any(op[0] == "put" and table_of(op[1]) == table for op in self.ops):
            raise NotFoundError(f"there is no table {table!r}")
        self.ops.append(("drop", table))

    def link(self, src: str, type_: str, dst: str) -> None:
        """Add a link; a second time changes nothing. Both ends must exist: those that are not staged are looked up together at the commit."""
        check_type(type_)
        for key in (src, dst):
            about = self._about(key)
            if about and about[-1][0] != "put" or not about and not self.base.has(table_of(key)):
                raise NotFoundError(f"there is no record {key!r}")
        self.ops.append(("link", src, type_, dst, tuple(k for k in (src, dst) if not self._about(k))))

    def check_ends(self) -> None:
        """Whether the ends of staged links that were not staged themselves are stored: one anti-join for each table."""
        wanted: dict[str, set[str]] = {}
        for op in self.ops:
            for key in op[4] if op[0] == "link" and len(op) > 4 else ():
                wanted.setdefault(table_of(key), set()).add(key)
        for table, keys in wanted.items():
            asked = self.base.spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
            stored = self.base.table(table).select("key")
            if len(keys) <= graph.PRUNE_KEYS:
                stored = stored.where(F.col("key").isin(sorted(keys)))
            if lost := asked.join(stored, "key", "left_anti").take(1):
                raise NotFoundError(f"there is no record {lost[0].key!r}")

    def links_at(self, src: str, dst: str) -> set[str]:
        stored = {r.type for r in self.base.links().where((F.col("src") == src) & (F.col("dst") == dst)).select("type").collect()}
        for op in self.ops:
            if op[0] == "link" and op[1] == src and op[3] == dst:
                stored.add(op[2])
            elif op[0] == "unlink" and op[1] == src and op[3] == dst:
                stored.discard(op[2])
            elif op[0] == "delete" and op[1] in (src, dst) or op[0] == "drop" and op[1] in (table_of(src), table_of(dst)):
                stored.clear()
        return stored

    def unlink(self, src: str, type_: str, dst: str) -> None:
        """Take away a link, or with an empty type all links from src to dst."""
        there = self.links_at(src, dst)
        gone = there & {type_} if type_ else there
        if not gone:
            raise NotFoundError("there is no such link")
        for t in sorted(gone):
            self.ops.append(("unlink", src, t, dst))


class Database:
    """A database at ``root``, made if it is not there."""

    def __init__(self, spark: SparkSession, root: str):
        if not root or root == ":memory:":
            raise InvalidError("a database needs a folder")
        self.spark, self.root, self.files, self._open = spark, root.rstrip("/"), Files(spark, root), True
        self.files.mkdirs(f"{self.root}/manifests")
        if not self._versions():
            self.files.create(self._manifest_path(0), Manifest(0, {}, TableInfo()).dump())
        self.manifest()

    @property
    def path(self) -> str:
        return self.root

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> Manifest:
        if not self._open:
            raise FourfoldError("the database is closed")
        return Manifest.load(self.files.read(self._manifest_path(self._versions()[-1] if version is None else version)))

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    def _commit(self, manifest: Manifest) -> None:
        manifest.version += 1
        if not self.files.create(self._manifest_path(manifest.version), manifest.dump()):
            raise FourfoldError("another writer committed first")

    def _place(self, what: str) -> str:
        return f"{self.root}/data/{what}-{uuid.uuid4().hex}"

    @contextmanager
    def begin(self):
        """A transaction: committed at the end of the block, dropped by an exception."""
        tx = Transaction(self.snapshot())
        yield tx
        self._apply(tx)

    def update(self, change: Callable[[Transaction], Any]) -> Any:
        with self.begin() as tx:
            return change(tx)

    def _apply(self, tx: Transaction) -> None:
        if not tx.ops:
            return
        tx.check_ends()
        m, seq = tx.base.manifest, tx.base.manifest.seq
        rows: dict[str, list[tuple[int, bool, str, dict]]] = {}
        links: list[tuple] = []
        for op in tx.ops:
            seq += 1
            if op[0] == "put":
                rows.setdefault(table_of(op[1]), []).append((seq, False, op[1], op[2]))
            elif op[0] == "delete":
                rows.setdefault(table_of(op[1]), []).append((seq, True, op[1], {}))
                links.append((op[1], None, None, seq, True))
            elif op[0] == "bulk":
                for f in op[4]:
                    self._widen(m, op[1], f)
                m.tables[op[1]].deltas.append(op[2])
                if op[3]:
                    m.links.deltas.append(op[3])
            elif op[0] == "drop":
                rows.pop(op[1], None)
                m.tables.pop(op[1], None)
                m.links = self._without_table(tx.base, m.links, op[1])
                links = [x for x in links if x[1] is None or op[1] not in (table_of(x[0]), table_of(x[2]))]
            else:
                links.append((op[1], op[2], op[3], seq, op[0] == "unlink"))
        for table, changes in rows.items():
            self._delta(m, table, changes)
        if links:
            at = self._place("links")
            self.spark.createDataFrame(links, f"{LINK_SCHEMA}, {_SEQ} long, {_DEL} boolean").coalesce(1).write.parquet(at)
            m.links.deltas.append(at)
        m.seq = seq
        self._commit(m)

    def write_cascade(self, gone: DataFrame) -> str:
        """A delta of the links that go with deleted records (key, __seq): where it is."""
        at, none = self._place("links"), F.lit(None).cast("string")
        gone.select(F.col("key").alias("src"), none.alias("type"), none.alias("dst"), _SEQ, F.lit(True).alias(_DEL)).write.parquet(at)
        return at

    def _without_table(self, snapshot: Snapshot, info: TableInfo, table: str) -> TableInfo:
        at = self._place("links")
        keep = ~F.col("src").startswith(f"{table}:") & ~F.col("dst").startswith(f"{table}:")
        snapshot.links().where(keep).write.parquet(at)
        return TableInfo(base=at)

    def _delta(self, m: Manifest, table: str, changes: list[tuple[int, bool, str, dict]]) -> None:
        info = m.tables.setdefault(table, TableInfo())
        for _, _, _, fields in changes:
            for f in sorted(set(fields) - set(info.fields)):
                info.fields.append(f)
            for f, v in fields.items():
                if v is None:
                    info.kinds.setdefault(f, "string")
                    continue
                kind = _spark_type(v)
                if f == "vec":
                    info.dims = info.dims or len(v)
                was = info.kinds.get(f)
                if was is None:
                    info.kinds[f] = kind
                elif was != kind:
                    if {was, kind} != {"bigint", "double"}:
                        raise InvalidError(f"field {f!r} of {table!r} holds {was}, not {kind}")
                    if was == "bigint":
                        self._widen(m, table, f)
        if len(info.fields) > 1_999:
            raise InvalidError("a table has 1,999 fields at most")
        cast = {"bigint": int, "double": float}
        data = [(key, *(cast.get(info.kinds[f], lambda v: v)(fields[f]) if fields.get(f) is not None else None for f in info.fields), seq, dead, sorted(fields)) for seq, dead, key, fields in changes]
        schema = ", ".join(["key string", *(f"`{f}` {info.kinds[f]}" for f in info.fields), f"{_SEQ} long", f"{_DEL} boolean", f"{_SET} array<string>"])
        at = self._place(table)
        self.spark.createDataFrame(data, schema).coalesce(1).write.parquet(at)
        info.deltas.append(at)

    def _widen(self, m: Manifest, table: str, name: str) -> None:
        """An integer field that gets a real becomes real throughout."""
        info = m.tables[table]
        if info.base or info.deltas:
            old = Snapshot(self, m).table(table)
            at = self._place(table)
            old.withColumn(name, F.col(name).cast("double")).write.parquet(at)
            info.base, info.deltas, info.normed = at, [], False
        info.kinds[name] = "double"

    # One-step forms.
    def get(self, key: str) -> dict[str, Any]:
        return self.snapshot().get(key)

    def put(self, key: str, fields: Mapping[str, Any]) -> None:
        self.update(lambda tx: tx.put(key, fields))

    def put_many(self, records: Mapping[str, Mapping[str, Any]]) -> None:
        self.update(lambda tx: [tx.put(k, v) for k, v in records.items()])

    def delete(self, key: str) -> None:
        self.update(lambda tx: tx.delete(key))

    def drop(self, table: str) -> None:
        self.update(lambda tx: tx.drop(table))

    def link(self, src: str, type_: str, dst: str) -> None:
        self.update(lambda tx: tx.link(src, type_, dst))

    def unlink(self, src: str, type_: str, dst: str) -> None:
        self.update(lambda tx: tx.unlink(src, type_, dst))

    def scan(self, prefix: str, after: str = "", limit: int = 1000) -> list[dict[str, Any]]:
        return self.snapshot().scan(prefix, after, limit)

    def neighbours(self, key: str, direction: str = "out", type_: str | None = None) -> list[tuple[str, str, str]]:
        return self.snapshot().neighbours(key, direction, type_)

    def walk(self, start: str, depth: int, type_: str | None = None, direction: str | None = "out") -> list[tuple[str, int]]:
        return [tuple(r) for r in self.snapshot().walk(start, depth, type_, direction).collect()]

    def nearest(self, table: str, query: Sequence[float] | str, k: int, where: Column | str | None = None) -> list[tuple[str, float]]:
        return [tuple(r) for r in self.snapshot().nearest(table, query, k, where).collect()]

    def query(self, text: str, args: Sequence[Any] = ()) -> DataFrame:
        return self.snapshot().sql(text, args)

    def execute(self, text: str, args: Sequence[Any] = ()) -> int:
        """Run INSERT, REPLACE, UPDATE or DELETE: how many records it changed, all or nothing. Also CREATE, DROP and ALTER TABLE, and VACUUM."""
        from ..plans.changes import define
        from ..plans.sql import write

        done = define(self, text)
        return self.update(lambda tx: write(tx, text, list(args))) if done is None else done

    def returning(self, text: str, args: Sequence[Any] = ()) -> DataFrame:
        """Run a write statement: the columns of its RETURNING (the keys without one) for the records it changed."""
        from ..plans.changes import change, returned

        before = self.snapshot()
        return returned(self, before, self.update(lambda tx: change(tx, text, list(args))))

    def install(self, tables: dict[str, dict[str, Any]], links: str) -> None:
        """Make folders of written records (sorted by key) and links the tables of an empty database, in one commit."""
        m = self.manifest()
        if m.tables:
            raise InvalidError("the database is not empty")
        m.tables = {name: TableInfo(**info) for name, info in tables.items()}
        m.links = TableInfo(base=links)
        self._commit(m)

    def define(self, table: str, fields: list[tuple[str, str]], new: bool) -> None:
        """An empty record table, or more fields of one; each field with the kind it will hold."""
        check_table(table)
        check_fields(dict.fromkeys(f for f, _ in fields if f.lower() != "vec"))
        m = self.manifest()
        if new == (table in m.tables):
            raise InvalidError(f"there is a table {table!r} already" if new else f"there is no table {table!r}")
        info = m.tables.setdefault(table, TableInfo())
        for f, kind in fields:
            if f.lower() in [x.lower() for x in info.fields]:
                raise InvalidError(f"duplicate column name: {f}")
            info.fields.append(f)
            info.kinds[f] = "array<float>" if f == "vec" else kind
        self._commit(m)

    # Bulk forms.
    def adopt(self, table: str, df: DataFrame, key: str | Column, *, vec: str | None = None) -> None:
        """Make a DataFrame a record table: ``key`` (a column's values follow "<table>:") and its columns as fields."""
        check_table(table)
        m = self.manifest()
        if table in m.tables:
            raise InvalidError(f"there is a table {table!r} already")
        ident = F.col(key) if isinstance(key, str) else key
        rest = [c for c in df.columns if c != vec and not (isinstance(key, str) and c == key) or c == key]
        check_fields(dict.fromkeys(c for c in rest if c.lower() != "vec"))
        # Sorted by what follows the table's name, the same order with shorter comparisons; equal keys end side by side in one partition, so the window
        # that finds them needs no shuffle. Columns are put in their stored form after the shuffle, which its sampling pass then does not do as well.
        alike = Window.partitionBy(_ID).orderBy(_ID)
        rows = df.withColumn(_ID, ident.cast("string")).repartitionByRange(_ID).withColumn(_NTH, F.row_number().over(alike)).sortWithinPartitions(_ID)
        wrong = ~valid_rest(table, F.col(_ID)) | (F.col(_NTH) > 1)
        checked = F.when(wrong, F.raise_error(F.lit(_WRONG_KEY))).otherwise(F.concat(F.lit(f"{table}:"), _ID)).alias("key")
        rows = rows.select(checked, *(_stored_column(df, c) for c in rest), *([F.col(vec).cast("array<float>").alias("vec")] if vec else []))
        at = self._place(table)
        if vec:
            rows = rows.withColumn(_NORM, vectors.norm(F.col("vec")))
        try:
            rows.write.parquet(at)
        except Exception as e:
            self.files.delete(at)
            if _WRONG_KEY in str(e):
                raise InvalidError("keys must be valid and distinct") from None
            raise
        stored = self.spark.read.parquet(at).drop(_NORM)
        dims = [r[0] for r in stored.where("vec IS NOT NULL").select(F.size("vec")).distinct().limit(2).collect()] if vec else []
        if len(dims) > 1:
            self.files.delete(at)
            raise InvalidError("vectors must have one size")
        fields = [f.name for f in stored.schema if f.name != "key"]
        m.tables[table] = TableInfo(base=at, fields=fields, kinds={f.name: f.dataType.simpleString() for f in stored.schema if f.name != "key"}, dims=dims[0] if dims else None, adopted=True, normed=bool(vec))
        self._commit(m)

    def add_links(self, links: DataFrame) -> None:
        """Links in bulk (src, type, dst), distinct; both ends must exist. They are written once and their ends checked as written, against the keys of
        the tables that they name. The first ones become the base, which is read without a fold; a compaction puts it in order."""
        m, snap = self.manifest(), self.snapshot()
        at = self._place("links")
        m.seq += 1
        links.select("src", "type", "dst").distinct().withColumns({_SEQ: F.lit(m.seq).cast("long"), _DEL: F.lit(False)}).write.parquet(at)
        written = self.spark.read.schema(LINK_SCHEMA).parquet(at)
        if self._lost_end(snap, written):
            self.files.delete(at)
            raise NotFoundError("a link's end is not there")
        if m.links.base or m.links.deltas:
            m.links.deltas.append(at)
        else:
            m.links.base = at
        self._commit(m)

    def _lost_end(self, snap: Snapshot, links: DataFrame) -> bool:
        """Whether an end of a link is no stored record. Ends and keys meet in one aggregation, which combines the ends of a hub before its shuffle."""
        named = [F.substring_index(end, ":", 1) for end in ("src", "dst")]
        found = [r[0] for r in links.select(F.explode(F.array(*(F.when(t.isin(snap.tables()), t) for t in named)))).distinct().collect()]
        if None in found:
            return True
        both = links.select(F.col("src").alias("key"), F.lit(False).alias("stored")).unionAll(links.select("dst", F.lit(False)))
        for table in found:
            both = both.unionAll(snap.table(table).select("key", F.lit(True)))
        return not both.groupBy("key").agg(F.max("stored").alias("stored")).where("NOT stored").isEmpty()

    def compact(self, keep: int = 2) -> None:
        """Live data only: every table and the links rewritten, sorted, without deltas; links a second time in the order of dst. The last ``keep``
        versions stay readable (this one and the one before), older ones are removed."""
        m, snap = self.manifest(), self.snapshot()
        for name, info in m.tables.items():
            if info.deltas:
                at = self._place(name)
                rows, info.normed = snap.table(name), "vec" in info.fields
                rows = rows.withColumn(_NORM, vectors.norm(F.col("vec"))) if info.normed else rows
                rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(at)
                info.base, info.deltas = at, []
        if m.links.deltas or m.links.base and not m.links.reverse:
            at = self._place("links")
            snap.links().repartitionByRange("src").sortWithinPartitions("src", "type", "dst").write.parquet(at)
            back = self._place("links")
            snap.links().repartitionByRange("dst").sortWithinPartitions("dst", "type", "src").write.parquet(back)
            m.links = TableInfo(base=at, reverse=back)
        self._commit(m)
        versions = self._versions()
        kept = [self.manifest(v) for v in versions[-max(1, keep) :]]
        live = {at for m in kept for i in [*m.tables.values(), m.links] for at in (i.base, i.reverse, *i.deltas)}
        for name in self.files.names(f"{self.root}/data"):
            if f"{self.root}/data/{name}" not in live:
                self.files.delete(f"{self.root}/data/{name}")
        for version in versions[: -len(kept)]:
            self.files.delete(self._manifest_path(version))

    def check(self) -> dict[str, Any]:
        """Counts, and what disagrees: commits that are missing or out of order, bad keys, repeated keys, links without ends, bad vectors. Each
        check of records is one aggregation or anti-join."""
        snap, problems = self.snapshot(), []
        versions = self._versions()
        problems += [f"commits: {v} is missing" for a, b in zip(versions, versions[1:]) for v in range(a + 1, b)]
        seqs = [self.manifest(v).seq for v in versions]
        problems += [f"commits: {v} goes back in its changes" for v, a, b in zip(versions[1:], seqs, seqs[1:]) if b < a]
        out = {"tables": len(snap.tables()), "records": 0, "links": 0, "vectors": 0}
        for name in snap.tables():
            df, dims = snap.table(name), snap.manifest.tables[name].dims
            aggs = [F.count("*"), F.count_distinct("key"), F.count_if(~valid_key(F.col("key")) | ~F.col("key").startswith(f"{name}:"))]
            has = "vec" in df.columns
            wrong = (F.size("vec") != (dims or 0)) | F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("vec", lambda x: x == 0) if has else F.lit(False)
            n, distinct, bad, vecs, bad_vecs = df.agg(*aggs, F.count("vec") if has else F.lit(0), F.count_if(F.col("vec").isNotNull() & wrong) if has else F.lit(0)).first()
            out["records"] += n
            out["vectors"] += vecs
            problems += [f"{name}: {c} {what}" for c, what in ((n - distinct, "repeated keys"), (bad, "bad keys"), (bad_vecs, "bad vectors")) if c]
        links, keys = snap.links(), snap.keys()
        out["links"] = links.count()
        for end in ("src", "dst"):
            if lost := links.join(keys.withColumnRenamed("key", end), end, "left_anti").count():
                problems.append(f"links: {lost} without {end}")
        return out | {"problems": problems}


def _stored_column(df: DataFrame, name: str) -> Column:
    """A column as it is stored: booleans and small integers as bigint, times as RFC 3339 text, nested values as JSON text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
        return F.col(name).cast("long").alias(name)
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return F.col(name).cast("double").alias(name)
    if isinstance(kind, T.DateType):
        return F.date_format(name, "yyyy-MM-dd").alias(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) and name != "vec":
        return F.to_json(name).alias(name)
    return F.col(name)
