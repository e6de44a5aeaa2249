"""Write statements beyond the subset: INSERT from a query, REPLACE and conflict clauses, UPDATE and DELETE with any expression, RETURNING, and the
forms of DDL that have a meaning here. New values are worked out by Spark's own tasks and go straight into a delta; checks are aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FourfoldError, InvalidError, NotFoundError, QueryError
from ..operators.rules import valid_key
from .dialect import Columns, Reader, Scope, Writer, _name, run

_STORED = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary", "vector": "array<float>"}


@dataclass
class Change:
    """What a statement did: records, and for RETURNING the result columns and where the changed keys are."""

    table: str
    count: int = 0
    returning: list = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    gone: bool = False


def change(tx, text: str, args: list[Any]) -> Change:
    r = Reader(text, args)
    if tx.ops:
        raise QueryError("statements see stored records only: commit what is staged first")
    return _insert(tx, r) if r.at("insert", "replace") else _update(tx, r) if r.at("update") else _delete(tx, r)


def _table(tx, r: Reader) -> str:
    name = r.name().lower()
    if not tx.base.has(name):
        raise QueryError(f"no such table: {name}")
    return name


def _ending(r: Reader, out: Change) -> None:
    if r.take("returning"):
        out.returning = r.listed(r.column)
    r.finish()


def _field(tx, table: str, name: str) -> str:
    found = next((f for f in tx.base.manifest.tables[table].fields if f.lower() == name.lower()), None)
    if found is None:
        raise QueryError(f"table {table} has no column named {name}")
    return found


def _insert(tx, r: Reader) -> Change:
    how = "replace" if r.take("replace") else ""
    if not how:
        r.need("insert")
        how = r.need("replace", "ignore", "abort", "fail", "rollback") if r.take("or") else ""
    r.need("into")
    out = Change(_table(tx, r))
    names = r.row_names() if r.at("(") else ["key", *tx.base.manifest.tables[out.table].fields]
    fields = [n for n in names if n.lower() != "key"]
    if len(fields) != len(names) - 1:
        raise QueryError("NOT NULL constraint failed: key")
    fields = {n: _field(tx, out.table, n) for n in fields}
    if r.at("default"):
        raise QueryError("NOT NULL constraint failed: key")
    q = r.query()
    sets, where = None, None
    if r.take("on"):
        r.need("conflict")
        if r.take("("):
            if r.name().lower() != "key":
                raise QueryError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
            r.need(")")
        r.need("do")
        if r.take("nothing"):
            how = "ignore"
        else:
            r.need("update")
            how, sets = "update", _sets(tx, r, out.table)
            where = r.expr() if r.take("where") else None
    _ending(r, out)
    rows = run(tx.base, q)
    if len(rows.columns) != len(names):
        raise QueryError(f"{len(rows.columns)} values for {len(names)} columns")
    rows = rows.toDF(*("key" if n.lower() == "key" else fields[n] for n in names))
    at = tx.base.db._place(out.table)
    rows.write.parquet(at)
    try:
        rows = tx.base.spark.read.schema(rows.schema).parquet(at)
        key = F.col("key")
        n, distinct, without, wrong = rows.agg(F.count("*"), F.count_distinct("key"), F.count_if(key.isNull()), F.count_if(~valid_key(key) | ~key.startswith(f"{out.table}:"))).first()
        if without or "string" != rows.schema["key"].dataType.simpleString():
            raise QueryError("NOT NULL constraint failed: key")
        if wrong:
            raise InvalidError(f"a key is no key of {out.table!r}")
        if distinct != n:
            raise InvalidError("UNIQUE constraint failed: a key is given twice")
        stored = tx.base.table(out.table)
        taken = stored.select("key")
        fresh = rows if how == "replace" else rows.join(taken, "key", "left_anti")
        if how not in ("replace", "ignore", "update") and fresh.count() != n:
            raise InvalidError("UNIQUE constraint failed: a key is taken")
        every = tx.base.manifest.tables[out.table].fields
        _stage(tx, out, fresh, every if how == "replace" else list(fields.values()))
        if how == "update":
            w, scope = Writer(tx.base), Scope()
            name, columns = w.view(out.table, lambda: stored)
            given, _ = w.view("excluded", lambda: rows)
            scope.sources = {out.table: columns, "excluded": Columns([(f, columns.get(f.lower(), "text")) for f in rows.columns])}
            origin = f"{name} AS {_name(out.table)} JOIN {given} AS excluded ON excluded.key = {_name(out.table)}.key"
            _stage(tx, out, _new_values(w, scope, origin, out.table, sets, where), list(sets), bare=out.table)
    finally:
        tx.base.db.files.delete(at)
    return out


def _sets(tx, r: Reader, table: str) -> dict:
    r.need("set")
    out = {}
    for name, e in r.listed(lambda: (r.name(), r.need("="), r.expr())[::2]):
        if name.lower() == "key":
            raise InvalidError("a key cannot change")
        out[_field(tx, table, name)] = e
    return out


def _new_values(w: Writer, scope: Scope, origin: str, table: str, sets: dict, where) -> DataFrame:
    """key and the new values, from the old rows. A name without its table means the record's own field."""
    found, own = scope.find, scope.sources[table]
    scope.find = lambda t, n: (table, own[n.lower()], True) if t is None and n.lower() in own else found(t, n)
    values = {f: w.value(e, scope) for f, e in sets.items()}
    condition = f" WHERE {w.truth(where, scope)}" if where is not None else ""
    cells = "".join(f", {f'CAST({t} AS {_STORED[k]})' if k in _STORED else t} AS {_name(f)}" for f, (t, k) in values.items())
    try:
        return w.spark.sql(f"SELECT {_name(table)}.key{cells} FROM {origin}{condition}")
    except Exception as e:
        raise QueryError(str(e).split("\n")[0]) from e
    finally:
        w.drop_views()


def _update(tx, r: Reader) -> Change:
    r.need("update")
    out = Change(_table(tx, r))
    sets = _sets(tx, r, out.table)
    where = r.expr() if r.take("where") else None
    _ending(r, out)
    w, scope = Writer(tx.base), Scope()
    name, columns = w.view(out.table, lambda: tx.base.table(out.table))
    scope.sources = {out.table: columns}
    _stage(tx, out, _new_values(w, scope, f"{name} AS {_name(out.table)}", out.table, sets, where), list(sets))
    return out


def _delete(tx, r: Reader) -> Change:
    r.need("delete")
    r.need("from")
    out = Change(_table(tx, r), gone=True)
    where = r.expr() if r.take("where") else None
    _ending(r, out)
    w, scope = Writer(tx.base), Scope()
    name, columns = w.view(out.table, lambda: tx.base.table(out.table))
    scope.sources = {out.table: columns}
    _stage(tx, out, _new_values(w, scope, f"{name} AS {_name(out.table)}", out.table, {}, where), [])
    return out


def _stage(tx, out: Change, rows: DataFrame, given: list[str], bare: str | None = None) -> None:
    """Write a delta of ``rows`` (key and values; fields that are given and not there are cleared) and stage it."""
    db, info, table = tx.base.db, tx.base.manifest.tables[out.table], out.table
    kinds, bad = dict(info.kinds), F.lit(False)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    for f in given:
        kind, c = types.get(f, "void"), F.col(f"`{f}`") if f in types else None
        kind = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "boolean": "bigint", "float": "double"}.get(kind, "double" if kind.startswith("decimal") else kind)
        if kind != "void" and kind != kinds[f]:
            if {kind, kinds[f]} != {"bigint", "double"}:
                raise InvalidError(f"field {f!r} of {table!r} holds {kinds[f]}, not {kind}")
            kinds[f] = "double"
        if c is not None and f == "vec":
            bad = bad | F.coalesce((F.size(c) != (info.dims or 0)) | F.forall(c, lambda x: x == 0) | F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & c.isNotNull()
        elif c is not None and kinds[f] == "double":
            bad = bad | F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(False))
    stamp = [F.lit(tx.base.manifest.seq + 1).cast("long").alias("__seq"), F.lit(out.gone).alias("__del"), F.array(*map(F.lit, sorted(given))).cast("array<string>").alias("__set")]
    values = [(F.col(f"`{f}`") if f in given and f in types else F.lit(None)).cast(kinds[f]).alias(f) for f in info.fields]
    at = db._place(table)
    rows.select("key", *values, *stamp, bad.alias("__bad")).write.parquet(at)
    written = tx.base.spark.read.parquet(at)
    n, wrong = written.agg(F.count("*"), F.count_if("__bad")).first()
    if wrong or not n:
        db.files.delete(at)
        if wrong:
            raise InvalidError("a real must be finite, a vector of the table's size and not zero")
        return
    links = db.write_cascade(written) if out.gone else None
    tx.ops.append(("bulk", table, at, links, [f for f in info.fields if kinds[f] != info.kinds[f]]))
    out.count += n
    out.keys.append(at)


def returned(db, before, out: Change) -> DataFrame:
    """The RETURNING columns over the changed records: as they are now, or as they were if they are gone."""
    snapshot = before if out.gone else db.snapshot()
    columns = out.returning or [(("col", None, "key"), None, "key")]
    w = Writer(snapshot)
    try:
        keys = db.spark.read.parquet(*out.keys).select("key") if out.keys else db.spark.createDataFrame([], "key string")
        w.views[out.table] = w.view("changed", lambda: snapshot.table(out.table).join(keys, "key", "left_semi"))
        text, names = w.select(("select", False, columns, ("table", out.table, None), None, [], None, []), None, {}, [])
        return db.spark.sql(text).toDF(*(n for n, _ in names))
    finally:
        for name in {n for n, _ in w.views.values()}:
            db.spark.catalog.dropTempView(name)


def define(db, text: str) -> int | None:
    """DDL: CREATE TABLE (an empty record table), DROP TABLE, ALTER TABLE ADD COLUMN, VACUUM; None if it is something else."""
    r = Reader(text, [])
    if r.take("vacuum"):
        r.finish()
        db.compact()
        return 0
    if not r.at("create", "drop", "alter", "begin", "commit", "rollback", "savepoint", "release", "attach", "detach", "analyze", "reindex", "end"):
        return None
    what = r.take("create", "drop", "alter")
    if what is None:
        raise QueryError(f"{r.peek().text.upper()} is not for SQL text here: transactions go through update")
    if not r.take("table"):
        raise QueryError(f"{what.upper()} is for record tables; they are sorted by key and need no index")
    quiet = False
    if r.take("if"):
        r.take("not")
        r.need("exists")
        quiet = True
    name = r.name().lower()
    if what == "drop":
        r.finish()
        try:
            db.drop(name)
        except NotFoundError:
            if not quiet:
                raise QueryError(f"no such table: {name}") from None
        return 0
    kinds = {"integer": "bigint", "int": "bigint", "bigint": "bigint", "real": "double", "double": "double", "float": "double", "blob": "binary"}

    def column() -> tuple[str, str]:
        c, kind = r.name(), "text"
        while r.peek() and not r.at(",", ")", ";"):
            word = r.name().lower()
            kind = word if word in kinds or word == "text" else kind
        return c, kinds.get(kind, "string")

    if what == "alter":
        r.need("add")
        r.take("column")
        fields = [column()]
        r.finish()
        db.define(name, fields, new=False)
        return 0
    r.need("(")
    fields = r.listed(column)
    r.need(")")
    r.finish()
    if not fields or fields[0][0].lower() != "key":
        raise QueryError("a record table begins with key TEXT PRIMARY KEY")
    try:
        db.define(name, fields[1:], new=True)
    except FourfoldError:
        if not quiet:
            raise
    return 0
