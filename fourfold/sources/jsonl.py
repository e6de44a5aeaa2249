"""Export and import of a database as JSON Lines.

Lines in this order: a header, then for each table (byte order) its head {"table", "dims", "fields"} and its records {"key", "fields"} in key order,
then links {"from", "type", "to"} in byte order, then the counts. The export is a folder of text parts in order, written by many tasks; a single
file works for import too. Whole reals keep a ".0", so that integers and reals are told apart; bytes are {"base64": ...}.
"""

from __future__ import annotations

import base64
import json
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FourfoldError, InvalidError
from ..operators.rules import check_fields, check_table, check_type, table_of

HEADER = {"fourfold": "export", "version": 1}


def _number(x: float) -> str:
    """Shortest digits that read back equal; an exponent outside 1e-6 to 1e21."""
    if x == int(x) and abs(x) < 1e21:
        return f"{int(x)}.0" if x or math.copysign(1, x) > 0 else "-0.0"
    return repr(x)


def value_text(v: Any, float32: bool = False) -> str:
    import numpy as np

    if isinstance(v, float):
        return _number(v)
    if isinstance(v, (bytes, bytearray)):
        return '{"base64":' + json.dumps(base64.b64encode(v).decode()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(str(np.float32(x)) if np.float32(x) != int(x) else f"{int(x)}" for x in v) + "]"
    return json.dumps(v, ensure_ascii=False)


def export(snapshot, to: str) -> None:
    """Write the folder ``to``; sections are sorted in parallel and numbered so that the parts are in order."""
    spark = snapshot.spark
    lines: DataFrame | None = None

    def add(df: DataFrame) -> None:
        nonlocal lines
        lines = df if lines is None else lines.unionAll(df)

    def single(section: int, value: dict) -> DataFrame:
        return spark.createDataFrame([(section, "", json.dumps(value, ensure_ascii=False, separators=(",", ":")))], "section int, sort string, value string")

    add(single(0, HEADER))
    counts = {"tables": 0, "records": 0, "links": snapshot.links().count()}
    for i, name in enumerate(snapshot.tables()):
        info, df = snapshot.manifest.tables[name], snapshot.table(name)
        counts["tables"] += 1
        counts["records"] += df.count()
        add(single(2 * i + 1, {"table": name, "dims": info.dims, "fields": info.fields}))
        fields = info.fields

        def render(batches, fields=fields, section=2 * i + 2):
            import pyarrow as pa

            for batch in batches:
                rows = batch.to_pylist()
                text = ["{" + f'"key":{json.dumps(r["key"], ensure_ascii=False)},"fields":{{' + ",".join(f"{json.dumps(f)}:{value_text(r[f])}" for f in fields if r[f] is not None) + "}}" for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([section] * len(rows), pa.int32()), batch.column(0), pa.array(text, pa.string())], ["section", "sort", "value"])

        add(df.select("key", *fields).mapInArrow(render, "section int, sort string, value string"))
    last = 2 * len(snapshot.tables()) + 1
    links = snapshot.links()
    body = F.to_json(F.struct(F.col("src").alias("from"), "type", F.col("dst").alias("to")))
    add(links.select(F.lit(last).alias("section"), F.concat_ws("\0", "src", "type", "dst").alias("sort"), body.alias("value")))
    add(single(last + 1, {"end": counts}))
    lines.repartitionByRange("section", "sort").sortWithinPartitions("section", "sort").select("value").write.text(to)


def _strict(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise InvalidError(f"member {k!r} comes twice")
        out[k] = v
    return out


def parse_line(text: str) -> dict[str, Any]:
    """One line: no repeated members, no booleans as values, no NaN."""

    def refuse(x):
        raise InvalidError(f"{x} is not a value")

    try:
        out = json.loads(text, object_pairs_hook=_strict, parse_constant=refuse)
    except ValueError as e:
        raise InvalidError("a line is not JSON") from e
    if not isinstance(out, dict):
        raise InvalidError("a line is not an object")
    return out


def _value(v: Any) -> Any:
    if isinstance(v, bool):
        raise InvalidError("true and false are not values")
    if isinstance(v, dict):
        if set(v) != {"base64"}:
            raise InvalidError("an object is not a value")
        return base64.b64decode(v["base64"], validate=True)
    return v


_KINDS = {int: "i", float: "r", str: "t", bytes: "b", list: "v"}
_TYPES = {"i": "bigint", "r": "double", "t": "string", "b": "binary", "v": "array<float>"}
_LINE = f"shape string, wrong string, head string, tbl string, key string, src string, type string, dst string, fields map<string,struct<k:string,{','.join(f'{k}:{t}' for k, t in _TYPES.items())}>>"


def _parsed(batches):
    """Lines of any place in the file to rows: what shape each has, what is wrong with it, its parts."""
    import pyarrow as pa

    kinds = pa.map_(pa.string(), pa.struct([("k", pa.string()), ("i", pa.int64()), ("r", pa.float64()), ("t", pa.string()), ("b", pa.binary()), ("v", pa.list_(pa.float32()))]))
    schema = pa.schema([(n, pa.string()) for n in ("shape", "wrong", "head", "tbl", "key", "src", "type", "dst")] + [("fields", kinds)])

    def one(text: str) -> dict:
        line = parse_line(text)
        if "key" in line and set(line) == {"key", "fields"}:
            fields = check_fields({k: _value(v) for k, v in line["fields"].items()})
            return {"shape": "record", "tbl": table_of(line["key"]), "key": line["key"], "fields": [(f, {"k": _KINDS[type(v)], _KINDS[type(v)]: v}) for f, v in fields.items() if v is not None]}
        if {"from", "type", "to"} == set(line):
            return {"shape": "link", "src": line["from"], "type": check_type(line["type"]), "dst": line["to"]}
        if "table" in line:
            return {"shape": "table", "tbl": check_table(line["table"]), "head": text}
        if line == HEADER or set(line) == {"end"}:
            return {"shape": "header" if line == HEADER else "end", "head": text}
        raise InvalidError("a line of an unknown shape")

    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            try:
                rows.append(one(text))
            except (FourfoldError, ValueError, TypeError, AttributeError, OverflowError) as e:
                rows.append({"shape": "wrong", "wrong": str(e)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def import_(db, source: str) -> dict[str, int]:
    """Read an export into an empty database, all or nothing: refuses wrong counts, repeated keys, records of no table and links without ends.

    Lines are parsed where they are read and kept; checks are aggregations and anti-joins, and each table is written by its own tasks. The driver
    sees the heads of the tables, the counts and the kinds of the fields.
    """
    if db.snapshot().tables():
        raise InvalidError("import goes into an empty database")
    spark = db.spark
    place = db._place("import")
    made = [place]
    try:
        spark.read.text(source).mapInArrow(_parsed, _LINE).write.parquet(place)
        lines = spark.read.parquet(place)
        if bad := lines.where("shape = 'wrong'").select("wrong").take(1):
            raise InvalidError(bad[0].wrong)
        heads = lines.where("shape IN ('header', 'table', 'end')").select("shape", "tbl", "head").collect()
        tables = {r.tbl: json.loads(r.head) for r in heads if r.shape == "table"}
        ends = [json.loads(r.head)["end"] for r in heads if r.shape == "end"]
        if sum(r.shape == "header" for r in heads) != 1 or len(ends) != 1 or len(tables) != sum(r.shape == "table" for r in heads):
            raise InvalidError("not an export of this version")
        records, links = lines.where("shape = 'record'"), lines.where("shape = 'link'").select("src", "type", "dst")
        n, distinct = records.agg(F.count("*"), F.count_distinct("key")).first()
        counts = {"tables": len(tables), "records": n, "links": links.distinct().count()}
        if counts != ends[0]:
            raise FourfoldError(f"the export's counts {ends[0]} are not those read, {counts}")
        if n != distinct:
            raise InvalidError("a key is repeated")
        keys = records.select("key")
        if links.select(F.col("src").alias("key")).unionAll(links.select("dst")).join(keys, "key", "left_anti").take(1):
            raise InvalidError("a link's end is not there")
        found: dict[str, dict[str, set[str]]] = {}
        for r in records.select("tbl", F.explode("fields").alias("f", "v")).select("tbl", "f", "v.k").distinct().collect():
            found.setdefault(r.tbl, {}).setdefault(r.f, set()).add(r.k)
        if lost := {r.tbl for r in records.select("tbl").distinct().collect()} - set(tables):
            raise InvalidError(f"records of {sorted(lost)[0]!r}, which is no table here")
        kinds: dict[str, dict[str, str]] = {}
        for name, head in tables.items():
            fields = list(dict.fromkeys([*head.get("fields", []), *sorted(found.get(name, {}))]))
            check_fields(dict.fromkeys(f for f in fields if f.lower() != "vec"))
            kinds[name] = {}
            for f in fields:
                some = found.get(name, {}).get(f, {"t"})
                if len(some) > 1 and some != {"i", "r"}:
                    raise InvalidError(f"field {f!r} of {name!r} holds several kinds")
                kinds[name][f] = "r" if len(some) > 1 else next(iter(some))
        for name, of in kinds.items():
            cell = lambda f, k: F.coalesce(F.col("fields")[f]["r"], F.col("fields")[f]["i"].cast("double")) if k == "r" else F.col("fields")[f][k]
            rows = records.where(F.col("tbl") == name).select("key", *(cell(f, k).cast(_TYPES[k]).alias(f) for f, k in of.items()))
            dims = [r[0] for r in rows.where("vec IS NOT NULL").select(F.size("vec")).distinct().take(2)] if "vec" in of else []
            if len(dims) > 1 or dims and tables[name].get("dims") not in (None, dims[0]):
                raise InvalidError("vectors must have one size")
            at = db._place(name)
            made.append(at)
            rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(at)
            kinds[name] = {"base": at, "fields": list(of), "kinds": {f: _TYPES[k] for f, k in of.items()}, "dims": dims[0] if dims else tables[name].get("dims")}
        at = db._place("links")
        made.append(at)
        links.distinct().repartitionByRange("src").sortWithinPartitions("src", "type", "dst").write.parquet(at)
        db.install(kinds, at)
    except BaseException:
        for at in made:
            db.files.delete(at)
        raise
    db.files.delete(place)
    return counts
