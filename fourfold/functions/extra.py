"""Functions of the pass-through tier as Columns: pattern matching, text, numbers, dates on stored text, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A GLOB pattern (*, ?, [set], [^set]) as a regular expression over whole strings; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)) > 0:
            body = pattern[i + 1 : end]
            no = body.startswith("^")
            out.append("[" + "^" * no + re.sub(r"([\\\[\]&])", r"\\\1", body[no:]) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


def nocase(x: Column) -> Column:
    """What COLLATE NOCASE compares: ASCII letters folded."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quote(x: Column, kind: str) -> Column:
    """A value as a literal of the SQL dialect."""
    body = {"text": F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), "blob": F.concat(F.lit("X'"), F.hex(x), F.lit("'"))}.get(kind, x.cast("string"))
    return F.coalesce(body, F.lit("NULL"))


#: Strftime letters and the date patterns they mean.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%%": "'%'"}


def strftime_pieces(format_: str) -> list[tuple[str, str]]:
    """A format as ("text", text), ("date", one date pattern for neighbouring conversions and what stands between them) and ("other", a conversion
    that no date pattern has): the fewer pieces, the less often the time is computed, in code that the JVM still compiles."""
    out: list[tuple[str, str]] = []
    for p in re.findall(r"%.|[^%]+", format_):
        if p not in STRFTIME:
            out.append(("other" if p[0] == "%" else "text", p))
            continue
        x, before = STRFTIME[p], [k for k, _ in out[-2:]]
        if before[-1:] == ["date"] and out[-1][1][-1] != x[0]:
            out[-1] = "date", out[-1][1] + x
        elif before == ["date", "text"] and "'" not in (out[-2][1][-1], x[0]):
            text = out.pop()[1].replace("'", "''")
            out[-1] = "date", f"{out[-1][1]}'{text}'{x}"
        else:
            out.append(("date", x))
    return out


def strftime(format_: str, ts: Column) -> Column:
    parts = strftime_pieces(format_)
    if unknown := [p for kind, p in parts if kind == "other" and p not in ("%s", "%w")]:
        raise ValueError(f"unknown conversion {unknown[0]}")
    seconds, weekday = F.unix_timestamp(ts).cast("string"), (F.dayofweek(ts) - 1).cast("string")
    return F.concat(*(F.date_format(ts, p) if kind == "date" else F.lit(p) if kind == "text" else seconds if p == "%s" else weekday for kind, p in parts))


def julianday(ts: Column) -> Column:
    """Days since noon of 24 November 4714 BC."""
    return F.unix_timestamp(ts) / 86400.0 + 2440587.5


def json_valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("long"))


def json_each(rows, column: str):
    """One row per element of a JSON array of scalars in ``column``: the other columns, idx and value (text)."""
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.from_json(column, "array<string>")).alias("idx", "value"))


def register(spark: SparkSession) -> None:
    """Make distance and vector callable from Spark SQL text as temporary SQL functions (no Python in the plan)."""
    dot = "aggregate(zip_with({0}, {1}, (p, q) -> CAST(p AS DOUBLE) * q), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector(x STRING) RETURNS ARRAY<FLOAT> RETURN from_json(x, 'array<float>')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN greatest(0D, least(2D, 1 - {dot.format('a', 'b')} / nullif(sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}), 0)))")
