"""What the operators share: lineage cuts, native word splitting and small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch

#: ASCII letters that contracts lower-case; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates lower-cased alphanumeric words, and what separates blank-delimited words.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of an Arrow batch on its way to a Python worker.
ARROW_BYTES = 4 << 20
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """From now on Arrow batches of the session hold ``most`` bytes at most (or one row): workers' memory does not depend on row sizes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{most}b")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs nothing."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: inside a lambda a plain column would be inlined and redone."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined(a: Column, b: Column, skip: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` over a[i] and b[i + skip] where both are there."""
    n = F.greatest(F.least(F.size(a), F.size(b) - skip), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + skip), n), body)


def spread(first: Column, size: int, body: Callable[[Column, Column], Column], then: Callable[[Column], Column]) -> Column:
    """``then`` over the combination of ``size`` consecutive elements from each place on, by doubling; every step is worked out once."""

    def grow(width: int, wide: Column, done: int, out: Column | None) -> Column:
        if size & width:
            if out is None:
                return grow(width << 1, wide, width, wide) if size > width else then(wide)
            one = joined(out, wide, done, body)
            return let(one, lambda x: grow2(width, wide, done + width, x) if done + width < size else then(x))
        return grow2(width, wide, done, out)

    def grow2(width: int, wide: Column, done: int, out: Column | None) -> Column:
        return let(joined(wide, wide, width, body), lambda x: grow(width << 1, x, done, out))

    def start(wide: Column) -> Column:
        if size == 1:
            return then(wide)
        return grow2(1, wide, 1, wide) if size & 1 else grow2(1, wide, 0, None)

    return let(first, start)


def mixed(a: Column, b: Column) -> Column:
    """One hash of two."""
    return F.xxhash64(a, b)


def lesser(a: Column, b: Column) -> Column:
    """The smaller of two."""
    return F.least(a, b)


def alnum_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, a-z and non-ASCII characters; none for null."""
    return F.array_remove(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), NOT_ALNUM), "")


def blank_words(text: Column) -> Column:
    """Runs without ASCII white space, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened by underscores until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
