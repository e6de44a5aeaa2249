"""A database as a Python DB-API 2.0 (PEP 249) connection: cursors over ``Database.query`` and ``Database.execute``, marks as "?".

    with dbapi.connect(spark, "hdfs:///data/mine") as con:
        con.cursor().execute("INSERT INTO docs (key, n) VALUES (?, ?)", ("docs:1", 3))
        rows = con.cursor().execute("SELECT key, n FROM docs").fetchall()

Every write statement is a transaction of its own (autocommit); ``commit`` has nothing to do and ``rollback`` nothing to undo. Rows come to the driver a
partition at a time. Errors are those of ``fourfold.errors`` under the names that the standard gives them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession

from .errors import FourfoldError, InvalidError, QueryError
from .sources.database import Database

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = DatabaseError = OperationalError = InternalError = NotSupportedError = FourfoldError
InterfaceError, ProgrammingError, DataError, IntegrityError = FourfoldError, QueryError, InvalidError, InvalidError
Warning = UserWarning  # noqa: A001  the standard's name
_READS = ("select", "with", "values", "explain", "pragma")


def connect(spark: SparkSession, root: str) -> Connection:
    return Connection(Database(spark, root))


class Connection:
    def __init__(self, db: Database):
        self.db = db

    def cursor(self) -> Cursor:
        self.db.manifest()  # raises when closed
        return Cursor(self)

    def execute(self, text: str, args: Sequence[Any] = ()) -> Cursor:
        return self.cursor().execute(text, args)

    def commit(self) -> None:
        self.db.manifest()

    def rollback(self) -> None:
        self.db.manifest()

    def close(self) -> None:
        self.db.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Cursor:
    arraysize = 100

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self._rows = connection, None, -1, None

    def execute(self, text: str, args: Sequence[Any] = ()) -> Cursor:
        words = text.split(None, 1)
        first = words[0].lower().lstrip("(") if words else ""
        if first in _READS:
            self._open(self.connection.db.query(text, args))
        elif "returning" in text.lower() and first in ("insert", "replace", "update", "delete"):
            self._open(self.connection.db.returning(text, args))
        else:
            self.description, self._rows = None, None
            self.rowcount = self.connection.db.execute(text, args)
        return self

    def _open(self, df) -> None:
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self._rows, self.rowcount = (tuple(r) for r in df.toLocalIterator()), -1

    def executemany(self, text: str, many: Sequence[Sequence[Any]]) -> Cursor:
        self.rowcount = sum(self.execute(text, args).rowcount for args in many)
        return self

    def _iter(self) -> Iterator[tuple]:
        if self._rows is None:
            raise QueryError("there is no result to fetch")
        return self._rows

    def fetchone(self) -> tuple | None:
        return next(self._iter(), None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        rows, n = self._iter(), self.arraysize if size is None else size
        return [r for _, r in zip(range(n), rows)]

    def fetchall(self) -> list[tuple]:
        return list(self._iter())

    def __iter__(self) -> Iterator[tuple]:
        return self._iter()

    def setinputsizes(self, sizes) -> None:
        """Nothing to do."""

    def setoutputsize(self, size, column=None) -> None:
        """Nothing to do."""

    def close(self) -> None:
        self._rows = None


__all__ = ["Connection", "Cursor", "connect"]
