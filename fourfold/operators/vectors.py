"""Vectors: exact cosine distance, nearest neighbours, and the codec between arrays, bytes and JSON text."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidError

MAX_DIMS, MAX_K = 65_536, 10_000
#: Query vectors, and values in them, of one block that is shipped with the tasks; and distances that a task holds at once.
MAX_QUERIES, MAX_VALUES, MAX_CELLS = 4_096, 1 << 22, 1 << 22


def check_vector(values: Sequence[float], dims: int | None = None) -> list[float]:
    """Float32 values: 1 to MAX_DIMS of them, finite, not all zero, of the table's size."""
    try:
        out = [float(x) for x in np.asarray(values, np.float32)]
    except (TypeError, ValueError) as e:
        raise InvalidError("a vector must be numbers") from e
    if not 1 <= len(out) <= MAX_DIMS:
        raise InvalidError(f"a vector has 1 to {MAX_DIMS} values")
    if not all(map(math.isfinite, out)):
        raise InvalidError("a vector's values must be finite")
    if not any(out):
        raise InvalidError("a vector must not be all zero")
    if dims is not None and len(out) != dims:
        raise InvalidError(f"the vector has {len(out)} values, the table's vectors {dims}")
    return out


def to_bytes(values: Sequence[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def from_bytes(raw: bytes) -> list[float]:
    if not raw or len(raw) % 4:
        raise InvalidError("not the bytes of a vector")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


def parse_vector(text: str) -> list[float]:
    """A vector from JSON text."""
    try:
        values = json.loads(text)
    except ValueError as e:
        raise InvalidError("a vector's text must be a JSON array") from e
    if not isinstance(values, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
        raise InvalidError("a vector's text must be a JSON array of numbers")
    return check_vector(values)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    """Cosine distance, 0 to 2: null if either is, 1 if a side has no length; unequal sizes raise."""
    size = F.when(F.size(a) == F.size(b), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("the vectors differ in size")).cast("boolean"))
    na, nb = norm(a), norm(b)
    cosine = dot(a, b) / (na * nb)
    value = F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1.0 - cosine)))
    return F.when(size, value)


def distance_to(vec: Column, query: Sequence[float], norms: Column | None = None) -> Column:
    """Distance to one constant vector, an Arrow batch at a time; rows of another size are null. ``norms`` are the vectors' own, if they are stored."""
    from pyspark.sql.functions import arrow_udf

    q = np.asarray(query, np.float64)
    unit = q / (np.linalg.norm(q) or 1.0)

    @arrow_udf("double")
    def measure(v: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
        good = sizes == len(unit)
        m = v.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(unit))
        return finish(len(v), good, m, np.sqrt(np.einsum("ij,ij->i", m, m)))

    @arrow_udf("double")
    def measure_with(v: pa.Array, n: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
        good = sizes == len(unit)
        m = v.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(unit))
        return finish(len(v), good, m, n.to_numpy(zero_copy_only=False)[good])

    def finish(rows: int, good: np.ndarray, m: np.ndarray, lengths: np.ndarray) -> pa.Array:
        out = np.full(rows, np.nan)
        out[good] = np.where(lengths > 0, np.clip(1.0 - np.dot(m.astype(np.float64, copy=False), unit) / np.where(lengths > 0, lengths, 1.0), 0.0, 2.0), 1.0)
        return pa.array(out, mask=np.isnan(out))

    return measure(vec) if norms is None else measure_with(vec, norms)


def nearest(table: DataFrame, query: Sequence[float], k: int, where: Column | str | None = None, *, key: str = "key", vec: str = "vec", norms: str | None = None) -> DataFrame:
    """The k records nearest to ``query``: (key, distance), ties by key. The filter runs before any distance; top-k per partition, then merged.
    ``norms`` names a column with the vectors' lengths, worked out once when they were stored."""
    q = check_vector(query)
    if not 1 <= k <= MAX_K:
        raise InvalidError(f"k must be from 1 to {MAX_K}")
    rows = table if where is None else table.where(where)
    rows = rows.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), distance_to(F.col(vec), q, F.col(norms) if norms else None).alias("distance"))
    return rows.where(F.col("distance").isNotNull()).orderBy("distance", "key").limit(k)


def nearest_many(table: DataFrame, queries: DataFrame, k: int, *, key: str = "key", vec: str = "vec", query_key: str = "key", query_vec: str = "vec") -> DataFrame:
    """For each query record its k nearest among the vectors of its size: (query, key, distance, rank), ties by key.

    The queries are read once, a partition at a time, and worked through in blocks of at most MAX_QUERIES: a block goes to every task, which
    multiplies each batch of the table with it and passes on the k best of the batch for each query. What a block finds is kept before the
    next is read, so any number of queries is answered and the driver holds one block of each size and one partition.
    """
    if not 1 <= k <= MAX_K:
        raise InvalidError(f"k must be from 1 to {MAX_K}")
    kind, qkind = table.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    rows = table.select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    asked = _keep(queries.select(F.col(query_key).alias("q"), F.col(query_vec).alias("v")).where("size(v) > 0"))
    found, open_ = [], {}
    for r in asked.toLocalIterator():
        block = open_.setdefault(len(r.v), [])
        block.append(r)
        if len(block) >= max(1, min(MAX_QUERIES, MAX_VALUES // len(r.v))):
            found.append(_keep(_nearest_block(rows, open_.pop(len(r.v)), k, kind, qkind)))
    found += [_keep(_nearest_block(rows, block, k, kind, qkind)) for block in open_.values()]
    if not found:
        return table.sparkSession.createDataFrame([], f"query {qkind}, key {kind}, distance double, rank int")
    return reduce(DataFrame.unionAll, found)


def _keep(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder if there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def _nearest_block(rows: DataFrame, asked: list, k: int, kind: str, qkind: str) -> DataFrame:
    """The k nearest of (key, vec) for each of the queries (q, v), which have one size."""
    names = pa.array([r.q for r in asked], _arrow(qkind))
    m = np.array([r.v for r in asked], np.float64)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.compute.array_sort_indices(batch.column(0), null_placement="at_start"))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, unit.shape[1])
            lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
            x = (x / np.where(lengths > 0, lengths, 1.0)[:, None]).T
            step = max(1, MAX_CELLS // len(lengths))
            for lo in range(0, len(unit), step):
                d = np.clip(1.0 - unit[lo : lo + step] @ x, 0.0, 2.0)
                d[:, lengths == 0] = 1.0
                if d.shape[1] > k:
                    near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    for i in np.flatnonzero(near.sum(axis=1) > k):  # of the ties at the k-th, those with the least keys
                        at = np.flatnonzero(near[i])
                        near[i, at[np.argsort(d[i, at], kind="stable")[k:]]] = False
                    qi, ri = np.nonzero(near)
                else:
                    qi, ri = np.indices(d.shape).reshape(2, -1)
                at = pa.array((qi + lo).astype(np.int32))
                yield pa.RecordBatch.from_arrays([at, names.take(at), batch.column(0).take(pa.array(ri)), pa.array(d[qi, ri])], ["nth", "query", "key", "distance"])

    best = rows.where(F.size("vec") == unit.shape[1]).mapInArrow(run, f"nth int, query {qkind}, key {kind}, distance double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy("distance", "key")))
    return ranked.where(F.col("rank") <= k).drop("nth")


def _arrow(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
