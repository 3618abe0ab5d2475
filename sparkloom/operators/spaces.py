"""Several embedding spaces: routes between them, adapters and how well two of them agree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import let, norm

#: Largest size of a number that an adapter takes.
LARGEST = 1e6


def plan_routes(stored: DataFrame, ready: DataFrame, adapters: DataFrame) -> DataFrame:
    """position, space, how, source: the way of a query into each stored space that it can reach.

    stored has position and space, ready has space, adapters have position, source and
    target. A ready space is reached directly; another by the adapter of least position
    (ties to the smaller source) whose source is ready; the rest have no row. Null names
    match nothing; repeated rows of ready change nothing.
    """
    known = ready.select("space").where("space IS NOT NULL").distinct()
    direct = stored.join(known.withColumn("direct", F.lit(True)), "space", "left").select("position", "space", "direct")
    usable = adapters.join(known.select(F.col("space").alias("source")), "source", "left_semi")
    first = usable.groupBy(F.col("target").alias("space")).agg(F.min_by("source", F.struct("position", "source")).alias("via"))
    routed = direct.join(first, "space", "left").where("direct OR via IS NOT NULL")
    how = F.when(F.col("direct"), "direct").otherwise("adapter").alias("how")
    return routed.select("position", "space", how, F.when(F.col("direct"), F.col("space")).otherwise(F.col("via")).alias("source"))


def coordinate_sums(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """(sums of products of all coordinates of src and dst side by side, width of src) of rows (src, dst); empty without rows.

    Executors sum in Arrow batches; only those sums, whose number depends on the widths
    alone, come to the driver. Rows with a null or non-finite part are left out.
    """

    def products(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = None, 0
        for t in tables:
            rows = [(a, b) for a, b in zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True) if a and b and None not in a and None not in b]
            both = np.array([a + b for a, b in rows], float)
            both = both[np.isfinite(both).all(axis=1)] if len(both) else both
            if len(both):
                width = len(rows[0][0])
                total = both.T @ both + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([width] * len(total), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "width", "sums"])

    parts = pairs.select("src", "dst").mapInArrow(products, "i int, width int, sums array<double>")
    summed = parts.select("i", "width", F.posexplode("sums").alias("j", "x")).groupBy("i", "width", "j").agg(F.sum("x").alias("x")).collect()
    if not summed:
        return np.zeros((0, 0)), 0
    width, full = summed[0].width, max(r.i for r in summed) + 1
    gram = np.zeros((full, full))
    for r in summed:
        gram[r.i, r.j] = r.x
    return gram, width


def fit_adapter(pairs: DataFrame) -> list[list[float]]:
    """Matrix W of 6 decimals with src @ W near dst, from rows (src, dst) of vectors of one width each.

    Equal widths give the orthogonal matrix that fits best, others the least squares of
    least norm, both from coordinate_sums. Rows with a null or non-finite part teach
    nothing; without rows the matrix is empty.
    """
    gram, width = coordinate_sums(pairs)
    if not width:
        return []
    full = len(gram)
    own, cross = gram[:width, :width], gram[:width, width:]
    if 2 * width == full:
        left, _, right = np.linalg.svd(cross)
        w = left @ right
    else:
        w = np.linalg.pinv(own, hermitian=True) @ cross
    return (np.round(w, 6) + 0.0).tolist()


def adapt(vector: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """vector @ matrix at length 1, 6 decimals; a zero product stays zero."""
    columns = [F.array(*(F.lit(float(row[j])) for row in matrix)) for j in range(len(matrix[0]))]
    dots = F.transform(F.array(*columns), lambda c: F.aggregate(F.zip_with(vector, c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))
    return let(dots, lambda y: let(norm(y), lambda n: F.transform(y, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(F.round(x / n, 6) + F.lit(0.0)))))


def carry(vectors: DataFrame, matrix: Sequence[Sequence[float]], vector: str = "v", out: str = "carried") -> DataFrame:
    """vectors with column out: the adapted vector, or an empty array where it doesn't fit the matrix.

    A vector fits if it has as many numbers as the matrix has rows, all finite and of
    1e6 at most; null vectors and parts don't. A matrix that is empty, ragged or holds
    another number fits nothing.
    """
    fit = lambda x: np.isfinite(x) and abs(x) <= LARGEST
    none = F.array().cast("array<double>")
    if not matrix or not matrix[0] or len({len(r) for r in matrix}) > 1 or not all(fit(x) for r in matrix for x in r):
        return vectors.withColumn(out, none)
    good = (F.size(vector) == len(matrix)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST))
    return vectors.withColumn(out, F.when(F.coalesce(good, F.lit(False)), adapt(F.col(vector), matrix)).otherwise(none))


def neighbour_overlap(one: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """query_id, shared, overlap: how many of the k nearest (query_id, rank, id) two spaces have in common.

    Queries of either list appear; overlap is shared / k. Both lists deal by query and id,
    so only ids travel. Empty lists give no rows.
    """
    near = [x.where(F.col("rank") <= k).select("query_id", "id").distinct() for x in (one, other)]
    both = near[0].unionByName(near[1]).groupBy("query_id", "id").agg(F.count("*").alias("n"))
    return both.groupBy("query_id").agg(F.count_if(F.col("n") == 2).alias("shared")).withColumn("overlap", F.round(F.col("shared") / k, 6))
