"""Embedding whitening by Spark MLlib's BlockMatrix.

Each entry c of a vector becomes floor(scale * c), a whole number. Every distinct vector counts once for the fit: its sums are exact, the rows are centred
by them, indexed and dealt to blocks of `BLOCK` rows; the transpose times the matrix is the scatter, whose blocks are paired in as many tasks as there
are groups of `PAIRS` blocks and added up before they meet. Only this square of the dimension comes to the driver, which finds the eigenvectors. The
whitening matrix is a BlockMatrix again, and its product with the blocks of all rows is the projection, joined to the rows by their index.

What the driver holds: the sums, the scatter (MOST_DIMENSIONS squared at most), the names of files, and the blocks' places, 16 bytes for each `BLOCK`
rows, which BlockMatrix needs to deal them.

Defined results: rows whose vector is null or has a null or an entry that isn't finite are left out; vectors shorter than the longest count as filled up
with zeros; a component without variance (an eigenvalue of `FLAT` times the largest, or less) isn't returned, so fewer than two distinct vectors give no
rows; eigenvectors point so that their entry of largest size is positive; repeated rows and ids are all returned; a deviation beyond the range of long is null; entries beyond the range of long are its ends; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.storagelevel import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, keep, located

SCALE, COMPONENTS = 256, 4
BLOCK, COLUMNS, PAIRS, MOST_DIMENSIONS, FLAT = 1024, 1024, 8, 8192, 1e-12


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """Adds a number from 0 without gaps to rows that are read from files: the counts of the files before, and the place in the file."""
    rows, path, at = located(rows)
    file, place, base = (free([*rows.columns, name], c) for c in ("_file", "_at", "_base"))
    rows = rows.select("*", path.alias(file), at.alias(place))
    first, starts = 0, []
    for f, n in sorted(rows.groupBy(file).count().collect()):
        starts.append((f, first))
        first += n
    starts = rows.sparkSession.createDataFrame(starts, f"`{file}` string, `{base}` long")
    return rows.join(F.broadcast(starts), file).withColumn(name, F.col(base) + F.col(place)).drop(file, place, base)


def whole(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def matrix(rows: DataFrame, mean: list[float], n: int) -> BlockMatrix:
    """Blocks of the centred vectors (columns index, x); a row that has no vector is zero."""
    centred = F.zip_with("x", F.lit(mean), lambda x, m: x.cast("double") - m)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, len(mean))).toBlockMatrix(BLOCK, min(len(mean), COLUMNS))


def times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """The product; blocks of the inner dimension are dealt to so many groups, whose products are added up before they meet."""
    return BlockMatrix(left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits), left.rowsPerBlock, right.colsPerBlock)


def deviation(x: Column | str, sums: list[int], n: int, largest: int) -> Column:
    """The sum over dimensions of (n * x - sum)^2, exact: in longs where they can't overflow, else in decimals, and null beyond the range of long."""
    if len(sums) * (2 * n * largest) ** 2 < 1 << 62:
        return F.aggregate(F.zip_with(x, F.lit(sums), lambda x, s: x * F.lit(n) - s), F.lit(0).cast("long"), lambda a, d: a + d * d)
    given, kind = F.array(*(F.lit(str(s)).cast("decimal(38,0)") for s in sums)), "decimal(38,0)"
    apart = F.zip_with(x, given, lambda x, s: F.try_subtract(F.try_multiply(x.cast("decimal(20,0)"), F.lit(n).cast("decimal(18,0)")), s).cast(kind))
    return F.aggregate(apart, F.lit(0).cast(kind), lambda a, d: F.try_add(a, F.try_multiply(d, d).try_cast(kind)).try_cast(kind)).try_cast("long")


def axes(scatter: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that aren't zero, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > FLAT * max(values.max(initial=0.0), 0.0)]
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error), for each row and component."""
    out = f"`{id}` {rows.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = rows.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))
    own = keep(kept.select("id", whole(F.col("v"), scale).alias("x")), "whole")
    top = F.coalesce(F.max(F.greatest(F.abs(F.array_max("x").cast("decimal(20,0)")), F.abs(F.array_min("x").cast("decimal(20,0)")))), F.lit(0))
    total, least, dimension, largest = own.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), top).first()
    if not total or not dimension:
        return rows.sparkSession.createDataFrame([], out)
    if dimension > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {dimension} entries, over {MOST_DIMENSIONS}")
    own = indexed(own, "index")
    if least < dimension:
        own = own.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dimension) - F.size("x"))))
    own = keep(own, "indexed")
    fit = keep(own.groupBy("x").agg(F.min("index").alias("index")), "fit")
    entry = F.col("value") if total * int(largest) < 1 << 62 else F.col("value").cast("decimal(20,0)")
    sums = dict(fit.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(entry)).collect())
    n, sums = fit.count(), [int(sums[k]) for k in range(dimension)]
    mean = [s / n for s in sums]
    fitted = matrix(fit, mean, total).persist(StorageLevel.MEMORY_AND_DISK)  # its blocks' places, both factors of the scatter
    scatter = times(fitted.transpose(), fitted, max(1, -(-fitted.numRowBlocks // PAIRS))).toLocalMatrix().toArray()
    fitted._java_matrix_wrapper.call("blocks").unpersist(False)
    values, vectors = axes(scatter / n, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], out)
    white = vectors / np.sqrt(values)
    wide = min(dimension, COLUMNS)
    blocks = [((at // wide, 0), DenseMatrix(len(part), len(values), part.ravel(order="F").tolist())) for at in range(0, dimension, wide) for part in [white[at : at + wide]]]
    right = BlockMatrix(rows.sparkSession.sparkContext.parallelize(blocks, 1), wide, len(values), dimension, len(values))
    left = matrix(own, mean, total).persist(StorageLevel.MEMORY_AND_DISK)
    product = times(left, right).toIndexedRowMatrix()
    product = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model), "vector")
    product = product.select("index", vector_to_array("vector").alias("z"))
    marked = own.select("id", "index", deviation("x", sums, n, int(largest)).alias("deviation"))
    marked = marked.join(fit.select("index", F.lit(True).alias("once")), "index", "left")
    done = keep(marked.join(product, "index"), "projected")
    left._java_matrix_wrapper.call("blocks").unpersist(False)
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    z = lambda i: F.element_at("z", i + 1)
    covariance = done.where("once").agg(*(F.covar_pop(z(i), z(j)) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    shares = (values / np.trace(scatter / n)).tolist()
    found = done.select("id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return found.select(F.col("id").alias(id), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(F.lit(shares), F.col("k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
