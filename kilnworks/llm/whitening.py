"""Whitening of embeddings with distributed block matrices.

Vectors become exact integers, floor(SCALE * entry). The covariance is that of the different vectors, so copies don't
weigh more. Their sums are exact; rows less their mean are numbered and become a BlockMatrix, whose transpose times
itself, cut along the rows into as many parts as there are blocks, is the scatter matrix. Only that matrix (dimensions
squared) comes to the driver, for its eigenvectors. The rows of the table, centred alike, are a second BlockMatrix, and
its product with the whitening matrix holds their projections.

A BlockMatrix plans its products from a list of its blocks on the driver. So rows are taken in panels of PANEL blocks:
the scatter matrices of panels are added, their projections are put together.

Edge cases: a vector that is null, or holds null, NaN, an infinite entry or one beyond LIMIT (whose integer would not be
exact), is left out; a vector shorter than the longest has zeros behind its end; keys may be null or repeated; repeated
vectors get the same values; a table without vectors, or with empty ones only, gives no row. A component without
variance (as when all vectors are equal) has a null `whitened`, takes no part in `identity_error`, and `explained` is null
where all variance is 0. A deviation beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm.scratch import cut

SCALE, COMPONENTS = 256, 4
#: Integers above this are not exact as doubles.
LIMIT = float(1 << 52)
#: Entries of a block (8 MB of doubles), columns of one, blocks of a panel.
BLOCK_ENTRIES, BLOCK_COLUMNS, PANEL = 1 << 20, 1024, 4096
#: Variance below this share of the largest is none.
NONE = 1e-12

OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * entry) of each entry, or null if the vector or one of its entries is none that counts."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    counts = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    return F.when(counts, F.transform(scaled, lambda c: F.floor(c).cast("long")))


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows with column `index`, from 0 without gaps, as a written table; and how many there are."""
    placed = cut(rows.withColumn("place", F.monotonically_increasing_id()), f"{name}-placed")
    held = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each task that wrote
    index = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    made = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
    made = cut(made.select(*rows.columns, index.alias("index")), name)
    return made, made.count()


class Panels:
    """Numbered rows (columns x and index), centred, as block matrices of bounded numbers of blocks."""

    def __init__(self, rows: DataFrame, count: int, mean: list[float]) -> None:
        self.rows, self.count, self.mean = rows, count, mean
        widest = max(1, BLOCK_ENTRIES // min(len(mean), BLOCK_COLUMNS))
        self.height = min(widest, max(256, -(-count // 64)))

    def __iter__(self):
        centred = F.zip_with("x", F.array(*[F.lit(m) for m in self.mean]), lambda x, m: x.cast("double") - m)
        size = PANEL * self.height
        for start in range(0, self.count, size):
            part = self.rows.filter((F.col("index") >= start) & (F.col("index") < start + size))
            part = part.select((F.col("index") - start).alias("index"), array_to_vector(centred).alias("vector"))
            matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(part, "vector"))
            yield start, matrix.toBlockMatrix(self.height, BLOCK_COLUMNS)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix itself; every row block is a part of its own, and parts are added where they are made."""
    left, right = (x._java_matrix_wrapper for x in (blocks.transpose(), blocks))
    made = BlockMatrix(left.call("multiply", right._java_model, max(1, -(-blocks.numRows() // blocks.rowsPerBlock))), blocks.colsPerBlock, blocks.colsPerBlock)
    return made.toLocalMatrix().toArray()


def product(blocks: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """The matrix times a small one."""
    spark = blocks.blocks.ctx
    rows = spark.parallelize([(k, row.tolist()) for k, row in enumerate(weights)], 1)
    return blocks.multiply(IndexedRowMatrix(rows).toBlockMatrix(blocks.colsPerBlock, weights.shape[1]))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The key and OUT for each row and component."""
    kept = vectors.select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("x")).filter("x is not null")
    rows, count = numbered(kept, "whitening-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return rows.sparkSession.createDataFrame([], f"`{key}` {dict(rows.dtypes)['key']}, {OUT}")
    full = F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    rows = rows.withColumn("x", full)
    fit, n = numbered(rows.select("x").distinct(), "whitening-fit")
    sums = [int(s) for s in fit.agg(*[F.sum(F.element_at("x", k + 1).cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)]).first()]
    mean = [s / n for s in sums]

    variance = sum(scatter(blocks) for _, blocks in Panels(fit, n, mean)) / n
    values, axes = np.linalg.eigh((variance + variance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    sure = values > NONE * max(values[0], 0)
    weights = np.where(sure, axes / np.sqrt(np.where(sure, values, 1)), 0)
    whitened = sum(scatter(product(blocks, weights)) for _, blocks in Panels(fit, n, mean)) / n
    error = np.abs(whitened - np.eye(len(values)))[np.ix_(sure, sure)]
    error, trace = float(error.max()) if error.size else None, float(np.trace(variance))

    projected = None
    for start, blocks in Panels(rows, count, mean):
        part = callMLlibFunc("getIndexedRows", product(blocks, weights).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        part = part.select((F.col("index") + start).alias("index"), vector_to_array("vector").alias("projection"))
        projected = part if projected is None else projected.unionByName(part)
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, a: F.try_add(total, F.try_multiply(a, a)))
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    has = F.array(*[F.lit(bool(s)) for s in sure])
    made = rows.select("key", "index", deviation.alias("deviation")).join(projected, "index")
    made = made.select("key", "deviation", "projection", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component"))
    at = lambda values: F.element_at(values, F.col("component"))
    return made.select(
        F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation",
        F.when(at(has), at(F.col("projection"))).alias("whitened"), at(shares).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
