"""A stored index of vectors: coarse cells by their nearest centroid, searched by cell.

Cells are folders, so a search reads the cells it needs and no other.  Each cell knows the
widest angle of its vectors from its centroid: after the nearest cells have given k hits, a
cell can hold a better one only if the query's angle to its centroid, less that width, is
under the k-th angle.  Reading just those makes the answer that of a scan of all vectors.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import recall

#: Vectors that the centroids are fitted to, and cells, at most.
SAMPLE, MOST_CELLS = 8192, 1024
PROBES = 4


class VectorIndex:
    """Rows of a table with their cell, at path; `key` is unique, vectors of other lengths, null, zero or not finite have none."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str) -> None:
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector
        self._schema = None

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str, vector: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Centroids by spherical k-means on at most SAMPLE vectors; every vector is put in a cell."""
        out = cls(df.sparkSession, path, key, vector)
        n = df.count()
        cells = max(1, min(cells or math.isqrt(n), MOST_CELLS))
        unit = V.normalize(F.col(vector).cast("array<double>"))
        sample = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key)).limit(SAMPLE).select(unit.alias("v"))
        v = sample.toArrow()["v"].combine_chunks()  # bounded by SAMPLE
        sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
        width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        x = flat[np.repeat(sizes == width, sizes)].reshape(-1, width) if width else np.zeros((0, 0))
        x = x[np.isfinite(x).all(axis=1) & x.any(axis=1)] if width else x
        out._save_centroids(_k_means(x, min(cells, max(1, len(x))), seed))
        out._append(df)
        return out

    # --- writing ---

    def _save_centroids(self, c: np.ndarray) -> None:
        self.spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.path}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        return np.array([r["centroid"] for r in rows]).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)

    def _append(self, df: DataFrame) -> None:
        c = self.centroids()

        @F.pandas_udf("struct<cell: int, angle: double>")
        def placed(vectors: pd.Series) -> pd.DataFrame:
            cell, angle = np.full(len(vectors), -1), np.zeros(len(vectors))
            able = [i for i, v in enumerate(vectors) if v is not None and len(v) == c.shape[1]]
            if able and len(c):
                x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in able])
                norm = np.sqrt((x * x).sum(axis=1))
                fine = np.isfinite(norm) & (norm > 0)
                x, able = x[fine] / norm[fine, None], np.array(able)[fine]
                dots = x @ c.T
                best = dots.argmax(axis=1) if len(x) else np.zeros(0, int)
                cell[able], angle[able] = best, np.arccos(np.clip(dots[np.arange(len(x)), best], -1, 1))
            return pd.DataFrame({"cell": cell.astype("int32"), "angle": angle})

        put = df.withColumn("__put", placed(F.col(self.vector))).select(*df.columns, F.col("__put.angle").alias("__angle"), F.col("__put.cell").alias("cell"))
        self._schema = put.schema
        put.repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        widths = self._rows().where("cell >= 0").groupBy("cell").agg(F.max("__angle").alias("width"), F.count("*").alias("n")).collect()  # at most MOST_CELLS
        text = json.dumps({r["cell"]: [r["width"], r["n"]] for r in widths})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/widths")

    def add_missing(self, df: DataFrame) -> int:
        """Puts the rows of df that the index has not; their number."""
        missing = df.join(self._rows().select(self.key), self.key, "left_anti").select(*df.columns)
        n = missing.count()
        if n:
            self._append(missing)
        return n

    # --- reading ---

    def _rows(self) -> DataFrame:
        read = self.spark.read if self._schema is None else self.spark.read.schema(self._schema)
        return read.parquet(f"{self.path}/rows")

    def cells(self) -> dict[int, tuple[float, int]]:
        """Widest angle and rows of each cell that has rows."""
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/widths").collect())
        return {int(k): tuple(v) for k, v in json.loads(text or "{}").items()}

    def _nearest(self, cells: list[int], query: list[float], k: int, keep: Column | None, ties: tuple[str, ...]) -> DataFrame:
        rows = self._rows().where(F.col("cell").isin(cells))
        rows = rows if keep is None else rows.where(keep)
        return recall.by_vector(rows, self.vector, query, k, None, *ties)

    def search(self, query: list[float], k: int, keep: Column | None = None, probes: int = PROBES, exact: bool = True) -> tuple[DataFrame, list[int]]:
        """(the k rows of greatest cosine with score, those that pass `keep` alone; the cells read).

        Filters apply before the k.  With exact=False only the nearest `probes` cells are read.
        """
        q, known = np.asarray(query, np.float64), self.cells()
        c = self.centroids()
        angles = np.arccos(np.clip(c @ (q / np.sqrt(q @ q)), -1, 1)) if len(c) else np.zeros(0)
        order = sorted(known, key=lambda i: (angles[i], i))
        read = order[:probes]
        ties = (self.key,)
        first = self._nearest(read, query, k, keep, ties)
        if not exact:
            return first.drop("__angle", "cell"), read
        scores = sorted((r["score"] for r in first.select("score").collect()), reverse=True)  # at most k
        reach = math.acos(max(-1.0, min(1.0, scores[k - 1]))) if len(scores) >= k else math.pi
        rest = [i for i in order[probes:] if angles[i] - known[i][0] <= reach + 1e-9] + [-1] * (reach >= math.pi / 2 - 1e-9)  # -1: cosine 0
        found = self._nearest(read + rest, query, k, keep, ties) if rest else first
        return found.drop("__angle", "cell"), read + rest


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine; an empty one keeps its place."""
    if not len(x):
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], c)
    return c
