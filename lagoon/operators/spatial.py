"""Boxes, grids and a quadtree over lon/lat."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.series import unused

#: Cells up to which point lookups broadcast the table of cells and their leaves.
BROADCAST_CELLS = 50_000


def bounding_box(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows with lon0 <= lon <= lon1 and lat0 <= lat <= lat1; box is (lon0, lat0, lon1, lat1)."""
    return df.where(F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3]))


def quantile_box(df: DataFrame, lon: str, lat: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows between two quantiles (linear interpolation) of both coordinates."""
    q = df.agg(F.percentile(lon, low), F.percentile(lat, low), F.percentile(lon, high), F.percentile(lat, high)).first()
    return df.limit(0) if q[0] is None else bounding_box(df, lon, lat, tuple(q))


def cell(x: str, low: float, high: float, n: int) -> Column:
    """Cell 0..n-1 of n equal ones; the upper edge belongs to the last."""
    return F.least(F.floor((F.col(x) - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")


def right_closed_cell(x: str, low: float, high: float, n: int) -> Column:
    """Cell 1..n of n right-closed ones; the lower edge belongs to the first."""
    return F.greatest(F.ceil((F.col(x) - low) / ((high - low) / n)), F.lit(1)).cast("int")


def grid_counts(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float], n_lon: int, n_lat: int) -> DataFrame:
    """ix, iy, n: rows by cell within the box."""
    inside = bounding_box(df, lon, lat, box)
    return inside.groupBy(cell(lon, box[0], box[2], n_lon).alias("ix"), cell(lat, box[1], box[3], n_lat).alias("iy")).agg(F.count("*").alias("n"))


def density(df: DataFrame, lon: str, lat: str, step_lon: float, step_lat: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(lon) / step_lon).alias("ix"), F.floor(F.col(lat) / step_lat).alias("iy")).agg(F.count("*").alias("n"))


def spatial_bins(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float], n: int = 19) -> DataFrame:
    """df with bin, 'lon_lat' of right-closed cells."""
    return df.withColumn("bin", F.concat_ws("_", right_closed_cell(lon, box[0], box[2], n), right_closed_cell(lat, box[1], box[3], n)))


@dataclass(frozen=True)
class Leaf:
    leaf_id: int
    lon0: float
    lat0: float
    lon1: float
    lat1: float
    n: int


class QuadTree:
    """Cells split in four while they hold more than min_samples rows, down to one grid cell; from grid counts, whose size the grid fixes."""

    def __init__(self, leaves: list[Leaf], box: tuple[float, float, float, float], leaf_of: np.ndarray):
        self.leaves, self.box, self.leaf_of = leaves, box, leaf_of  # leaf_of[ix, iy]: the leaf of a grid cell

    @classmethod
    def build(cls, counts: DataFrame, box: tuple[float, float, float, float], n_lon: int, n_lat: int, min_samples: int) -> QuadTree:
        m = np.zeros((n_lon, n_lat), np.int64)
        for ix, iy, n in counts.select("ix", "iy", "n").collect():
            m[ix, iy] = n
        lon = lambda i: box[0] + (box[2] - box[0]) * i / n_lon
        lat = lambda i: box[1] + (box[3] - box[1]) * i / n_lat
        leaves: list[Leaf] = []
        leaf_of = np.zeros((n_lon, n_lat), np.int32)
        todo = [(0, n_lon, 0, n_lat)]
        while todo:
            a, b, c, d = todo.pop()
            n = int(m[a:b, c:d].sum())
            if n > min_samples and (b - a > 1 or d - c > 1):
                across, up = sorted({a, (a + b) // 2, b}), sorted({c, (c + d) // 2, d})
                todo += [(x0, x1, y0, y1) for x0, x1 in zip(across, across[1:], strict=False) for y0, y1 in zip(up, up[1:], strict=False)][::-1]
            else:
                leaf_of[a:b, c:d] = len(leaves)
                leaves.append(Leaf(len(leaves), lon(a), lat(c), lon(b), lat(d), n))
        return cls(leaves, box, leaf_of)

    def leaves_df(self, spark) -> DataFrame:
        """leaf_id, edges, centre and count of each leaf."""
        rows = [(x.leaf_id, x.lon0, x.lat0, x.lon1, x.lat1, (x.lon0 + x.lon1) / 2, (x.lat0 + x.lat1) / 2, x.n) for x in self.leaves]
        return spark.createDataFrame(rows, "leaf_id int, lon0 double, lat0 double, lon1 double, lat1 double, lon_c double, lat_c double, n long")

    def align(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """df with its leaf's leaf_id, lon_c and lat_c; null outside the box. Upper edges of the box belong to the last leaves."""
        spark, (n_lon, n_lat) = df.sparkSession, self.leaf_of.shape
        ix, iy = np.indices(self.leaf_of.shape)
        ix_name, iy_name = unused(df, "ix"), unused(df, "iy")
        cells = spark.createDataFrame(pa.table({ix_name: ix.ravel().astype(np.int32), iy_name: iy.ravel().astype(np.int32), "leaf_id": self.leaf_of.ravel()}))
        cells = cells.join(F.broadcast(self.leaves_df(spark).select("leaf_id", "lon_c", "lat_c")), "leaf_id") if ix.size <= BROADCAST_CELLS else cells.join(self.leaves_df(spark).select("leaf_id", "lon_c", "lat_c"), "leaf_id")
        inside = F.col(lon).between(self.box[0], self.box[2]) & F.col(lat).between(self.box[1], self.box[3])
        at = {ix_name: F.when(inside, cell(lon, self.box[0], self.box[2], n_lon)), iy_name: F.when(inside, cell(lat, self.box[1], self.box[3], n_lat))}
        cells = F.broadcast(cells) if ix.size <= BROADCAST_CELLS else cells
        return df.withColumns(at).join(cells, [ix_name, iy_name], "left").select(*df.columns, "leaf_id", "lon_c", "lat_c")
