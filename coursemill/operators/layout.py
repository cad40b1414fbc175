"""Boxes on pages: overlap, suppression, nearest neighbours, ownership."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IOU, OWNED = 0.75, 0.72
#: Height of the bands in which boxes of a page meet.
BAND = 100.0


def bands(top: Column, bottom: Column) -> Column:
    """The bands of a page that a box reaches."""
    return F.sequence(F.floor(top / BAND), F.floor(bottom / BAND))


def valid_box(box: str) -> Column:
    """Whether a box has four numbers and an area."""
    c = F.col(box)
    return F.coalesce((F.size(c) == 4) & (c[2] > c[0]) & (c[3] > c[1]), F.lit(False))


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inner = intersection(a, b)
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """The part of a that b covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of a page as pixels, halves to even."""
    return F.array(*[F.bround(box[i] * (width if i % 2 == 0 else height) / 1000).cast("int") for i in range(4)])


def clean_box(box: Column, least: float = 3.0) -> Column:
    """A box in 0..1000 with its corners in order, rounded to two places; null where a side is under least."""
    c = F.transform(box, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), x.cast("double"))))
    out = F.array(*[F.round(x, 2) for x in (F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3]))])
    return F.when((F.size(box) == 4) & (out[2] - out[0] >= least) & (out[3] - out[1] >= least), out)


def suppress(rows: DataFrame, group: list[str], least: float = IOU) -> DataFrame:
    """(id) of the boxes that stay: by confidence, those over least of a stronger box of the same kind are dropped.

    rows has id, bbox, confidence and the group columns (a page and a kind, so a group is small).
    Null confidence counts as 0; rows without a valid box are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True])
        boxes = np.array(pdf["bbox"].tolist(), float).reshape(-1, 4)
        areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        kept: list[int] = []
        for i in range(len(boxes)):
            k = np.array(kept, int)
            w = np.minimum(boxes[k, 2], boxes[i, 2]) - np.maximum(boxes[k, 0], boxes[i, 0])
            h = np.minimum(boxes[k, 3], boxes[i, 3]) - np.maximum(boxes[k, 1], boxes[i, 1])
            inner = np.maximum(w, 0) * np.maximum(h, 0)
            if not len(k) or (inner / (areas[k] + areas[i] - inner) < least).all():
                kept.append(i)
        return pdf.iloc[kept][["id"]]

    ready = rows.where(valid_box("bbox")).select("id", "bbox", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *group)
    return ready.groupBy(*group).applyInPandas(run, "id string")


def nearest(left: DataFrame, right: DataFrame, page: list[str], k: int = 3, gap: float = 72.0, column: float = 48.0) -> DataFrame:
    """(id, other, distance, rank): the k boxes of right nearest above or below each box of left in its column of the page.

    Both have id, bbox and the page columns; an equality join on page and band, then four inequalities.
    """
    a = left.where(valid_box("bbox")).select(*page, F.col("id"), F.col("bbox").alias("a"), F.explode(bands(F.col("bbox")[1] - gap, F.col("bbox")[3] + gap)).alias("band"))
    b = right.where(valid_box("bbox")).select(*page, F.col("id").alias("other"), F.col("bbox").alias("b"), F.explode(bands(F.col("bbox")[1], F.col("bbox")[3])).alias("band"))
    pairs = a.join(b, [*page, "band"]).where(F.col("id") != F.col("other")).drop("band").dropDuplicates([*page, "id", "other"])
    vertical = F.greatest(F.lit(0.0), F.col("b")[1] - F.col("a")[3], F.col("a")[1] - F.col("b")[3])
    pairs = pairs.withColumn("distance", vertical).where((F.col("distance") <= gap) & (F.col("b")[0] <= F.col("a")[2] + column) & (F.col("b")[2] >= F.col("a")[0] - column))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return pairs.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("id", "other", F.round("distance", 2).alias("distance"), "rank")


def overlapping(left: DataFrame, right: DataFrame, page: list[str], least: float = 0.0) -> DataFrame:
    """(id, other, part): boxes of right that cover more than least of a box of left on its page."""
    a = left.where(valid_box("bbox")).select(*page, F.col("id"), F.col("bbox").alias("a"), F.explode(bands(F.col("bbox")[1], F.col("bbox")[3])).alias("band"))
    b = right.where(valid_box("bbox")).select(*page, F.col("id").alias("other"), F.col("bbox").alias("b"), F.explode(bands(F.col("bbox")[1], F.col("bbox")[3])).alias("band"))
    out = a.join(b, [*page, "band"]).where(F.col("id") != F.col("other")).drop("band").dropDuplicates([*page, "id", "other"]).withColumn("part", F.round(overlap(F.col("a"), F.col("b")), 4))
    return out.where(F.col("part") > least).select("id", "other", "part")


def reading_order(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows with place: from 1 by order number, then down and across the page."""
    w = Window.partitionBy(*page).orderBy("reading_order", F.col("bbox")[1], F.col("bbox")[0], "id")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint"))




def nearest_caption(figures: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """(id, caption_id, cost): the caption of each figure on its page: above or below it by at most 24 units or 1.5 heights, the cheapest by gap and a twentieth of the sideways distance."""
    a = figures.where(valid_box("bbox")).select(*page, "id", F.col("bbox").alias("a"))
    b = captions.where(valid_box("bbox")).select(*page, F.col("id").alias("caption_id"), F.col("bbox").alias("b"))
    x, y = F.col("a"), F.col("b")
    reach = F.greatest(F.lit(24.0), 1.5 * (x[3] - x[1]))
    a = a.withColumn("band", F.explode(bands(x[1] - reach, x[3] + reach)))
    pairs = a.join(b.withColumn("band", F.explode(bands(y[1], y[3]))), [*page, "band"]).where(F.col("id") != F.col("caption_id"))
    vertical = F.greatest(F.lit(0.0), y[1] - x[3], x[1] - y[3])
    sideways = F.abs((x[0] + x[2]) - (y[0] + y[2])) / 2
    near = pairs.where(vertical <= reach).withColumn("cost", F.round(vertical + 0.05 * sideways, 4))
    best = near.groupBy("id").agg(F.min(F.struct("cost", "caption_id")).alias("m"))
    return best.select("id", F.col("m.caption_id").alias("caption_id"), F.col("m.cost").alias("cost"))


def keep_largest(rows: DataFrame, group: list[str], least: float = OWNED) -> DataFrame:
    """(id) of the boxes that stay: by area, a smaller one is dropped when least of it lies in a larger one of its group (or the other way round)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = np.array(pdf["bbox"].tolist(), float).reshape(-1, 4)
        areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        order = sorted(range(len(pdf)), key=lambda i: (-areas[i], pdf["id"].iloc[i]))
        kept: list[int] = []
        for i in order:
            k = np.array(kept, int)
            w = np.minimum(boxes[k, 2], boxes[i, 2]) - np.maximum(boxes[k, 0], boxes[i, 0])
            h = np.minimum(boxes[k, 3], boxes[i, 3]) - np.maximum(boxes[k, 1], boxes[i, 1])
            inner = np.maximum(w, 0) * np.maximum(h, 0)
            if not len(k) or (inner < least * np.minimum(areas[k], areas[i])).all():
                kept.append(i)
        return pdf.iloc[kept][["id"]]

    ready = rows.where(valid_box("bbox")).select("id", "bbox", *group)
    return ready.groupBy(*group).applyInPandas(run, "id string")
