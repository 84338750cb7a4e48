"""Frame streams and bounded fan-out: pacing, warm-up, rings, geometry and half-block rendering.

Frames are rows (seq, width, height, pix), pix holding four bytes a pixel. Everything
here is a DataFrame transformation that runs on batches and inside micro-batches;
only resampling pixels runs Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the player and the publisher (fixed values).
FPS, COLUMNS, ROWS, RING = 24, 80, 24, 64


def ring_last(df: DataFrame, by: list[str], order: list[str], size: int = RING) -> DataFrame:
    """What a subscriber that lags still finds: the newest `size` (at least one) entries of each key, the oldest dropped."""
    newest = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= max(1, size)).drop("_n")


def publish(df: DataFrame, subscribers: list[Callable[[DataFrame, int], None]], checkpoint: str, size: int = RING):
    """A started query that hands every micro-batch, read once, to all subscribers; each gets at most the newest `size` rows by seq."""

    def hand_out(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            kept = batch.orderBy(F.col("seq").desc()).limit(max(1, size)).orderBy("seq")
            for subscriber in subscribers:
                subscriber(kept, epoch)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(hand_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_frames(frames: DataFrame) -> DataFrame:
    """Frames up to the first short one: a short last frame is the end of the stream."""
    short = frames.filter(F.length("pix") != 4 * F.col("width") * F.col("height")).agg(F.min("seq").alias("_end"))
    return frames.join(F.broadcast(short)).filter(F.col("_end").isNull() | (F.col("seq") < F.col("_end"))).drop("_end")


def schedule(frames: DataFrame, fps: int = FPS, arrived: str = "arrived") -> DataFrame:
    """Adds `shown`, the tick (from 0) at which each frame shows.

    The first shows at once; ticking starts when fps / 2 frames wait, or at the end;
    then a frame a tick, never before it arrived (arrived counts ticks). The window
    runs over one stream's frames in order.
    """
    warm = max(1, fps // 2)
    in_order = Window.orderBy("seq")
    rows = frames.withColumn("_n", F.row_number().over(in_order) - 1)
    start = rows.agg(F.coalesce(F.min(F.when(F.col("_n") == warm, F.col(arrived))), F.max(arrived)).alias("_start"))
    rows = rows.join(F.broadcast(start))
    # frame n >= 1 shows at start + n - 1 or later, and one tick or more after the one before
    ready = F.greatest(F.col(arrived), F.col("_start")) - F.col("_n")
    shown = F.when(F.col("_n") == 0, F.col(arrived)).otherwise(F.max(F.when(F.col("_n") > 0, ready)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n"))
    return rows.withColumn("shown", shown).drop("_n", "_start")


def hold_last(df: DataFrame, time: str, value: str, by: list[str], seconds: int = 1) -> DataFrame:
    """One row for each key and tick from its first to its last: the tick's last value, or the one held from before."""
    tick = (F.unix_seconds(F.col(time).cast("timestamp")) / seconds).cast("long")
    last = df.filter(F.col(time).isNotNull()).groupBy(*by, tick.alias("tick")).agg(F.max_by(value, F.struct(time, value)).alias("_v"))
    span = last.groupBy(*by).agg(F.min("tick").alias("_a"), F.max("tick").alias("_b"))
    ticks = span.select(*by, F.explode(F.sequence("_a", "_b")).alias("tick"))
    held = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    return ticks.join(last, [*by, "tick"], "left").withColumn(value, held).drop("_v")


def newest_generation(ticks: DataFrame, generation: str = "generation") -> DataFrame:
    """Without the ticks of older generations of the source."""
    newest = ticks.agg(F.max(generation).alias("_newest"))
    return ticks.join(F.broadcast(newest)).filter(F.col(generation) == F.col("_newest")).drop("_newest")


def fit(width: Column, height: Column, columns: int = COLUMNS, rows: int = ROWS) -> Column:
    """Geometry of a frame kept in proportion on columns x 2 * rows pixels: struct (w, h, x, y), centred."""
    scale = F.least(F.lit(columns) / width, F.lit(2 * rows) / height)
    w, h = F.greatest(F.floor(width * scale), F.lit(1)).cast("int"), F.greatest(F.floor(height * scale), F.lit(1)).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((F.lit(columns) - w) / 2).cast("int").alias("x"), F.floor((F.lit(2 * rows) - h) / 2).cast("int").alias("y"))


def resample(pix: bytes, width: int, height: int, w: int, h: int) -> np.ndarray:
    """Bilinear resampling of an RGBA frame to h x w."""
    image = np.frombuffer(pix, np.uint8).reshape(height, width, 4).astype(np.float64)
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(h, height), at(w, width)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def resize(frames: DataFrame, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """Frames of columns x 2 * rows pixels: in proportion, centred, on black."""
    placed = frames.withColumn("_g", fit(F.col("width"), F.col("height"), columns, rows)).select("seq", "width", "height", "pix", "_g.*")

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            out = []
            for r in pdf.itertuples():
                canvas = np.zeros((2 * rows, columns, 4), np.uint8)
                canvas[:, :, 3] = 255
                canvas[r.y : r.y + r.h, r.x : r.x + r.w] = resample(r.pix, r.width, r.height, r.w, r.h)
                out.append(canvas.tobytes())
            yield pd.DataFrame({"seq": pdf["seq"], "width": columns, "height": 2 * rows, "pix": out})

    return placed.mapInPandas(run, "seq long, width int, height int, pix binary")


def render_half_blocks(pix: Column, width: Column, height: Column) -> Column:
    """A frame as text: each cell an upper half block, its top pixel the foreground, its bottom pixel the background (black below the last row), a reset and a line end after each row."""
    digits = F.hex(pix)
    byte = lambda at: F.conv(F.substring(digits, at * 2 + 1, F.lit(2)), 16, 10)

    def color(x: Column, y: Column) -> Column:
        at = (y * width + x) * 4
        return F.when(y < height, F.concat_ws(";", byte(at), byte(at + 1), byte(at + 2))).otherwise("0;0;0")

    def cell(x: Column, y: Column) -> Column:
        return F.concat(F.lit("\x1b[38;2;"), color(x, y * 2), F.lit("m\x1b[48;2;"), color(x, y * 2 + 1), F.lit("m▀"))

    row = lambda y: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: cell(x, y)), ""), F.lit("\x1b[0m\n"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((height + 1) / 2).cast("int") - 1), row), "")
