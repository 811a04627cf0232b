"""Images as strips: each row holds some of an image's lines of pixels, so an image is many rows and no task holds it whole.

A strip is image_id, y (its first line), w and h (sides of the whole image), channels, and pixels: binary, lines of w pixels of ``channels``
bytes each (1: grey, 3: red, green, blue, 4: with transparency). A null or empty ``pixels`` has no lines and stays so. image_id is of any type;
strips with a null one belong to no image and are left out where images are joined or grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators import raster

#: Bytes of a strip, about; one line at least.
STRIP_BYTES = 256 << 10
#: Strips meet their image's table in parts of about so many bytes, so a large image is dealt to many tasks.
PART_BYTES = 64 << 20
COLUMNS = ("image_id", "y", "w", "h", "channels", "pixels")


def _ddl(rows: DataFrame) -> str:
    return f"image_id {rows.schema['image_id'].dataType.simpleString()}, y long, w long, h long, channels int, pixels binary"


def _mapped(strips: DataFrame, change: Callable, *more: str) -> DataFrame:
    """Strips with ``pixels`` (and channels) changed: ``change(array of pixels x channels, *more)`` gives such an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channels, changed = [], []
            for n, content, *own in zip(batch.column("channels").to_pylist(), batch.column("pixels"), *(batch.column(c).to_pylist() for c in more), strict=True):
                if content.is_valid and n:
                    new = change(_array(content, n), *own)
                    channels.append(new.shape[1])
                    changed.append(np.ascontiguousarray(new, np.uint8).tobytes())
                else:
                    channels.append(n)
                    changed.append(content.as_py())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS[:4]), pa.array(channels, pa.int32()), pa.array(changed, pa.binary())], list(COLUMNS))

    return strips.select(*COLUMNS, *more).mapInArrow(run, _ddl(strips))


def _array(content: pa.Scalar, channels: int) -> np.ndarray:
    return np.frombuffer(content.as_buffer() or b"", np.uint8).reshape(-1, channels)


def composited(pixels: np.ndarray) -> np.ndarray:
    """Pixels (last axis: channels) with transparency laid on white, halves to even; others as they are."""
    if pixels.shape[-1] != 4:
        return pixels
    opacity = pixels[..., 3:].astype(np.float64)
    return np.rint((pixels[..., :3] * opacity + 255.0 * (255.0 - opacity)) / 255.0).astype(np.uint8)


def on_white(strips: DataFrame) -> DataFrame:
    """Strips without transparency."""
    return _mapped(strips, composited)


def brightness(pixels: np.ndarray) -> np.ndarray:
    """Brightness of pixels x channels, truncated; grey pixels have their own."""
    if pixels.shape[1] == 1:
        return pixels[:, 0]
    pixels = composited(pixels)
    return (pixels[:, 0] * 0.299 + pixels[:, 1] * 0.587 + pixels[:, 2] * 0.114).astype(np.uint8)


def cut(images: DataFrame, decoder: Callable, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Strips of images (image_id, content), as ``decoder()(content)`` gives them: height x width x channels. What can't be decoded gives none.

    For images that a task can decode whole; ``sources.strips`` reads larger ones line by line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder()
        for batch in batches:
            for image, content in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    pixels = np.asarray(decode(content), np.uint8)
                except Exception:  # noqa: BLE001  (a value for ``undecoded``, no failure of the run)
                    continue
                h, w, n = pixels.shape
                lines = max(1, strip_bytes // max(1, w * n))
                for y in range(0, h, lines):
                    row = ([image.as_py()], [y], [w], [h], [n], [pixels[y : y + lines].tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], list(COLUMNS))

    return images.select("image_id", "content").mapInArrow(run, _ddl(images))


def histograms(strips: DataFrame) -> DataFrame:
    """image_id, v, n: how often each brightness occurs, as ``raster.histogram`` gives it. A batch sends at most 256 rows an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            counts = np.zeros((len(coded.dictionary), 256), np.int64)
            for k, n, content in zip(coded.indices.to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k is not None and n and content.is_valid:
                    counts[k] += np.bincount(brightness(_array(content, n)), minlength=256)
            image, v = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(image)), pa.array(v.astype(np.int32)), pa.array(counts[image, v])], ["image_id", "v", "n"])

    partial = strips.select("image_id", "channels", "pixels").mapInArrow(run, f"image_id {strips.schema['image_id'].dataType.simpleString()}, v int, n long")
    return partial.groupBy("image_id", "v").agg(F.sum("n").alias("n"))


def tables(hist: DataFrame, contrast: bool = True, black_white: bool = False) -> DataFrame:
    """image_id, table: the new value of each of the 256 brightnesses of an image, as binary.

    The threshold is found on the histogram moved by the contrast step, so pixels are counted once.
    """
    bounds = raster.contrast_bounds(hist) if contrast else hist.select("image_id", F.lit(0).alias("lo"), F.lit(255).alias("hi")).distinct()
    value = lambda v: raster.stretched(v, F.col("lo"), F.col("hi"))
    if black_white:
        moved = hist.join(bounds, "image_id").groupBy("image_id", value(F.col("v")).alias("v")).agg(F.sum("n").alias("n"))
        bounds = bounds.join(raster.otsu(moved), "image_id")
    new = (lambda v: F.when(value(v) > F.col("threshold"), 255).otherwise(0)) if black_white else value
    every = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.lpad(F.hex(new(v).cast("long")), 2, "0"))
    return bounds.select("image_id", F.unhex(F.array_join(every, "")).alias("table"))


def _part() -> Column:
    return F.floor(F.col("y") * F.col("w") * F.col("channels") / PART_BYTES)


def enhance(strips: DataFrame, contrast: bool = True, black_white: bool = False, gray: bool = True) -> DataFrame:
    """Strips of one channel after the chosen steps, as ``raster.enhance`` gives them pixel by pixel; the strips themselves where none is chosen.

    Each image's table goes to every part of PART_BYTES of the image, one row a part, and strips are joined by image and part.
    """
    if not (contrast or black_white or gray):
        return strips
    if not (contrast or black_white):
        return _mapped(strips, lambda p: brightness(p)[:, None])
    parts = strips.select("image_id", _part().alias("part")).distinct()
    told = tables(histograms(strips), contrast, black_white).join(parts, "image_id")
    met = strips.select(*COLUMNS, _part().alias("part")).join(told, ["image_id", "part"])
    return _mapped(met, lambda p, table: np.frombuffer(table, np.uint8)[brightness(p)][:, None], "table")


def turned(strips: DataFrame, rotation: Column, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Strips of images turned clockwise by ``rotation`` (0, 90, 180, 270; the same for all strips of an image).

    By a quarter, each strip is cut into tiles of as many columns as make a strip of the turned image; these are turned, and the
    tiles of one new strip are put side by side. So tasks hold tiles of single new strips. Half a turn moves no strip between tasks.
    Strips without pixels are left out by a quarter, and stay by other turns.
    """
    given = strips.select(*COLUMNS, F.pmod(rotation, F.lit(360)).cast("int").alias("turn"))

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, changed = [], []
            for y, w, h, n, content in zip(*(batch.column(c).to_pylist() for c in COLUMNS[1:5]), batch.column("pixels"), strict=True):
                pixels = _array(content, n)[::-1] if content.is_valid and n and w else None
                ys.append(y if pixels is None else h - y - len(pixels) // w)
                changed.append(content.as_py() if pixels is None else pixels.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(ys, pa.int64()), *(batch.column(c) for c in COLUMNS[2:5]), pa.array(changed, pa.binary())], list(COLUMNS))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, y, w, h, n, content, turn in zip(batch.column(0), *(batch.column(c).to_pylist() for c in COLUMNS[1:5]), batch.column("pixels"), batch.column("turn").to_pylist(), strict=True):
                if not (content.as_py() and n and w and h):
                    continue
                pixels = _array(content, n).reshape(-1, w, n)
                lines, columns = len(pixels), max(1, strip_bytes // (h * n))
                edges = range(0, w, columns)
                own = [np.rot90(pixels[:, x : x + columns], -1 if turn == 90 else 1) for x in edges]
                at = [x if turn == 90 else w - min(w, x + columns) for x in edges]
                left = h - y - lines if turn == 90 else y
                whole = ([image.as_py()] * len(own), at, [h] * len(own), [w] * len(own), [n] * len(own), [np.ascontiguousarray(t).tobytes() for t in own], [left] * len(own))
                types = (batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(whole, types, strict=True)], [*COLUMNS, "x"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for w, n, row in zip(batch.column("w").to_pylist(), batch.column("channels").to_pylist(), batch.column("tiles").to_pylist(), strict=True):
                starts = [t["x"] for t in row] + [w]
                own = [np.frombuffer(t["pixels"], np.uint8).reshape(-1, b - a, n) for t, a, b in zip(row, starts, starts[1:])]
                whole.append(np.concatenate(own, axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS[:5]), pa.array(whole, pa.binary())], list(COLUMNS))

    kept = given.where("turn = 0").drop("turn")
    halves = given.where("turn = 180").drop("turn").mapInArrow(half, _ddl(strips))
    made = given.where("turn IN (90, 270)").mapInArrow(tiles, _ddl(strips) + ", x long")
    sides = made.where("image_id IS NOT NULL").groupBy("image_id", "y").agg(*[F.first(c).alias(c) for c in ("w", "h", "channels")], F.array_sort(F.collect_list(F.struct("x", "pixels"))).alias("tiles"))
    return kept.unionByName(halves).unionByName(sides.mapInArrow(beside, _ddl(strips)))


def pixels(strips: DataFrame) -> DataFrame:
    """image_id, p, r, g, b: a row for each pixel, numbered along the lines; grey ones have all three alike."""
    size = F.octet_length("pixels")
    n = F.when(size > 0, F.col("channels"))
    byte = lambda at: F.conv(F.hex(F.substring("pixels", at, F.lit(1))), 16, 10).cast("int")
    each = strips.where(size > 0).select("image_id", (F.col("y") * F.col("w")).alias("from"), n.alias("n"), "pixels", F.explode(F.sequence(F.lit(0), (size / n - 1).cast("int"))).alias("k"))
    at = F.col("k") * F.col("n") + 1
    beside = lambda c: F.when(F.col("n") == 1, at).otherwise(at + c).cast("int")
    return each.select("image_id", (F.col("from") + F.col("k")).alias("p"), *[byte(beside(c)).alias(name) for c, name in enumerate(("r", "g", "b"))])
