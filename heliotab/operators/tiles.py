"""Map tiles from georeferenced planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.functions import geo

MAX_BANDS = 3
BLOCK = 1024  # rows and columns of a block of a plane
LOT = 1024  # tiles that one copy of a block serves
BATCH_BYTES = 16_000_000  # of results that wait in a task
_PLANE = ("source", "band")
_GEOMETRY = ("h", "w", "epsg", "x0", "y0", "dx", "dy")


def source_bounds(df: DataFrame) -> DataFrame:
    """Add the corners (left, bottom, right, top) of planes with x0, y0 (upper left), dx, dy (pixel size, dy down)."""
    return df.withColumns(
        {
            "left": F.col("x0"),
            "top": F.col("y0"),
            "right": F.col("x0") + F.col("w") * F.col("dx"),
            "bottom": F.col("y0") - F.col("h") * F.col("dy"),
        }
    )


def _in_mercator(df: DataFrame) -> dict[str, Column]:
    degrees = F.col("epsg") == 4326
    return {
        "left": F.when(degrees, geo.lon_to_mercator(F.col("left"))).otherwise(F.col("left")),
        "right": F.when(degrees, geo.lon_to_mercator(F.col("right"))).otherwise(F.col("right")),
        "bottom": F.when(degrees, geo.lat_to_mercator(F.col("bottom"))).otherwise(F.col("bottom")),
        "top": F.when(degrees, geo.lat_to_mercator(F.col("top"))).otherwise(F.col("top")),
    }


def _tile_range(df: DataFrame, zoom: int) -> dict[str, Column]:
    """First and last tile column and row that the extent (left, bottom, right, top) touches."""
    bounds = _in_mercator(df)
    n = 1 << zoom
    side = 2 * geo.HALF_WORLD / n
    inside = lambda v: F.greatest(F.lit(0), F.least(v, F.lit(n - 1))).cast("int")
    column = lambda x: inside(F.floor((x + F.lit(geo.HALF_WORLD)) / F.lit(side)))
    row = lambda y: inside(F.floor((F.lit(geo.HALF_WORLD) - y) / F.lit(side)))
    x, y = [column(bounds[c]) for c in ("left", "right")], [row(bounds[c]) for c in ("top", "bottom")]
    return {"x_from": F.least(*x), "x_to": F.greatest(*x), "y_from": F.least(*y), "y_to": F.greatest(*y)}


def covering_tiles(df: DataFrame, zoom: int) -> DataFrame:
    """One row per source plane and tile (z, x, y) that its extent touches."""
    touched = _tile_range(df, zoom)
    return (
        df.withColumn("z", F.lit(zoom))
        .withColumn("x", F.explode(F.sequence(touched["x_from"], touched["x_to"])))
        .withColumn("y", F.explode(F.sequence(touched["y_from"], touched["y_to"])))
    )


# ------------------------------------------------------------------------------------------------- reprojection
#
# A plane is cut into blocks that are sent to the tiles' side once, not once per tile. The column of a tile pixel
# depends on its x alone and the row on its y alone, so the pixels of a tile that fall into one block are a rectangle:
# a piece. A block has one more row and column than it owns, which is all that bilinear values need beyond it.


def _with_block_tiles(blocks: DataFrame, zoom: int, size: int) -> DataFrame:
    """Add the range of tiles that pixels of a block may lie in, and the number of lots they make up."""
    first = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(i * size + F.lit(0.5))
    last = lambda i, n: F.least((i + 1) * size + F.lit(0.5), n.cast("double"))
    row, column = F.col("block_row"), F.col("block_col")
    extent = blocks.withColumns(
        {
            "left": F.col("x0") + first(column) * F.col("dx"),
            "right": F.col("x0") + last(column, F.col("w")) * F.col("dx"),
            "top": F.col("y0") - first(row) * F.col("dy"),
            "bottom": F.col("y0") - last(row, F.col("h")) * F.col("dy"),
        }
    )
    ranged = extent.withColumns(_tile_range(extent, zoom)).drop("left", "right", "top", "bottom")
    n = (F.col("x_to") - F.col("x_from") + 1).cast("bigint") * (F.col("y_to") - F.col("y_from") + 1)
    return ranged.withColumn("lots", F.floor((n + LOT - 1) / LOT).cast("int"))


def _block_schema(planes: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in planes.schema}
    return ", ".join(f"{name} {kinds[name]}" for name in (*_PLANE, *_GEOMETRY))


def _pixel_kind(planes: DataFrame) -> str:
    return "float32" if planes.schema["px"].dataType.simpleString() == "array<float>" else "float64"


def plane_blocks(planes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of ``size`` x ``size`` pixels of each plane, with a margin of one pixel to the right and below.

    Cells are a row-major array in bytes, of 4 a pixel for planes of floats and else of 8; unreadable planes (null)
    have no blocks.
    """
    names = [*_PLANE, *_GEOMETRY]
    kind = _pixel_kind(planes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = (batch.column(n).to_pylist() for n in ("h", "w"))
            for i in range(batch.num_rows):
                plane = batch.column("px")[i].values.to_numpy(zero_copy_only=False).astype(kind).reshape(h[i], w[i])
                # One row of blocks at a time.
                for r in range(0, h[i], size):
                    cells = [plane[r : r + size + 1, c : c + size + 1].tobytes() for c in range(0, w[i], size)]
                    n = len(cells)
                    kept = [batch.column(name).take(pa.array([i] * n)) for name in names]
                    place = [pa.array([r // size] * n, pa.int32()), pa.array(range(n), pa.int32())]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, *place, pa.array(cells, pa.binary())], [*names, "block_row", "block_col", "cells"]
                    )

    readable = planes.select(*names, "px").filter((F.size("px") > 0) & (F.size("px") == F.col("h") * F.col("w")))
    return readable.mapInArrow(cut, f"{_block_schema(planes)}, block_row int, block_col int, cells binary")


def _source_places(epsg: int, x0: float, y0: float, dx: float, dy: float, left: float, top: float, step: float, n: int):
    """Column and row in the source, in pixels, of the pixel centres of an n x n tile."""
    centre = (np.arange(n) + 0.5) * step
    x, y = left + centre, top - centre
    if epsg == 4326:
        x = np.degrees(x / geo.EARTH_RADIUS)
        y = np.degrees(2 * np.arctan(np.exp(y / geo.EARTH_RADIUS)) - np.pi / 2)
    return (x - x0) / dx, (y0 - y) / dy


def _in_block(place: np.ndarray, length: int, block: int, size: int):
    """Which pixels of a tile's side lie in a block: their range, nearest lower source pixel and weight of the next."""
    at = np.clip(place - 0.5, 0, length - 1)
    low = np.floor(at).astype(int)
    mine = np.flatnonzero((place >= 0) & (place < length) & (low // size == block))
    if not len(mine):
        return None
    part = slice(int(mine[0]), int(mine[-1]) + 1)
    start = low[part] - block * size
    return part, start, np.minimum(low[part] + 1, length - 1) - block * size, at[part] - low[part]


def _piece(cells: np.ndarray, row: dict, tile_size: int, size: int):
    """The rectangle of a tile that lies in a block: (first row, first column, values), or None."""
    geometry = [row[n] for n in ("epsg", "x0", "y0", "dx", "dy", "left", "top", "step")]
    u, v = _source_places(*geometry, tile_size)
    across, down = _in_block(u, row["w"], row["block_col"], size), _in_block(v, row["h"], row["block_row"], size)
    if across is None or down is None:
        return None
    (columns, c0, c1, a), (rows, r0, r1, b) = across, down
    upper = cells[np.ix_(r0, c0)] * (1 - a) + cells[np.ix_(r0, c1)] * a
    lower = cells[np.ix_(r1, c0)] * (1 - a) + cells[np.ix_(r1, c1)] * a
    return rows.start, columns.start, upper * (1 - b[:, None]) + lower * b[:, None]


def _answers(batches: Iterator[pa.RecordBatch], pixel: str, tile_size: int, size: int) -> Iterator[tuple]:
    """The piece of each tile that asks a block, or None; blocks stand before the tiles which ask for them."""
    cells = held = None
    place = ("source", "band", "block_row", "block_col", "lot")
    for batch in batches:
        sent = batch.column("cells")
        for i, row in enumerate(batch.drop_columns(["cells"]).to_pylist()):
            if sent[i].is_valid:
                cells = np.frombuffer(sent[i].as_buffer(), dtype=pixel)
                rest = min(size + 1, row["w"] - row["block_col"] * size)
                cells, held = cells.reshape(-1, rest), [row[n] for n in place]
                continue
            # A plane that can't be read has sent no block.
            yield batch.schema, row, _piece(cells, row, tile_size, size) if held == [row[n] for n in place] else None


def _pieces(asked: DataFrame, kinds: str, pixel: str, tile_size: int, size: int) -> DataFrame:
    """Pieces of the tiles."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("source", "band", "z", "x", "y", "row", "col", "cols", "cells")
        out: list[tuple] = []
        types: list[pa.DataType] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for schema, row, piece in _answers(batches, pixel, tile_size, size):
            if piece is None:
                continue
            types = [schema.field(n).type for n in names[:5]] + [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            first, start, values = piece
            out.append((*[row[n] for n in names[:5]], first, start, values.shape[1], values.tobytes()))
            waiting += values.nbytes
            if waiting > BATCH_BYTES:
                yield flush()
                waiting = 0
        if out:
            yield flush()

    return asked.mapInArrow(answer, f"{kinds}, z int, x int, y int, row int, col int, cols int, cells binary")


_TILE = ("source", "band", "z", "x", "y")


def _tile_batch(done: list[tuple[tuple, np.ndarray]], types: list[pa.DataType], tile_size: int) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*[k for k, _ in done]), types)]
    offsets = pa.array(np.arange(len(done) + 1) * tile_size * tile_size, pa.int32())
    px = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t for _, t in done])))
    done.clear()
    return pa.RecordBatch.from_arrays([*columns, px], [*_TILE, "px"])


def _whole(asked: DataFrame, kinds: str, pixel: str, tile_size: int, size: int, stretch: bool) -> DataFrame:
    """Tiles of planes that are one block: the piece is all that a tile holds."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[tuple, np.ndarray]] = []
        types: list[pa.DataType] = []
        for schema, row, piece in _answers(batches, pixel, tile_size, size):
            types = [schema.field(n).type for n in _TILE]
            tile = np.zeros((tile_size, tile_size))
            if piece is not None:
                first, start, values = piece
                tile[first : first + len(values), start : start + values.shape[1]] = values
            done.append((tuple(row[n] for n in _TILE), stretched(tile.ravel()) if stretch else tile.ravel()))
            if len(done) * tile.nbytes > BATCH_BYTES:
                yield _tile_batch(done, types, tile_size)
        if done:
            yield _tile_batch(done, types, tile_size)

    return asked.mapInArrow(answer, f"{kinds}, z int, x int, y int, px array<{'int' if stretch else 'double'}>")


def _assembled(pieces: DataFrame, kinds: str, tile_size: int, stretch: bool) -> DataFrame:
    """Tiles put together from pieces, those of a tile one after another; a row without piece stands for the tile."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _TILE
        key, tile = None, None
        done: list[tuple[tuple, np.ndarray]] = []
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            keys = list(zip(*[batch.column(n).to_pylist() for n in names]))
            rows, cols, widths = (batch.column(n).to_pylist() for n in ("row", "col", "cols"))
            cells = batch.column("cells")
            for i, here in enumerate(keys):
                if here != key:
                    if tile is not None:
                        done.append((key, stretched(tile.ravel()) if stretch else tile.ravel()))
                    key, tile = here, np.zeros((tile_size, tile_size))
                    if len(done) * tile.nbytes > BATCH_BYTES:
                        yield _tile_batch(done, types, tile_size)
                if cells[i].is_valid:
                    values = np.frombuffer(cells[i].as_buffer(), dtype=np.float64).reshape(-1, widths[i])
                    tile[rows[i] : rows[i] + len(values), cols[i] : cols[i] + widths[i]] = values
        if tile is not None:
            done.append((key, stretched(tile.ravel()) if stretch else tile.ravel()))
            yield _tile_batch(done, types, tile_size)

    return pieces.mapInArrow(join, f"{kinds}, z int, x int, y int, px array<{'int' if stretch else 'double'}>")


def stretched(values: np.ndarray) -> np.ndarray:
    """Tile values stretched between their 2nd and 98th percentile to 0..255, as
    :func:`~heliotab.functions.planes.stretch_plane` does."""
    finite = np.sort(values[np.isfinite(values)])
    if not len(finite):
        return np.zeros(len(values), dtype=np.int32)

    def percentile(q: float) -> float:
        place = q * float(len(finite) - 1)
        low = int(place)
        return finite[low] + (finite[min(low + 1, len(finite) - 1)] - finite[low]) * (place - low)

    low, high = percentile(0.02), percentile(0.98)
    top = low + 1.0 if high <= low else high
    part = np.clip((values - low) / (top - low), 0.0, 1.0)
    return np.floor(np.where(np.isnan(part), 0.0, part) * 255).astype(np.int32)


def reproject_tiles(
    planes: DataFrame, zoom: int, tile_size: int = geo.TILE_SIZE, stretch: bool = False, block: int = BLOCK
) -> DataFrame:
    """Tiles (source, band, z, x, y, px) that planes touch at a zoom level: bilinear values, row-major from the upper
    left corner, 0 outside the source; with ``stretch`` between their percentiles as 0..255.

    (source, band) tells planes apart. Each block of a plane is shuffled once per LOT tiles that it is needed for, which
    is once but for planes blown up to many tiles. Tiles of planes that are one block come out of that as they are; of
    larger planes the pieces are shuffled once more, to their tiles. No task holds more than a block, a tile and
    BATCH_BYTES of results. An unreadable plane (null, or not h x w pixels) gives tiles of 0.
    """
    parts = int(planes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(_block_schema(planes).split(", ")[:2])
    single = F.coalesce((F.col("h") <= block) & (F.col("w") <= block), F.lit(True))
    small, large = planes.filter(single), planes.filter(~single)
    whole = _whole(_meeting(small, zoom, tile_size, block, parts), kinds, _pixel_kind(planes), tile_size, block, stretch)
    pieces = _pieces(_meeting(large, zoom, tile_size, block, parts), kinds, _pixel_kind(planes), tile_size, block)
    every = covering_tiles(source_bounds(large.select(*_PLANE, *_GEOMETRY)), zoom).select(*_TILE)
    joined = pieces.unionByName(every, allowMissingColumns=True).repartition(parts, *_TILE).sortWithinPartitions(*_TILE)
    return whole.unionByName(_assembled(joined, kinds, tile_size, stretch))


def _meeting(planes: DataFrame, zoom: int, tile_size: int, block: int, parts: int) -> DataFrame:
    """Blocks of planes and the tiles that ask for them, block by block."""
    geometry = planes.select(*_PLANE, *_GEOMETRY)
    # The same blocks twice: with their cells, and without for the tiles that need them.
    count = lambda n: F.greatest(F.lit(0), F.floor((F.col(n) + block - 1) / block).cast("int") - 1)
    grid = geometry.withColumn("block_row", F.explode(F.sequence(F.lit(0), count("h"))))
    grid = grid.withColumn("block_col", F.explode(F.sequence(F.lit(0), count("w"))))
    wanted = _with_block_tiles(grid, zoom, block)
    wanted = wanted.withColumn("x", F.explode(F.sequence("x_from", "x_to")))
    wanted = wanted.withColumn("y", F.explode(F.sequence("y_from", "y_to")))
    rank = (F.col("x") - F.col("x_from")).cast("bigint") * (F.col("y_to") - F.col("y_from") + 1) + F.col("y") - F.col("y_from")
    bounds = geo.tile_bounds(F.lit(zoom), F.col("x"), F.col("y"))
    wanted = wanted.withColumns(
        {
            "lot": F.floor(rank / LOT).cast("int"),
            "z": F.lit(zoom),
            "left": bounds["left"],
            "top": bounds["top"],
            "step": (bounds["right"] - bounds["left"]) / F.lit(float(tile_size)),
        }
    )
    sent = _with_block_tiles(plane_blocks(planes, block), zoom, block)
    sent = sent.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    place = ["source", "band", "block_row", "block_col", "lot"]
    drop = ["x_from", "x_to", "y_from", "y_to", "lots"]
    met = sent.drop(*drop).unionByName(wanted.drop(*drop), allowMissingColumns=True)
    return met.repartition(parts, *place).sortWithinPartitions(*place, F.col("cells").isNull())


def rgb_tiles(tiles: DataFrame, keys: tuple[str, ...] = ("source", "z", "x", "y")) -> DataFrame:
    """Tile bands to the red, green and blue arrays of one row per tile.

    One band is grey in all three, with two the third is 0; further bands are left out.
    """
    used = tiles.filter(F.col("band") < MAX_BANDS)
    bands = used.groupBy(*keys).agg(
        *[F.first(F.when(F.col("band") == i, F.col("px")), ignorenulls=True).alias(f"b{i}") for i in range(MAX_BANDS)]
    )
    grey = F.col("b1").isNull() & F.col("b2").isNull()
    zeros = F.transform("b0", lambda v: F.lit(0))
    other = lambda c: F.when(grey, F.col("b0")).otherwise(F.coalesce(c, zeros))
    return bands.select(*keys, F.col("b0").alias("red"), other("b1").alias("green"), other("b2").alias("blue"))
