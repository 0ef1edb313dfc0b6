"""Map layers: extents and stretched tiles of georeferenced planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import geo
from heliotab.operators import tiles


def layers(planes: DataFrame) -> DataFrame:
    """Extent in degrees and zoom range per source."""
    sources = tiles.source_bounds(planes).groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("epsg", "left", "bottom", "right", "top")]
    )
    bounds = geo.bounds_wgs84(*[F.col(c) for c in ("epsg", "left", "bottom", "right", "top")])
    return sources.select("source", bounds.alias("b"), F.lit(0).alias("minzoom"), F.lit(22).alias("maxzoom")).select(
        "source", "b.*", "minzoom", "maxzoom"
    )


def map_tiles(planes: DataFrame, zoom: int, tile_size: int = geo.TILE_SIZE) -> DataFrame:
    """Stretched tiles (source, band, z, x, y, px) of one zoom level."""
    return tiles.reproject_tiles(planes, zoom, tile_size, stretch=True)
