"""Positions, map geometry and Web-Mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
HALF_WORLD = math.pi * EARTH_RADIUS
WHOLE_WORLD = (-180.0, -85.0, 180.0, 85.0)
SQUARE_SIZE = 1e-5
TILE_SIZE = 256


def _ratio(rational: Column) -> Column:
    return F.try_divide(rational["num"].cast("double"), rational["den"].cast("double"))


def dms_to_deg(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Rational degrees, minutes and seconds to signed degrees; a missing part or a zero denominator gives null."""
    value = _ratio(degrees) + _ratio(minutes) / F.lit(60.0) + _ratio(seconds) / F.lit(3600.0)
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def point_geometry(lat: Column, lon: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def point_feature(lat: Column, lon: Column, props: Column) -> Column:
    """GeoJSON text of a point feature."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), props.alias("properties"), point_geometry(lat, lon).alias("geometry")
        )
    )


def square_ring(lat: Column, lon: Column, size: float = SQUARE_SIZE) -> Column:
    """Closed ring of five corners around a position."""
    west, east, south, north = lon - F.lit(size), lon + F.lit(size), lat - F.lit(size), lat + F.lit(size)
    return F.array(
        F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south)
    )


def square_polygon(lat: Column, lon: Column, size: float = SQUARE_SIZE) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(square_ring(lat, lon, size)).alias("coordinates"))


def polygon_feature(lat: Column, lon: Column, props: Column, size: float = SQUARE_SIZE) -> Column:
    """GeoJSON text of a square polygon feature."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), props.alias("properties"), square_polygon(lat, lon, size).alias("geometry")
        )
    )


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Web-Mercator metres of an XYZ tile: ``struct<left,bottom,right,top>``."""
    side = F.lit(2 * HALF_WORLD) / F.pow(F.lit(2.0), z)
    left = x * side - F.lit(HALF_WORLD)
    top = F.lit(HALF_WORLD) - y * side
    return F.struct(
        left.alias("left"), (top - side).alias("bottom"), (left + side).alias("right"), top.alias("top")
    )


def mercator_to_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH_RADIUS))


def mercator_to_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS))) - F.lit(math.pi / 2))


def lon_to_mercator(lon: Column) -> Column:
    return F.radians(lon) * F.lit(EARTH_RADIUS)


def lat_to_mercator(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0))) * F.lit(EARTH_RADIUS)


def bounds_wgs84(epsg: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Layer bounds in degrees; what cannot be transformed gets the whole world."""
    corners = {
        "left": (left, mercator_to_lon(left)),
        "bottom": (bottom, mercator_to_lat(bottom)),
        "right": (right, mercator_to_lon(right)),
        "top": (top, mercator_to_lat(top)),
    }
    usable = epsg.isin(4326, 3857)
    for plain, _ in corners.values():
        usable = usable & plain.isNotNull() & ~F.isnan(plain)
    fields = []
    for (name, (plain, projected)), fallback in zip(corners.items(), WHOLE_WORLD):
        value = F.when(epsg == 4326, plain).otherwise(projected)
        fields.append(F.when(usable, value).otherwise(F.lit(fallback)).alias(name))
    return F.struct(*fields)
