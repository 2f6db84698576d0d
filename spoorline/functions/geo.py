"""WGS 84 expressions on plain latitude and longitude doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.text import col

EARTH_METRES = 6_371_008.8  # mean radius; a sphere differs from the spheroid by up to about 0.5 %


def haversine(lat: Column | str, lon: Column | str, lat0: float, lon0: float) -> Column:
    phi = F.radians(col(lat))
    dphi = phi - math.radians(lat0)
    dlam = F.radians(col(lon)) - math.radians(lon0)
    a = F.sin(dphi / 2) ** 2 + F.cos(phi) * math.cos(math.radians(lat0)) * F.sin(dlam / 2) ** 2
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def latitude_band(lat: Column | str, lat0: float, metres: float) -> Column:
    """Plain range on latitude: reaches the scan as a pushed filter before any trigonometry."""
    slack = math.degrees(metres / EARTH_METRES) * 1.000001
    return col(lat).between(lat0 - slack, lat0 + slack)


def valid_point(lat: Column | str, lon: Column | str) -> Column:
    """In range and not NaN; never clamped."""
    return (
        ~F.isnan(col(lat))
        & ~F.isnan(col(lon))
        & col(lat).between(-90, 90)
        & col(lon).between(-180, 180)
    )
