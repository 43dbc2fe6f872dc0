"""Column expressions of coastal quantities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_A_YEAR = 365.2425
# 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T975 = [12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.3060, 2.2622, 2.2281, 2.2010, 2.1788, 2.1604, 2.1448, 2.1314, 2.1199, 2.1098, 2.1009, 2.0930, 2.0860, 2.0796, 2.0739, 2.0687, 2.0639, 2.0595, 2.0555, 2.0518, 2.0484, 2.0452, 2.0423]
# Shift in metres of each satellite's images to the reference.
COREGISTRATION = {"L5": (-4.5, 42.3), "L7": (13.7, 37.4), "L8": (13.7, 37.4), "L9": (13.7, 37.4), "S2": (-7.5, 15.5)}


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero; a negative value that becomes 0, and a negative 0, keep their sign, as in SQL (F.round drops it)."""
    return F.when(x < 0, -F.round(-x, digits)).when(x == 0, x).otherwise(F.round(x, digits))


def t975(df: Column) -> Column:
    """Student's t quantile for a 95 % interval; an expansion in 1/df beyond the table. Null under one degree."""
    table = F.array(*[F.lit(v) for v in T975])
    z = 1.959964
    far = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= len(T975), F.get(table, (df - 1).cast("int"))).otherwise(far)


def t975_sql(df: str) -> str:
    z = 1.959964
    return f"CASE WHEN {df} < 1 THEN NULL WHEN {df} <= 30 THEN ([{', '.join(map(str, T975))}])[({df})::INT]::DOUBLE ELSE {z}::DOUBLE + {z**3 + z}::DOUBLE / (4 * ({df})) + {5 * z**5 + 16 * z**3 + 3 * z}::DOUBLE / (96 * ({df}) * ({df})) END"


def tidal_correction(x: Column, tide: Column, *slopes: Column, default: float = 0.1, datum: float = 0.0) -> Column:
    """Waterline position moved to the datum by the first slope that is known."""
    return x + (tide - datum) / F.coalesce(*slopes, F.lit(default))


def tide_zone(tide: Column, low: Column, first: Column, second: Column, high: Column) -> Column:
    """Third of the tidal range; null outside it."""
    return F.when(tide.between(low, first), "lower").when(tide.between(first, second), "middle").when(tide.between(second, high), "upper")


def incidence(direction: Column, shore: Column, wrap: bool = True) -> Column:
    """Wave direction against the shore's angle, in (-180, 180] if wrapped."""
    a = direction - shore
    return F.when(a > 180, a - 360).when(a <= -180, a + 360).otherwise(a) if wrap else a


def shore_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a = 180 - F.degrees(F.atan2(y1 - y0, x1 - x0))
    return F.when(a > 360, a - 360).otherwise(a)


def diffusivity(hs: Column, tp: Column, alpha: Column, power: float = 0.2) -> Column:
    a = F.radians(alpha)
    return (0.15 / 10) * F.pow(tp, F.lit(power)) * F.pow(hs, F.lit(2.4)) * F.pow(F.abs(F.cos(a)), F.lit(0.2)) * (1.2 * F.sin(a) * F.sin(a) - F.cos(a) * F.cos(a))


def transport(hs: Column, tp: Column, alpha: Column) -> Column:
    a = F.radians(alpha)
    return 0.15 * F.pow(hs, F.lit(2.4)) * F.pow(tp, F.lit(0.2)) * F.pow(F.abs(F.cos(a)), F.lit(1.2)) * F.sin(a)


def iribarren(slope: Column, hs: Column, tp: Column, standard: bool = False) -> Column:
    length = 9.81 * tp * tp / (2 * 3.141592653589793)
    return slope / F.sqrt(hs / length) if standard else slope / (hs / length)


def runup_senechal(hs: Column) -> Column:
    return 2.14 * F.tanh(0.4 * hs)


def runup_stockdon(slope: Column, hs: Column, tp: Column, number: Column) -> Column:
    """By Iribarren number: under 0.3 the dissipative form."""
    length = 9.81 * tp * tp / (2 * 3.141592653589793)
    return F.when(number < 0.3, 0.043 * F.sqrt(hs * length)).otherwise(1.1 * (0.35 * slope * F.sqrt(hs * length) + F.sqrt(hs * length * (0.563 * slope * slope + 0.004)) / 2))


def circular_mean(direction: Column) -> Column:
    """Aggregate: mean direction in degrees, [0, 360)."""
    r = F.radians(direction)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def circular_std(direction: Column) -> Column:
    """Aggregate: circular standard deviation in radians."""
    r = F.radians(direction)
    s, c = F.avg(F.sin(r)), F.avg(F.cos(r))
    return F.sqrt(-2 * F.log(F.least(F.lit(1.0), F.sqrt(s * s + c * c))))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def survey_error(year: Column) -> Column:
    return F.when(year < 1970, 5.0).when(year < 2000, 2.0).otherwise(1.0)


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def to_world(col: Column, row: Column, g: dict[str, Column]) -> tuple[Column, Column]:
    """Pixel to world by a geotransform x0, dx, rx, y0, ry, dy."""
    return g["x0"] + col * g["dx"] + row * g["rx"], g["y0"] + col * g["ry"] + row * g["dy"]


def to_pixel(x: Column, y: Column, g: dict[str, Column]) -> tuple[Column, Column]:
    det = g["dx"] * g["dy"] - g["rx"] * g["ry"]
    return ((x - g["x0"]) * g["dy"] - (y - g["y0"]) * g["rx"]) / det, ((y - g["y0"]) * g["dx"] - (x - g["x0"]) * g["ry"]) / det


def to_utm(lat: Column, lon: Column, central: Column, north: bool = True) -> tuple[Column, Column]:
    """WGS84 to UTM easting and northing by the transverse Mercator series of third order in the flattening."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + reduce(lambda s, k: s + alpha[k] * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta), range(3), F.lit(0.0))
    up = xi + reduce(lambda s, k: s + alpha[k] * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta), range(3), F.lit(0.0))
    return 500000 + 0.9996 * rect * east, (0 if north else 10_000_000) + 0.9996 * rect * up


def clean_list(values: Column) -> Column:
    """Numbers of a list of strings; marks of missing values become null."""
    return F.transform(values, lambda x: F.when(~x.isin("masked", "--", "nan", ""), x.try_cast("double")))
