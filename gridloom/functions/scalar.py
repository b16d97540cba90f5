"""Column expressions of map algebra; all of them stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Codes of flood zones.
ZONES = {0: "unmapped", 1: "sfha", 2: "floodway", 3: "shaded_x", 4: "unshaded_x", 5: "D", 6: "other"}
UNMAPPED, SFHA, FLOODWAY, SHADED_X, UNSHADED_X, ZONE_D, OTHER = range(7)
SFHA_ZONES = ("A", "AE", "AH", "AO", "AR", "A99", "V", "VE")
UNMAPPED_ZONES = ("", "OPEN WATER", "AREA NOT INCLUDED")
TRUE_WORDS = ("T", "TRUE", "1", "YES")
#: Zones are painted in this order; a later one covers an earlier one.
PAINT_ORDER = (OTHER, ZONE_D, UNSHADED_X, SHADED_X, SFHA, FLOODWAY)
BURN_M, SLOPE_FLOOR, FILL_STEP, CELL_M, NEAR_M = 50.0, 0.001, 1e-3, 30.0, 300.0


def clean(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def truthy(c: Column) -> Column:
    return clean(c).isin(*TRUE_WORDS)


def classify_zone(zone: Column, subtype: Column, sfha: Column) -> Column:
    zone, sub = clean(zone), clean(subtype)
    hazard = truthy(sfha) | zone.isin(*SFHA_ZONES)
    shaded = sub.contains("0.2") | sub.contains("SHADED")
    return (
        F.when(sub.contains("FLOODWAY") & hazard, FLOODWAY)
        .when(hazard, SFHA)
        .when(zone == "D", ZONE_D)
        .when((zone == "X") | sub.contains("MINIMAL FLOOD") | sub.contains("0.2"), F.when(shaded, SHADED_X).otherwise(UNSHADED_X))
        .when(zone.isin(*UNMAPPED_ZONES) | zone.contains("NOT INCLUDED"), UNMAPPED)
        .otherwise(OTHER)
    )


def zone_name(code: Column, unknown: str = "off_grid") -> Column:
    """The name of a code; cells without one are told apart from real code 6."""
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return F.coalesce(F.element_at(names, code.cast("int")), F.lit(unknown))


def zone_code(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (v, k)])
    return F.element_at(codes, name)


def sfha_band(zone: Column) -> Column:
    return F.when(zone.isin(SFHA, FLOODWAY), 1).when(zone.isNotNull(), 0)


def d1_eligible(zone: Column, p_max: Column) -> Column:
    return F.coalesce((zone == UNSHADED_X) & p_max.isNotNull(), F.lit(False))


def defined(band: Column, nodata: float = -9999.0) -> Column:
    return F.coalesce(band.isNotNull() & ~F.isnan(band) & (band != nodata) & (F.abs(band) < float("inf")), F.lit(False))


def eligible(hand: Column, sfha: Column) -> Column:
    return defined(hand) & F.coalesce(sfha.isin(0, 1), F.lit(False))


def near_stream_unshaded(zone: Column, dist_flowline: Column, dist_waterbody: Column, near: float = NEAR_M) -> Column:
    close = lambda d: F.coalesce((d >= 0) & (d < near), F.lit(False))
    return F.coalesce(zone == UNSHADED_X, F.lit(False)) & (close(dist_flowline) | close(dist_waterbody))


def parse_float(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    return F.when(F.upper(t).isin("", "NA", "NONE", "NULL"), None).otherwise(t).try_cast("double")


def burn(z: Column, stream: Column, depth: float = BURN_M) -> Column:
    return F.when(F.coalesce(stream, F.lit(False)), z - depth).otherwise(z)


def specific_catchment(acc: Column, cell: float = CELL_M) -> Column:
    return (acc + 1) * F.lit(cell)


def wetness(sca: Column, slope: Column, floor: float = SLOPE_FLOOR) -> Column:
    return F.ln(sca / F.tan(F.greatest(slope, F.lit(floor))))


def paint(band: Column, nodata: float) -> Column:
    """What a sink writes: float32 with nodata for missing and non-finite values."""
    return F.when(defined(band, nodata), band).otherwise(F.lit(nodata)).cast("float")


def short_name(name: Column, aliases: dict[str, str], most: int = 22) -> Column:
    out = None
    for needle, alias in aliases.items():
        hit = F.upper(name).contains(needle.upper())
        out = F.when(hit, alias) if out is None else out.when(hit, alias)
    rest = F.substring(F.trim(F.substring_index(name, "-", 1)), 1, most)
    return rest if out is None else out.otherwise(rest)


def pmax_note(row: Column, col: Column, max_row: Column, max_col: Column, zone: Column, dist_flowline: Column, dist_waterbody: Column) -> Column:
    """Where the highest cell of a window lies."""
    wet = F.coalesce(dist_waterbody == 0, F.lit(False)) | F.coalesce(dist_flowline == 0, F.lit(False)) | F.coalesce(zone.isin(SFHA, FLOODWAY), F.lit(False))
    return F.when(max_row.isNull(), "unscored").when((max_row == row) & (max_col == col), "office_pixel").when(wet, "adjacent_hydro_cell").otherwise("neighboring_land_cell")


def _albers() -> dict[str, float]:
    # GRS80 and the conterminous US Albers parameters.
    a, inv_f, lat1, lat2, lat0, lon0 = 6378137.0, 298.257222101, 29.5, 45.5, 23.0, -96.0
    f = 1 / inv_f
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    q = lambda p: (1 - e2) * (math.sin(p) / (1 - e2 * math.sin(p) ** 2) - math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))) / (2 * e))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return {"a": a, "e": e, "e2": e2, "n": n, "c": c, "rho0": a * math.sqrt(c - n * q(p0)) / n, "lon0": math.radians(lon0)}


ALBERS = _albers()


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees (EPSG:4269) to metres (EPSG:5070)."""
    k = ALBERS
    s = F.sin(F.radians(lat))
    q = (1 - k["e2"]) * (s / (1 - k["e2"] * s * s) - F.ln((1 - k["e"] * s) / (1 + k["e"] * s)) / (2 * k["e"]))
    rho = k["a"] * F.sqrt(k["c"] - k["n"] * q) / k["n"]
    theta = k["n"] * (F.radians(lon) - k["lon0"])
    return rho * F.sin(theta), k["rho0"] - rho * F.cos(theta)


def cell_of(x: Column, y: Column, transform) -> tuple[Column, Column]:
    """Row and column of a point."""
    a, _, c, _, e, f = transform
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")
