"""Product ids, file names and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_product_id(col: Column, suffix: str = "C") -> Column:
    """Upper case, trimmed, without .IMG; ids M, 7 to 10 digits, L or R get suffix, a trailing C or E is replaced by it."""
    pid = F.regexp_replace(F.trim(F.upper(col)), r"\.IMG$", "")
    return F.regexp_replace(pid, r"^(M\d{7,10}[LR])[CE]?$", f"$1{suffix}")


def is_valid_product_id(col: Column) -> Column:
    return col.rlike(r"^M\d{7,10}[A-Z]{1,2}[CE]$")


def product_sort_key(col: Column) -> Column:
    """struct(clock, rest): numeric order of ids; ids without a clock come first, in order of text."""
    clock = F.regexp_extract(col, r"^M(\d{7,10})[A-Z]{1,2}[CE]$", 1)
    known = is_valid_product_id(col)
    return F.struct(
        F.when(known, clock.try_cast("bigint")).otherwise(F.lit(-1)).alias("clock"),
        F.when(known, F.regexp_extract(col, r"([A-Z]{1,2}[CE])$", 1)).otherwise(col).alias("rest"),
    )


def swap_archive_suffix(col: Column) -> Column:
    """A trailing C becomes E."""
    return F.regexp_replace(col, "C$", "E")


def camera_side(col: Column, strict: bool = False) -> Column:
    """L or R, the letter after the clock; null for other ids, or an error if strict."""
    side = F.nullif(F.regexp_extract(F.upper(col), r"^M\d+([LR])[CE]?$", 1), F.lit(""))
    return F.coalesce(side, F.raise_error(F.concat(F.lit("no camera side in "), col))) if strict else side


def archive_url(base: str, file_spec: Column, archive_root: str | None = None) -> Column:
    """base/file_spec without a leading archive directory; with archive_root, base is cut there and file_spec is kept whole."""
    spec = F.trim(file_spec)
    if archive_root is None:
        return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(spec, r"^[^/]*LRO-L-LROC[^/]*/", ""))
    return F.concat(F.lit(base.rsplit(archive_root, 1)[0] + "/"), spec)


def family_id(name: Column, families: int = 8) -> Column:
    """md5 as a number modulo families; families divides 16, so the last hex digit decides."""
    return (F.conv(F.right(F.md5(name), F.lit(1)), 16, 10).cast("int") % families).cast("int")


# Parts of names that tell a site's kind, in order.
HOST_WORDS = {
    "Mare Skylight": ["Marius_Hills", "Tranquillitatis", "Ingenii", "Moscoviense"],
    "Impact Melt Pit": ["Copernicus", "Aristarchus", "Aristillus", "Crookes"],
    "Highland Feature": ["Highland"],
}


def classify_host(name: Column) -> Column:
    kind = F.lit("Pit Candidate")
    for label, words in reversed(HOST_WORDS.items()):
        kind = F.when(F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)), True), label).otherwise(kind)
    return kind


def dem_tile_name(lat: Column, lon: Column) -> Column:
    """Name of the 30 by 45 degree elevation tile; null outside latitudes of 60, for NaN and null."""
    band = (
        F.when((lat >= -60) & (lat < -30), "60S_30S").when((lat >= -30) & (lat < 0), "30S_00S")
        .when((lat >= 0) & (lat < 30), "00N_30N").when((lat >= 30) & (lat <= 60), "30N_60N")
    )
    start = F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 45), F.lit(7)) * 45
    part = lambda x: F.lpad(x.cast("string"), 3, "0")
    return F.when(~F.isnan(lat) & ~F.isnan(lon), F.concat(F.lit("SLDEM2015_512_"), band, F.lit("_"), part(start), F.lit("_"), part(start + 45)))


def doy_to_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (doy.cast("int") - 1))


def file_window(name: Column) -> tuple[Column, Column]:
    """(first, last) day of the window YYYYDDD_YYYYDDD in a file name; null without one."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"(\d{4})(\d{3})_(\d{4})(\d{3})", k), F.lit(""))
    return doy_to_date(part(1), part(2)), doy_to_date(part(3), part(4))


def window_covers(name: Column, ts: Column) -> Column:
    """Whether ts lies in the file's window, from midnight of its first day to midnight of its last; true without a window."""
    first, last = file_window(name)
    return F.coalesce((ts >= first.cast("timestamp")) & (ts <= last.cast("timestamp")), F.lit(True))


def clean_float(col: Column, default: float | None = None) -> Column:
    """Rounded to 6 places; null, NaN and infinities become default."""
    fine = col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))
    return F.when(fine, F.round(col, 6)).otherwise(F.lit(default).cast("double"))


def pit_gate(strain: Column, aspect: Column, d_pit: Column, contrast: Column, max_strain: float = 10.0, max_aspect: float = 2.2, max_distance: int = 120, min_contrast: int = 10) -> Column:
    """Name of the first gate that a candidate fails, or "valid". Null passes a gate."""
    return (
        F.when(strain > max_strain, "strain").when(aspect > max_aspect, "aspect")
        .when(d_pit > max_distance, "distance").when(contrast < min_contrast, "contrast").otherwise("valid")
    )
