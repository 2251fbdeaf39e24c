"""Dataset names, slugs and versioned file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_NAME = "coastline"


def _filled(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed != "", trimmed)


def base_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "([^/]+)/*$", 1), F.lit(""))


def dataset_name(name: Column, url: Column, path: Column) -> Column:
    """Metadata name, else last part of the URL path, else its host, else the file name."""
    address = _filled(url)
    authority = F.regexp_replace(F.try_parse_url(address, F.lit("AUTHORITY")), "^.*@", "")
    from_url = F.coalesce(base_name(F.try_parse_url(address, F.lit("PATH"))), F.nullif(authority, F.lit("")), address)
    return F.coalesce(_filled(name), from_url, base_name(_filled(path)), F.lit(DEFAULT_NAME))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits; other runs become one dash.

    Letters and digits outside ASCII vanish without leaving a dash.
    """
    dashed = F.regexp_replace(F.trim(F.lower(text)), "[^\\p{L}\\p{Nd}]+", "-")
    ascii_only = F.regexp_replace(dashed, "[^a-z0-9-]", "")
    return F.btrim(F.regexp_replace(ascii_only, "-+", "-"), F.lit("-"))


def snapshot_name(dataset: Column, is_point_array: Column, at: Column) -> Column:
    """``slug-YYYYMMDD-HHMMSS.ext``."""
    stem = F.coalesce(F.nullif(slug(dataset), F.lit("")), F.lit(DEFAULT_NAME))
    ext = F.when(is_point_array, ".json").otherwise(".geojson")
    return F.concat(stem, F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), ext)
