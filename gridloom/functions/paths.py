"""Suffixes, stems and payload classes of URLs and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes by payload class, and the suffix of a URL that has none.
RASTER_SUFFIXES = (".tif", ".tiff")
GRIDDED_SUFFIXES = (".nc", ".nc4", ".netcdf")
DEFAULT_SUFFIX = ".bin"


def url_path(url: Column) -> Column:
    """Path of a URL: no scheme, host, parameters, query or fragment."""
    local = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.regexp_replace(F.regexp_extract(local, r"^[^?#]*", 0), r";[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Last dot and what follows, as in ``.nc``; empty for dot files and names without one."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its suffix."""
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def url_suffix(url: Column, default: str = DEFAULT_SUFFIX) -> Column:
    found = suffix(url_path(url))
    return F.when(found == "", F.lit(default)).otherwise(found)


def payload_class(suffix_: Column) -> Column:
    """``raster``, ``gridded`` or ``other``, ignoring case."""
    lowered = F.lower(suffix_)
    return (
        F.when(lowered.isin(*RASTER_SUFFIXES), "raster")
        .when(lowered.isin(*GRIDDED_SUFFIXES), "gridded")
        .otherwise("other")
    )
