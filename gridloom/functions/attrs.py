"""Default attributes of datasets, variables and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Convention, fill value, attribute defaults, the keys a dataset must carry, and the attributes of the
# grid mapping and the axes.
CONVENTIONS = "CF-1.8"
FILL_VALUE = -9999.0
GLOBAL_DEFAULTS = {
    "title": "gridded dataset",
    "institution": "unspecified",
    "source": "unspecified",
    "gee_asset_id": "",
    "references": "unspecified",
    "comment": "Values on the common Albers grid; every source band is kept.",
    "featureType": "grid",
}
VARIABLE_DEFAULTS = {"units": "1", "_FillValue": "-9999.0", "grid_mapping": "crs", "coordinates": "lat lon"}
BAND_DEFAULTS = {"units": "1", "standard_name": "unknown"}
REQUIRED_ATTRS = ("Conventions", "title", "history", "institution", "source", "references", "comment")
CRS_ATTRS = {
    "grid_mapping_name": "albers_conical_equal_area",
    "semi_major_axis": "6378137.0",
    "inverse_flattening": "298.257222101",
    "false_easting": "0.0",
    "false_northing": "0.0",
    "spatial_ref": "EPSG:5070",
}
AXIS_ATTRS = {
    "y": {"standard_name": "projection_y_coordinate", "units": "m", "axis": "Y"},
    "x": {"standard_name": "projection_x_coordinate", "units": "m", "axis": "X"},
    "lat": {"standard_name": "latitude", "units": "degrees_north"},
    "lon": {"standard_name": "longitude", "units": "degrees_east"},
    "time": {
        "standard_name": "time",
        "long_name": "time",
        "units": "days since 1970-01-01 00:00:00",
        "calendar": "proleptic_gregorian",
        "axis": "T",
    },
}


def literal_map(entries: dict[str, str]) -> Column:
    """Map literal; keys stay in the given order."""
    pairs = [F.lit(item) for pair in entries.items() for item in pair]
    return F.create_map(*pairs)


def override(defaults: Column, given: Column) -> Column:
    """Entries of ``given``, completed by ``defaults``; needs no map de-duplication setting."""
    unset = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(given, key))
    return F.map_concat(unset, given)


def global_attrs(given: Column, written_at: Column, defaults: dict[str, str] | None = None) -> Column:
    """The nine dataset attributes; the caller may set all but convention and history."""
    settable = {**GLOBAL_DEFAULTS, **(defaults or {})}
    kept = F.map_filter(given, lambda key, _: key.isin(*settable))
    notebook = F.coalesce(F.try_element_at(given, F.lit("notebook_id")), F.lit("unknown"))
    history = F.concat(written_at, F.lit(" notebook="), notebook, F.lit(" revision=unknown"))
    fixed = F.create_map(F.lit("Conventions"), F.lit(CONVENTIONS), F.lit("history"), history)
    return F.map_concat(override(literal_map(settable), kept), fixed)


def variable_attrs(name: Column, given: Column) -> Column:
    """Variable defaults under the caller's own attributes."""
    defaults = F.map_concat(F.create_map(F.lit("long_name"), name), literal_map(VARIABLE_DEFAULTS))
    return override(defaults, given)


def band_metadata(catalog: DataFrame) -> DataFrame:
    """One row per band in catalog order, with the default names and units."""
    return catalog.select("dataset_id", F.posexplode("bands").alias("position", "band")).select(
        "dataset_id",
        "position",
        "band",
        F.col("band").alias("long_name"),
        *[F.lit(value).alias(key) for key, value in BAND_DEFAULTS.items()],
    )


def coordinate_attrs(datasets: DataFrame) -> DataFrame:
    """Attribute rows ``(dataset_id, var, attrs)`` of the axes and the grid mapping, for each dataset."""
    named = {**AXIS_ATTRS, "crs": CRS_ATTRS}
    rows = [F.struct(F.lit(name).alias("var"), literal_map(entries).alias("attrs")) for name, entries in named.items()]
    return datasets.select("dataset_id", F.inline(F.array(*rows)))
