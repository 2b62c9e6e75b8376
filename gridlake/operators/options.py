"""Options of raster jobs as tables: defaults, checks of request texts, mapping to jobs, sorted texts, ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import RESAMPLING

#: Defaults where an option is null, empty, zero or false ...
DEFAULTS: dict[str, object] = {"resampling": "average", "tiledriver": "PNG", "tile_size": 256, "minzoom": 0, "maxzoom": 0, "warnings": False, "warp": False, "resampling_warp": "average", "remove_processing_raster_files": False, "mosaic_merge": False, "nodata_default": -999999.0, "pixel_selection_method": "FirstMethod"}
#: ... and where it is null only, so that false stays.
IF_NULL: dict[str, object] = {"xyz": True, "mbtiles": True, "save_tile_detail_db": True, "encode_to_rgba": True, "merge": True}
TILE_SIZES = (128, 256, 512, 1024)


def filled(value: Column, default: object) -> Column:
    """The default where a value is null, empty, zero or false."""
    return F.when(value.isNotNull() & (value.cast("string") != "") & ~value.cast("string").isin("0", "0.0", "false"), value).otherwise(F.lit(default))


def with_defaults(rows: DataFrame, processors: int, defaults: Mapping[str, object] = DEFAULTS, if_null: Mapping[str, object] = IF_NULL) -> DataFrame:
    """rows with every option set; columns that rows lack count as null."""
    own = lambda n: F.col(n) if n in rows.columns else F.lit(None)
    set_ = {n: filled(own(n), d) for n, d in ({"count_processes": processors} | dict(defaults)).items()}
    return rows.withColumns({**set_, **{n: F.coalesce(own(n), F.lit(d)) for n, d in if_null.items()}})


def legacy_errors(rows: DataFrame, text: str, processors: int) -> DataFrame:
    """rows with error: one row for each mistake of a request given as JSON text.

    Types are looked at as the text has them: a number in quotes is no number.  A text that is no JSON object breaks
    "json"; an absent option breaks nothing, a null one is of the wrong type."""
    v = F.try_parse_json(text)
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    there = lambda n: F.array_contains(F.json_object_keys(F.col(text)), n)
    string, whole = (lambda n: F.try_variant_get(v, f"$.{n}", "string")), (lambda n: F.try_variant_get(v, f"$.{n}", "bigint"))
    is_whole = lambda n: kind(n) == "BIGINT"
    wrong = {
        "verbose": kind("verbose") != "BOOLEAN",
        "resampling": (kind("resampling") != "STRING") | ~string("resampling").isin(*RESAMPLING),
        "tiledriver": (kind("tiledriver") != "STRING") | (F.lower(string("tiledriver")) != "png"),
        "tile_size": ~is_whole("tile_size") | ~whole("tile_size").isin(*TILE_SIZES),
        "count_processes": ~is_whole("count_processes") | ~whole("count_processes").between(0, 2 * processors),
        "zoom": ~kind("zoom").startswith("ARRAY") | (F.size(F.try_variant_get(v, "$.zoom", "array<variant>")) != 2),
    }
    object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    broken = F.array(F.when(~object_, F.lit("json")), *(F.when(object_ & F.coalesce(there(n), F.lit(False)) & F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in wrong.items()))
    return rows.withColumn("error", F.explode(F.filter(broken, lambda e: e.isNotNull())))


def sorted_text(rows: DataFrame, names: list[str]) -> Column:
    """Options as JSON with keys in order, nulls written out: equal options give equal texts."""
    return F.to_json(F.struct(*(F.col(n) for n in sorted(names))), {"ignoreNullFields": "false"})


def stable_id(*parts: Column) -> Column:
    """32 hexadecimal digits that depend on the parts alone; null parts count as such."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256), 1, 32)


def job_options(pyramids: DataFrame, root: str) -> DataFrame:
    """Jobs of pyramid requests (with all options set): the kind of job, its zooms, where its tiles go."""
    folder = F.concat_ws("/", F.lit(root), F.lit("tiles"), "datasource_id")
    merged = F.when(F.col("mosaics"), F.col("merge")).otherwise(F.col("mosaic_merge"))
    return pyramids.select(
        "datasource_id", F.when(F.col("mosaics"), "mosaic").otherwise("tiles").alias("kind"), F.array(F.least("minzoom", "maxzoom"), F.greatest("minzoom", "maxzoom")).alias("zoom"),
        F.lower("resampling").alias("resampling"), "tile_size", "count_processes", merged.alias("merged"), F.when(F.col("mosaics"), F.col("pixel_selection_method")).alias("pixel_selection"),
        F.when(F.col("mbtiles"), F.concat_ws("/", folder, F.concat(F.col("datasource_id").cast("string"), F.lit(".mbtiles")))).otherwise(folder).alias("store"),
    )
