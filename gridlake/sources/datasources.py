"""Datasource documents: reading a folder of JSON files, checking them, and the catalog as a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import MAXZOOM, MINZOOM, Field, Layer, SqlQuery
from ..plans.filters import Filters

CATALOG = (
    "id string, identifier string, data_type string, host string, port int, store_type string, mbtiles boolean, name string, description string, attribution string, "
    "minzoom int, maxzoom int, bounds struct<lng_w:double,lat_s:double,lng_e:double,lat_n:double>, center array<double>, data string"
)
_SETTINGS = "struct<type:string,store:string,host:string,port:int,dataset:string,file:string,folder:string,tiles:array<string>>"
DOCUMENT = (
    f"id string, type string, name string, description string, attribution string, mbtiles boolean, mosaics boolean, minzoom int, maxzoom int, center array<double>, dataStore {_SETTINGS}, "
    "bounds struct<lng_w:double,lat_s:double,lng_e:double,lat_n:double>, pyramidSettings struct<minzoom:int,maxzoom:int,resampling:string,tileSize:int>"
)
RESAMPLING = ("nearest", "average", "bilinear", "cubic", "cubicspline", "lanczos", "min", "max", "med")
STORES = ("internal", "tiles")

#: Name and SQL condition of each check that a parsed document can break.
DOCUMENT_CHECKS = {
    "id": "id is null or id = ''",
    "type": "type is null or type not in ('vector', 'raster')",
    "store": f"dataStore.store is null or dataStore.store not in {STORES}",
    "bounds": "bounds is not null and not (bounds.lng_w between -180 and 180 and bounds.lng_e between -180 and 180 and bounds.lat_s between -90 and 90 and bounds.lat_n between -90 and 90 and bounds.lng_w < bounds.lng_e and bounds.lat_s < bounds.lat_n)",
    "center": "center is not null and not (size(center) between 2 and 3 and get(center, 0) between -180 and 180 and get(center, 1) between -90 and 90 and coalesce(get(center, 2), 0) between 0 and 20)",
    "center in bounds": "center is not null and bounds is not null and not (get(center, 0) between bounds.lng_w and bounds.lng_e and get(center, 1) between bounds.lat_s and bounds.lat_n)",
    "zoom": f"coalesce(minzoom, {MINZOOM}) > coalesce(maxzoom, {MAXZOOM}) or coalesce(minzoom, 0) not between 0 and 20 or coalesce(maxzoom, 0) not between 0 and 20",
    "pyramid zoom": "pyramidSettings.minzoom > pyramidSettings.maxzoom or pyramidSettings.minzoom < coalesce(minzoom, 0) or pyramidSettings.maxzoom > coalesce(maxzoom, 20)",
    "tile size": "pyramidSettings.tileSize is not null and pyramidSettings.tileSize not in (128, 256, 512, 1024)",
    "resampling": f"pyramidSettings.resampling is not null and pyramidSettings.resampling not in {RESAMPLING}",
    "raster file": "type = 'raster' and dataStore.store = 'internal' and ((dataStore.file is null) = (dataStore.folder is null))",
    "mosaic folder": "type = 'raster' and mosaics and dataStore.folder is null",
    "tiles url": "dataStore.store = 'tiles' and coalesce(size(dataStore.tiles), 0) = 0",
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file: path, text, document (parsed; null where the text is no JSON object)."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.from_json("value", DOCUMENT).alias("document"))


def document_errors(documents: DataFrame, checks: dict[str, str] | None = None) -> DataFrame:
    """path, error: one row for each broken check; a document that cannot be read breaks "json"."""
    rows = documents.select("path", F.when(F.coalesce("document.id", "document.type").isNull() & F.col("document.dataStore").isNull(), F.lit(True)).otherwise(False).alias("__bad"), "document.*")
    broken = F.array(F.when(F.col("__bad"), F.lit("json")), *(F.when(~F.col("__bad") & F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in (checks or DOCUMENT_CHECKS).items()))
    return rows.select("path", F.explode(F.filter(broken, lambda e: e.isNotNull())).alias("error"))


def catalog_rows(documents: DataFrame) -> DataFrame:
    """Catalog rows of the documents without errors."""
    good = documents.join(document_errors(documents).select("path").distinct(), "path", "left_anti")
    d = F.col("document")
    return good.select(
        F.sha2(d["id"], 256).substr(1, 32).alias("id"), d["id"].alias("identifier"), d["type"].alias("data_type"), d["dataStore"]["host"].alias("host"), d["dataStore"]["port"].alias("port"),
        d["dataStore"]["store"].alias("store_type"), F.coalesce(d["mbtiles"], F.lit(False)).alias("mbtiles"), d["name"].alias("name"), d["description"].alias("description"), d["attribution"].alias("attribution"),
        F.coalesce(d["minzoom"], F.lit(MINZOOM)).alias("minzoom"), F.coalesce(d["maxzoom"], F.when(d["type"] == "raster", 13).otherwise(MAXZOOM)).alias("maxzoom"), d["bounds"].alias("bounds"), d["center"].alias("center"), F.col("text").alias("data"),
    )


def loaded(catalog: DataFrame, rows: DataFrame, reload_ids: Iterable[str] | None = None) -> DataFrame:
    """The catalog with rows of new identifiers; those in reload_ids replace what is there."""
    again = list(reload_ids or ())
    fresh = rows.where(F.col("identifier").isin(*again)) if again else rows.limit(0)
    new = rows.join(catalog.select("identifier"), "identifier", "left_anti").select(*rows.columns)
    kept = catalog.join(fresh.select("identifier"), "identifier", "left_anti").select(*catalog.columns)
    return kept.unionByName(fresh).unionByName(new.where(~F.col("identifier").isin(*again)) if again else new)


def deleted(catalog: DataFrame, identifier: str) -> DataFrame:
    return catalog.where(F.col("identifier") != identifier)


def find(catalog: DataFrame, identifier: str) -> DataFrame:
    return catalog.where(F.col("identifier") == identifier)


def layers_of(document: dict) -> list[Layer]:
    """Layers of a vector document; their filters are compiled once, so mistakes show here."""
    out = []
    for x in document.get("layers", ()):
        fields = tuple(Field(f["name"], f.get("name_in_db"), f.get("encode", True)) for f in x.get("fields", ()))
        queries = tuple(SqlQuery(q.get("minzoom", MINZOOM), q.get("maxzoom", MAXZOOM), q["sql"]) for q in x.get("queries", ()))
        layer = Layer(x["id"], x.get("storeLayer", ""), x.get("minzoom", MINZOOM), x.get("maxzoom", MAXZOOM), bool(x.get("simplify")), x.get("filter"), fields, queries)
        if layer.filter and fields:
            Filters({f.name: f.physical for f in fields}).compile(layer.filter)
        out.append(layer)
    return out


def missing_columns(table: DataFrame, layer: Layer) -> list[str]:
    """Declared columns that a layer's table does not have."""
    return [c for c in (*layer.geometry, *(f.physical for f in layer.fields)) if c not in table.columns]


def raster_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a mosaic folder: TIFFs, without overviews, warped copies and merged outputs; asset_ord by name."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    merged = r"_(FIRST|MAX|MIN|MEAN|SUM|COUNT)\.[^.]*$"
    keep = F.lower("name").rlike(r"\.tiff?$") & ~F.col("name").contains("_warp_tr_ov.") & ~F.col("name").rlike(merged)
    return files.where(keep).select("path", "length", "name")


def warped_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a mosaic folder that are prepared for reading: warped TIFFs in blocks with overviews."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.where(F.lower("name").rlike(r"_warp_tr_ov\.tiff?$") & ~F.col("name").rlike("_(FIRST|MAX|MIN|MEAN|SUM|COUNT)"))
