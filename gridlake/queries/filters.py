"""Queries of the JSON filter expressions, over polygons and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.filters import INTERVALS, Filters
from ..sources.derived import view
from .registry import query, real

POLYGON = {n: n for n in ("building", "aeroway", "landuse", "admin_level", "id", "xmin", "ymin", "xmax", "ymax")} | {"use": "landuse"}
POINT = {n: n for n in ("id", "place", "user_id", "ts", "value", "lng", "lat")}
DWITHIN = "greatest(xmin - 1000000, 0, 1000000 - xmax) * greatest(xmin - 1000000, 0, 1000000 - xmax) + greatest(ymin + 500000, 0, -500000 - ymax) * greatest(ymin + 500000, 0, -500000 - ymax) <= 4000000000000"
_BOX = "xmin <= 3000000 and xmax >= -2000000 and ymin <= 2500000 and ymax >= -1500000"
_IN = "xmin >= -2000000 and xmax <= 3000000 and ymin >= -1500000 and ymax <= 2500000"
_MEET = "xmin < 3000000 and xmax > -2000000 and ymin < 2500000 and ymax > -1500000"
_HOLDS = "xmin <= -20000000 and xmax >= -19999990 and ymin <= -20000000 and ymax >= -19999990"
_EDGE = f"xmin {{0}} -19900000 and xmax {{1}} {real(-19988205.4)} and ymin {{0}} -19900000 and ymax {{1}} -20000000"
B = [-2e6, -1.5e6, 3e6, 2.5e6]

#: name -> (table, expression, the same condition in SQL)
EXPRESSIONS: dict[str, tuple[str, list, str]] = {
    "jfe_all_any": ("polygons", ["all", ["==", ["get", "building"], "yes"], ["any", ["has", "aeroway"], ["==", ["get", "landuse"], "forest"]]], "building = 'yes' and (aeroway is not null or landuse = 'forest')"),
    "jfe_none": ("polygons", ["none", ["has", "aeroway"], ["has", "landuse"]], "not (aeroway is not null or landuse is not null)"),
    "jfe_not": ("polygons", ["!", ["==", ["get", "building"], "yes"]], "not (building = 'yes')"),
    "jfe_cmp_eq": ("polygons", ["==", ["get", "landuse"], "water"], "landuse = 'water'"),
    "jfe_cmp_ne": ("polygons", ["!=", ["get", "landuse"], "water"], "landuse <> 'water'"),
    "jfe_cmp_lt": ("polygons", ["<", ["get", "admin_level"], 3], "admin_level < 3"),
    "jfe_cmp_le": ("polygons", ["<=", ["get", "admin_level"], 3], "admin_level <= 3"),
    "jfe_cmp_gt": ("polygons", [">", ["get", "admin_level"], 6], "admin_level > 6"),
    "jfe_cmp_ge": ("polygons", [">=", ["get", "admin_level"], 6], "admin_level >= 6"),
    "jfe_legacy_attr": ("polygons", ["<=", "admin_level", 3], "admin_level <= 3"),
    "jfe_alias": ("polygons", ["==", "use", "forest"], "landuse = 'forest'"),
    "jfe_geomtype": ("polygons", ["all", ["==", ["geometry-type"], "Polygon"], ["!=", "$type", "Point"]], "geom_type = 'ST_Polygon' and geom_type <> 'ST_Point'"),
    "jfe_in": ("polygons", ["in", ["get", "landuse"], "forest", "cemetery"], "landuse in ('forest', 'cemetery')"),
    "jfe_not_in": ("polygons", ["!in", "landuse", "forest", "cemetery"], "landuse not in ('forest', 'cemetery')"),
    "jfe_literal_list": ("polygons", ["in", ["get", "admin_level"], ["literal", [1, 4, 7]]], "admin_level in (1, 4, 7)"),
    "jfe_has": ("polygons", ["has", "aeroway"], "aeroway is not null"),
    "jfe_not_has": ("polygons", ["!has", "aeroway"], "aeroway is null"),
    "jfe_like": ("polygons", ["like", ["get", "landuse"], "*ate.", {"wildCard": "*"}], r"landuse like '%ate_' escape '\'"),
    "jfe_typed": ("polygons", ["==", ["to-string", ["get", "landuse"]], ["string", "water"]], "landuse = 'water'"),
    "jfe_arith": ("polygons", [">", ["-", ["*", ["get", "admin_level"], 3], 4], ["+", ["get", "admin_level"], 5]], "admin_level * 3 - 4 > admin_level + 5"),
    "jfe_functions": ("polygons", ["all", [">=", ["abs", ["floor", ["/", ["get", "xmin"], 1000000]]], 3], ["<", ["min", ["get", "admin_level"], 5], 5], ["==", ["%", ["get", "admin_level"], 2], 0]], "abs(floor(xmin / 1000000)) >= 3 and least(admin_level, 5) < 5 and admin_level % 2 = 0"),
    "jfe_between": ("polygons", ["between", ["get", "admin_level"], 2, 5], "admin_level between 2 and 5"),
    "jfe_bbox": ("polygons", ["bbox", *B], _BOX),
    "jfe_spatial_intersects": ("polygons", ["intersects", B], _BOX),
    "jfe_spatial_disjoint": ("polygons", ["disjoint", B], f"not ({_BOX})"),
    "jfe_spatial_within": ("polygons", ["within", B], _IN),
    "jfe_spatial_contains": ("polygons", ["contains", [-2e7, -2e7, -19999990.0, -19999990.0]], _HOLDS),
    "jfe_spatial_overlaps": ("polygons", ["overlaps", B], f"{_MEET} and not ({_IN}) and not (xmin <= -2000000 and xmax >= 3000000 and ymin <= -1500000 and ymax >= 2500000)"),
    "jfe_spatial_touches": ("polygons", ["touches", [-19988205.4, -2e7, -1.99e7, -1.99e7]], f"{_EDGE.format('<=', '>=')} and not ({_EDGE.format('<', '>')})"),
    "jfe_dwithin": ("polygons", ["dwithin", 1e6, -5e5, 2e6], DWITHIN),
    "jfe_beyond": ("polygons", ["beyond", 1e6, -5e5, 2e6], f"not ({DWITHIN})"),
    "jfe_temporal_before": ("points", ["before", "ts", "2024-02-01 00:00:00"], "ts < timestamp '2024-02-01 00:00:00'"),
    "jfe_temporal_after": ("points", ["after", "ts", "2024-01-15 12:00:00"], "ts > timestamp '2024-01-15 12:00:00'"),
    "jfe_temporal_during": ("points", ["during", "ts", "2024-01-10 00:00:00", "2024-02-10 00:00:00"], "ts > timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-02-10 00:00:00'"),
}


def _register(name: str, table: str, expression: list, condition: str) -> None:
    fields = POLYGON if table == "polygons" else POINT

    @query(f"select id from fx_{table} where {condition}", name=name)
    def run(spark, sf_dir):
        return view(spark, sf_dir, f"fx_{table}").where(Filters(fields).compile(expression)).select("id")


for _name, _parts in EXPRESSIONS.items():
    _register(_name, *_parts)

_RELATIONS = {
    "after": "a > d", "before": "b < c", "begins": "a = c and b < d", "begun-by": "a = c and b > d", "contains": "a < c and b > d", "during": "a > c and b < d",
    "ended-by": "a < c and b = d", "ends": "a > c and b = d", "equals": "a = c and b = d", "meets": "b = c", "met-by": "a = d", "overlaps": "a < c and b > c and b < d",
    "overlapped-by": "a > c and a < d and b > d", "before-or-during": "b < d", "during-or-after": "a > c", "disjoint": "b < c or a > d",
}
_SPANS = "select o_orderkey as id, o_orderkey % 7 as a, o_orderkey % 7 + 1 + o_orderkey % 4 as b, o_orderkey % 5 + 1 as c, o_orderkey % 5 + 2 + o_orderkey % 3 as d from orders"


@query(f"select id, r, hit from (select id, {', '.join(f'({s}) as \"{n}\"' for n, s in _RELATIONS.items())} from ({_SPANS})) unpivot (hit for r in ({', '.join(f'\"{n}\"' for n in _RELATIONS)}))")
def jfe_temporal_relations(spark, sf_dir):
    k = F.col("o_orderkey")
    spans = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), (k % 7).alias("a"), (k % 7 + 1 + k % 4).alias("b"), (k % 5 + 1).alias("c"), (k % 5 + 2 + k % 3).alias("d"))
    hits = F.array(*(F.struct(F.lit(n).alias("r"), f(*(F.col(x) for x in "abcd")).alias("hit")) for n, f in INTERVALS.items()))
    return spans.select("id", F.inline(hits))


@query("""with t as (select o_orderkey as id, [cast(o_orderkey % 3 as int), cast(o_orderkey % 5 as int)] as a from orders)
select id, list_sort(a) = [1, 2] as equals, list_has_all(a, [1, 2]) as contains, list_has_all([1, 2], a) as contained_by, list_has_any(a, [1, 2]) as overlaps from t""")
def jfe_array_ops(spark, sf_dir):
    k = F.col("o_orderkey")
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), F.array((k % 3).cast("int"), (k % 5).cast("int")).alias("a"))
    compiled = Filters({"a": "a"})
    return t.select("id", *(compiled.compile([f"array-{n}", "a", [1, 2]]).alias(n.replace("-", "_")) for n in ("equals", "contains", "contained-by", "overlaps")))
