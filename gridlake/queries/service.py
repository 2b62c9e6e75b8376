"""Queries of the tile store, the job queue, the run log and request routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..sources.derived import view
from .registry import query

c = F.col
NOW = "timestamp '1996-06-01 00:00:00'"
_ARRIVED = "(select event_id as seq, cast(event_id % 6 as int) as z, cast(user_id % 40 as int) as x, cast(event_id % 30 as int) as y, event_type as data from events)"
_STORED = "(select distinct cast(o_orderkey % 6 as int) as z, cast(o_custkey % 40 as int) as x, cast(o_orderkey % 30 as int) as y from orders where o_orderkey % 5 = 0)"
_PARSED = """(select req_id, parts[4] as ds, try_cast(parts[5] as int) as z, try_cast(parts[6] as int) as x, try_cast(string_split(parts[7], '.')[1] as int) as y
from (select req_id, string_split(path, '/') as parts from fx_requests) where lower(string_split(parts[7], '.')[2]) in ('png', 'mvt', 'pbf') and try_cast(parts[5] as int) is not null)"""


def _arrived(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(c("event_id").alias("seq"), (c("event_id") % 6).cast("int").alias("z"), (c("user_id") % 40).cast("int").alias("x"), (c("event_id") % 30).cast("int").alias("y"), c("event_type").alias("data"))


def _stored(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 5 = 0")
    return o.select((c("o_orderkey") % 6).cast("int").alias("z"), (c("o_custkey") % 40).cast("int").alias("x"), (c("o_orderkey") % 30).cast("int").alias("y")).distinct()


def _parsed(spark, sf_dir):
    r = view(spark, sf_dir, "fx_requests")
    return r.select("req_id", *(v.alias(k) for k, v in store.parse_request(c("path")).items())).where("ok").drop("ok", "ext").withColumnRenamed("datasource", "ds")


@query(f"select z, x, y, seq, data from (select a.*, row_number() over (partition by z, x, y order by seq) as n from {_ARRIVED} a where not exists (select 1 from {_STORED} s where s.z = a.z and s.x = a.x and s.y = a.y)) where n = 1")
def tile_insert_or_ignore(spark, sf_dir):
    return store.new_tiles(_arrived(spark, sf_dir), _stored(spark, sf_dir), [c("seq")]).select("z", "x", "y", "seq", "data")


@query(f"select z, x, y, data from (select *, row_number() over (partition by z, x, y order by seq) as n from {_ARRIVED}) where n = 1 and z = 3 and x = 9 and y = 3")
def tile_lookup(spark, sf_dir):
    return store.lookup(store.first_of(_arrived(spark, sf_dir), store.TILE, [c("seq")]), 3, 9, 3).select("z", "x", "y", "data")


@query(f"select req_id, ds, z, x, y from {_PARSED} r where not exists (select 1 from {_STORED} s where s.z = r.z and s.x = r.x and s.y = r.y)")
def cache_antijoin(spark, sf_dir):
    return store.missing(_parsed(spark, sf_dir), _stored(spark, sf_dir)).select("req_id", "ds", "z", "x", "y")


@query(f"select req_id, ds, z, x, y from {_PARSED} r where exists (select 1 from {_STORED} s where s.z = r.z and s.x = r.x and s.y = r.y)")
def cache_hits(spark, sf_dir):
    return store.present(_parsed(spark, sf_dir), _stored(spark, sf_dir)).select("req_id", "ds", "z", "x", "y")


_SOURCES = "select datasource_id, identifier as name, data_type as description, host as attribution, case when datasource_id % 4 = 0 then 'mvt' end as format, minzoom, maxzoom, cast(datasource_id % 80 * 5 - 200 as double) as west, cast(datasource_id % 37 * 5 - 95 as double) as south, cast(datasource_id % 80 * 5 - 190 as double) as east, cast(datasource_id % 37 * 5 - 90 as double) as north from {}"
_CLAMPED = lambda c, most: f"cast(greatest(-{most}, least({most}, {c})) as varchar)"


@query(f"""with s as ({_SOURCES.format('fx_datasource')}) select datasource_id, t.name, t.value from s, lateral (values ('name', coalesce(s.name, '')), ('description', coalesce(description, '')), ('version', '1.0.0'),
('attribution', coalesce(attribution, '')), ('type', 'overlay'), ('format', coalesce(format, 'png')), ('minzoom', cast(minzoom as varchar)), ('maxzoom', cast(maxzoom as varchar)),
('bounds', concat_ws(' ', {_CLAMPED('south', 'cast(85.05112878 as double)')}, {_CLAMPED('west', 'cast(180.0 as double)')}, {_CLAMPED('north', 'cast(85.05112878 as double)')}, {_CLAMPED('east', 'cast(180.0 as double)')})), ('scale', '1.000000'), ('profile', 'mercator')) t(name, value)""")
def mbtiles_metadata(spark, sf_dir):
    view(spark, sf_dir, "fx_datasource").createOrReplaceTempView("fx_datasource_rows")
    return store.metadata_rows(spark.sql(_SOURCES.format("fx_datasource_rows")))


_BROKEN = {n: f"coalesce({c}, false)" for n, c in store.CHECKS.items()}


@query(f"""with s as (select *, case when datasource_id % 13 = 0 then 25 else maxzoom end as top, case when datasource_id % 17 = 0 then null else identifier end as ident from fx_datasource),
t as (select data_type, minzoom, top as maxzoom, host, port, ident as identifier from s)
select data_type, count(*) as rows, count_if(not ({' or '.join(_BROKEN.values())})) as good, {', '.join(f'count_if({c}) as {n.replace(" ", "_")}' for n, c in _BROKEN.items())} from t group by data_type""")
def load_counts(spark, sf_dir):
    s = view(spark, sf_dir, "fx_datasource")
    s = s.withColumns({"maxzoom": F.when(F.col("datasource_id") % 13 == 0, 25).otherwise(F.col("maxzoom")), "identifier": F.when(F.col("datasource_id") % 17 != 0, F.col("identifier"))})
    return store.load_counts(s, ("data_type",))


@query(f"select job_id, scheduled_for, failed_attempts from fx_queue where status = 0 and scheduled_for <= {NOW} and failed_attempts < 3 order by scheduled_for, job_id limit 10")
def job_pull(spark, sf_dir):
    return store.pull(view(spark, sf_dir, "fx_queue"), F.expr(NOW), 10).select("job_id", "scheduled_for", "failed_attempts")


@query(f"""with p as (select job_id from fx_queue where status = 0 and scheduled_for <= {NOW} and failed_attempts < 3 order by scheduled_for, job_id limit 5)
select job_id, case when job_id in (select job_id from p) then 1 else status end as status from fx_queue""")
def job_start(spark, sf_dir):
    q = view(spark, sf_dir, "fx_queue")
    return store.started(q, store.pull(q, F.expr(NOW), 5)).select("job_id", "status")


@query("select job_id, case when job_id % 11 = 0 then 0 else status end as status, failed_attempts + case when job_id % 11 = 0 then 1 else 0 end as failed_attempts from fx_queue where not (job_id % 7 = 0 and job_id % 11 <> 0)")
def job_fail(spark, sf_dir):
    q = view(spark, sf_dir, "fx_queue")
    results = q.where("job_id % 7 = 0 or job_id % 11 = 0").select("job_id", F.when(c("job_id") % 11 == 0, 503).otherwise(202).alias("status_code"))
    return store.finished(q, results).select("job_id", "status", "failed_attempts")


@query("select event_id, code, case when floor(code / 100.0 + 0.5) in (4, 5, 6) then 'fail' else 'done' end as outcome from (select event_id, cast(event_id % 700 as int) as code from events)")
def job_outcome(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (c("event_id") % 700).cast("int").alias("code"))
    return e.withColumn("outcome", store.outcome(c("code")))


@query("select datasource_id, id, start_time from (select *, row_number() over (partition by datasource_id order by start_time desc, id desc) as n from fx_pyramids where running = 1) where n = 1")
def latest_pyramid(spark, sf_dir):
    log = view(spark, sf_dir, "fx_pyramids").where("running = 1")
    return store.latest_run(log, ("datasource_id",), [c("start_time").desc(), c("id").desc()]).select("datasource_id", "id", "start_time")


@query("select distinct c_custkey as datasource_id from customer where c_custkey not in (select datasource_id from fx_pyramids where running = 1)")
def pyramid_mutex(spark, sf_dir):
    return store.may_start(spark.read.parquet(f"{sf_dir}/customer.parquet").select(c("c_custkey").alias("datasource_id")).distinct(), view(spark, sf_dir, "fx_pyramids"))


@query("select id, 0 as running, case when running = 1 then 1 else complete end as complete from fx_pyramids")
def pyramid_repair(spark, sf_dir):
    return store.repaired(view(spark, sf_dir, "fx_pyramids")).select("id", "running", "complete")


@query(f"select z, seq, cast((row_number() over (partition by z order by seq) - 1) % 4 as int) as worker from {_ARRIVED}")
def round_robin(spark, sf_dir):
    return store.dealt(_arrived(spark, sf_dir), 4, ("z",), ("seq",)).select("z", "seq", "worker")


@query(f"select z, seq, cast(floor((row_number() over (partition by z order by seq) - 1) / 16) as bigint) as batch from {_ARRIVED}")
def batches(spark, sf_dir):
    return store.batched(_arrived(spark, sf_dir), 16, ("z",), ("seq",)).select("z", "seq", "batch")


@query(f"select req_id, r.datasource_id, case when d.datasource_id is null then null when host is null then 'local' else concat(host, ':', cast(port as varchar)) end as target from (select req_id, cast(ds as bigint) as datasource_id from {_PARSED}) r left join fx_datasource d on d.datasource_id = r.datasource_id")
def datasource_route(spark, sf_dir):
    r = _parsed(spark, sf_dir).select("req_id", c("ds").cast("long").alias("datasource_id"))
    return store.routed(r, view(spark, sf_dir, "fx_datasource"), "datasource_id").select("req_id", "datasource_id", "target")


@query("select s_suppkey as key from supplier where s_suppkey % 3 <> 0 or date_diff('day', date '2024-01-01' - cast(s_suppkey % 4 as int), date '2024-01-01') >= 1")
def key_rotation(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(c("s_suppkey").alias("key"))
    failed = keys.where("key % 3 = 0").select("key", F.date_sub(F.lit("2024-01-01").cast("date"), (c("key") % 4).cast("int")).alias("failed_at"))
    return store.usable_keys(keys, failed, F.lit("2024-01-01").cast("date")).select("key")


@query("""select datasource_id, 'zoom order' as error from fx_datasource where minzoom + datasource_id % 3 > maxzoom union all
select datasource_id, 'data type' from fx_datasource where data_type not in ('raster')""")
def validate_errors(spark, sf_dir):
    d = view(spark, sf_dir, "fx_datasource")
    checks = {"zoom order": "minzoom + datasource_id % 3 > maxzoom", "data type": "data_type not in ('raster')"}
    return store.errors(d, checks).select("datasource_id", "error")


@query("select datasource_id, identifier, data_type from fx_datasource where identifier = 'Supplier#000000007' and data_type in ('vector', 'raster')")
def catalog_lookup(spark, sf_dir):
    from ..sources.datasources import find

    return find(view(spark, sf_dir, "fx_datasource"), "Supplier#000000007").where(c("data_type").isin("vector", "raster")).select("datasource_id", "identifier", "data_type")


@query("select ok, count(*) as requests, count(distinct ds) as sources from (select req_id, parts[4] as ds, coalesce(lower(string_split(parts[7], '.')[2]) in ('png', 'mvt', 'pbf') and try_cast(parts[5] as int) between 0 and 255, false) as ok from (select req_id, string_split(path, '/') as parts from fx_requests)) group by ok")
def request_health(spark, sf_dir):
    r = view(spark, sf_dir, "fx_requests")
    parsed = store.parse_request(c("path"))
    return r.select(parsed["ok"].alias("ok"), F.get(F.split("path", "/"), F.lit(3)).alias("ds")).groupBy("ok").agg(F.count("*").alias("requests"), F.countDistinct("ds").alias("sources"))
