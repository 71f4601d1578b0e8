"""Registered queries over the driver's tables and, where SQL can say the same, DuckDB SQL. Names begin with the survey's ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K
from ..functions import payload as P
from ..operators import checksums, dictionary, handlers, pressure, rollups, runs, validation, windows
from ..sources import archive
from ..streaming import commits, keyed, pipeline
from .bindings import MOMENTS, UNIVERSE, V_DETAIL, V_FILES, V_GATES, V_STREAM, as_stream_events, bytes_sql, detailed, files, fnv_sql, gate_events, radials, stream_events
from .shared import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUCKETS, SHARDS = 24, 4
N = UNIVERSE.sources


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def gates(spark: SparkSession, d: str) -> DataFrame:
    g = gate_events(spark, d)
    g = g.withColumn("status", P.gate_status(F.col("moment_name"), F.col("raw_value"), F.col("scale")))
    return g.withColumn("calibrated", P.calibrated(F.col("raw_value"), F.col("scale"), F.col("offset"), F.col("status")))


# ---- files ----


@query(f"""WITH {V_FILES} SELECT path, d AS archive_date, radar_id, file_name, CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR * CAST(hh AS INT) AS volume_timestamp FROM f""")
def sc7_object_keys(spark, d):
    return files(spark, d).select("path", *[c.alias(n) for n, c in archive.parsed_key(F.col("path")).items()]).withColumn("volume_timestamp", F.col("volume_timestamp").cast("timestamp_ntz"))


@query(f"WITH {V_FILES} SELECT upper(radar_id) AS radar_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM f GROUP BY 1")
def ag18_manifest_summary(spark, d):
    return rollups.manifest_summary(files(spark, d))


@query(f"WITH {V_FILES} SELECT file_seq, radar_id, size_bytes FROM f WHERE radar_id IN (SELECT 'K' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation WHERE n_regionkey = 1)")
def j4_wanted_radars(spark, d):
    wanted = spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey = 1").select(F.concat(F.lit("K"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("radar_id"))
    return archive.of_radars(files(spark, d), wanted).select("file_seq", "radar_id", "size_bytes")


@query(f"WITH {V_FILES}, r AS (SELECT file_seq, size_bytes, count(*) OVER w AS n, sum(size_bytes) OVER w AS t FROM f WINDOW w AS (ORDER BY radar_id, file_seq ROWS UNBOUNDED PRECEDING)) SELECT file_seq, size_bytes, n, CAST(t AS BIGINT) AS total_bytes FROM r WHERE n <= 50 AND t <= 20000000")
def wn8_capped_prefix(spark, d):
    rows = windows.capped_prefix(files(spark, d).select("radar_id", "file_seq", "size_bytes"), ["radar_id", "file_seq"], 50, 20_000_000)
    return rows.select("file_seq", "size_bytes", "n", "total_bytes")


@query(f"WITH {V_FILES} SELECT DISTINCT upper(trim(radar_id)) AS radar_id FROM f")
def se2_distinct_radars(spark, d):
    return files(spark, d).select(dictionary.normal_ids(None, "radar_id").alias("radar_id")).distinct()


@query(f"WITH {V_FILES} SELECT path, size_bytes FROM f ORDER BY path LIMIT 25")
def so2_first_files(spark, d):
    """Files can share a path. The SQL leaves open which of them come first; here it is those of the smaller file_seq."""
    return files(spark, d).orderBy("path", "file_seq", "size_bytes").limit(25).select("path", "size_bytes")


# ---- gates ----


@query(f"WITH {V_GATES} SELECT radial_key, gate_index, status FROM c")
def pr2_gate_status(spark, d):
    return gates(spark, d).select("radial_key", "gate_index", "status")


@query(f"WITH {V_GATES} SELECT moment_name, count(calibrated) AS n, round(sum(calibrated), 3) AS total, min(calibrated) AS least, max(calibrated) AS most FROM c GROUP BY 1")
def pr3_calibrated(spark, d):
    return gates(spark, d).groupBy("moment_name").agg(F.count("calibrated").alias("n"), F.round(F.sum("calibrated"), 3).alias("total"), F.min("calibrated").alias("least"), F.max("calibrated").alias("most"))


@query(f"WITH {V_GATES} SELECT volume_id, CAST(sum(CAST(round(calibrated * 1000) AS BIGINT)) AS BIGINT) AS scaled FROM c GROUP BY 1")
def pr5_scaled_sum(spark, d):
    return gates(spark, d).groupBy("volume_id").agg(F.sum(P.scaled(F.col("calibrated"))).alias("scaled"))


@query(f"WITH {V_GATES} SELECT gate_index, max(CAST(CAST(2.125 AS FLOAT) + CAST(gate_index AS FLOAT) * CAST(0.25 AS FLOAT) AS FLOAT)) AS range_km FROM c GROUP BY 1")
def pr4_range_km(spark, d):
    return gate_events(spark, d).groupBy("gate_index").agg(F.max(P.range_km(F.lit(2.125), F.lit(0.25), F.col("gate_index"))).alias("range_km"))


STATUS_SQL = ", ".join(f"count(*) FILTER (WHERE status = {i}) AS n_{i}_{s.lower()}" for i, s in enumerate(P.STATUS))


@query(f"WITH {V_GATES} SELECT volume_id, count(*) AS gates, {STATUS_SQL}, count(*) FILTER (WHERE status = 0) / count(*)::DOUBLE AS valid_share FROM c GROUP BY 1")
def ag13_status_counts(spark, d):
    return rollups.status_counts(gates(spark, d), "volume_id")


@query(f"WITH {V_GATES} SELECT moment_name, count(calibrated) AS \"values\", min(calibrated) AS least, max(calibrated) AS most, coalesce(CAST(sum(CAST(round(calibrated * 1000) AS BIGINT)) AS BIGINT), 0) AS scaled_sum, CAST(sum(raw_value) AS BIGINT) AS raw_sum FROM c GROUP BY 1")
def ag14_calibrated_stats(spark, d):
    return rollups.calibrated_stats(gates(spark, d), "moment_name")


@query(f"WITH {V_GATES} SELECT CAST(sum(raw_value) AS BIGINT) AS raw_sum, count(*) AS gates FROM g")
def ag15_raw_sum(spark, d):
    return gate_events(spark, d).agg(F.sum("raw_value").alias("raw_sum"), F.count("*").alias("gates"))


HEAD_FIELDS = ("gate_count", "word_size", "first_km", "spacing_km", "scale", "offset")
HEAD_SQL = f"""{V_GATES}, h AS (SELECT radial_key, moment_name, CAST(count(*) AS INT) AS gate_count, CAST(CASE WHEN radial_key % 3 = 0 THEN 16 ELSE 8 END AS INT) AS word_size, CAST(radial_key % 5 AS FLOAT) AS first_km,
CAST(CASE WHEN radial_key % 2 = 0 THEN 0.25 ELSE 1 END AS FLOAT) AS spacing_km, max(scale) AS scale, max("offset") AS "offset" FROM g GROUP BY radial_key, moment_name)"""


def headers(spark, d):
    """The headers of moment blocks: the gates of a moment in a radial are one block."""
    k = F.col("radial_key")
    rows = gate_events(spark, d).groupBy("radial_key", "moment_name").agg(F.count("*").alias("gate_count"), F.max("scale").alias("scale"), F.max("offset").alias("offset"))
    return rows.withColumns({"word_size": F.when(k % 3 == 0, 16).otherwise(8), "first_km": (k % 5).cast("float"), "spacing_km": F.when(k % 2 == 0, 0.25).otherwise(1.0).cast("float")})


@query(f"WITH {HEAD_SQL} SELECT moment_name, count(*) AS radials, CAST(sum(gate_count) AS BIGINT) AS gates, " + ", ".join(f'{f}("{c}") AS {f}_{c}' for c in HEAD_FIELDS for f in ("min", "max")) + " FROM h GROUP BY 1")
def ag9_moment_summary(spark, d):
    return rollups.moment_summary(headers(spark, d))


@query(f"WITH {V_GATES} SELECT count(*) AS gates, count(*) FILTER (WHERE status = 0) AS valid, count(DISTINCT volume_id) AS volumes, count(*) FILTER (WHERE status = 0) / count(*)::DOUBLE AS valid_share FROM c")
def ag19_replay_totals(spark, d):
    return gates(spark, d).agg(F.count("*").alias("gates"), F.count_if(F.col("status") == 0).alias("valid"), F.countDistinct("volume_id").alias("volumes"), (F.count_if(F.col("status") == 0) / F.count("*")).alias("valid_share"))


R = "r AS (SELECT o_orderkey % 16 AS volume_id, o_orderkey AS radial_key, CAST(substr(o_orderpriority, 1, 1) AS INT) AS elevation_number, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS radial_status FROM orders)"
SW = f"{R}, l AS (SELECT *, row_number() OVER w AS radial_seq, CASE WHEN lag(elevation_number) OVER w IS NULL OR lag(elevation_number) OVER w <> elevation_number OR radial_status IN (0, 3, 5, 80, 83, 85) THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY volume_id ORDER BY radial_key)), x AS (SELECT *, CAST(sum(n) OVER (PARTITION BY volume_id ORDER BY radial_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sweep FROM l)"


@query(f"WITH {SW} SELECT volume_id, radial_key, radial_seq FROM x")
def wn1_radial_sequence(spark, d):
    return windows.sweeps(radials(spark, d)).select("volume_id", "radial_key", "radial_seq")


def radial_places(spark, d):
    """The record, sweep and minute of each radial: eight radials make a record; sweeps count per volume."""
    r = windows.sweeps(radials(spark, d))
    minutes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("radial_key"), (F.unix_date(F.col("o_orderdate").cast("date")) * 1440).alias("minute"))
    return r.select("radial_key", F.floor(F.col("radial_key") / 8).cast("bigint").alias("record"), (F.col("volume_id") * 1_000_000 + F.col("sweep")).alias("sweep")).join(minutes, "radial_key")


@query(f"""WITH {V_GATES}, {SW}, k AS (SELECT radial_key, volume_id * 1000000 + sweep AS sweep FROM x),
o AS (SELECT c.*, radial_key // 8 AS record, k.sweep, date_diff('day', DATE '1970-01-01', CAST(message_ts AS DATE)) * 1440 AS minute FROM c JOIN k USING (radial_key)),
p AS (SELECT 'volume' AS kind, volume_id AS bucket, status FROM o UNION ALL SELECT 'radial', radial_key, status FROM o UNION ALL SELECT 'elevation', elevation_number, status FROM o
UNION ALL SELECT 'record', record, status FROM o UNION ALL SELECT 'sweep', sweep, status FROM o UNION ALL SELECT 'minute', minute, status FROM o),
shares AS (SELECT kind, bucket, count(*) AS n, count(*) FILTER (WHERE status = 0) AS valid, count(*) FILTER (WHERE status = 0) / count(*)::DOUBLE AS share FROM p GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY share, bucket) AS lo, row_number() OVER (PARTITION BY kind ORDER BY share DESC, bucket) AS hi FROM shares)
SELECT kind, count(*) AS buckets, max(bucket) FILTER (WHERE lo = 1) AS least_bucket, min(share) AS least_share, max(bucket) FILTER (WHERE hi = 1) AS most_bucket, max(share) AS most_share, min(valid) AS least_valid, max(valid) AS most_valid FROM ranked GROUP BY 1""")
def ag16_unevenness(spark, d):
    rows = gates(spark, d).join(radial_places(spark, d), "radial_key")
    kinds = {"volume": "volume_id", "record": "record", "sweep": "sweep", "radial": "radial_key", "minute": "minute", "elevation": "elevation_number"}
    return rollups.unevenness(rows, kinds, within="radial_key")


@query(f"WITH {SW} SELECT volume_id, radial_key, sweep FROM x")
def wn2_sweeps(spark, d):
    return windows.sweeps(radials(spark, d)).select("volume_id", "radial_key", "sweep")


@query(f"WITH {SW} SELECT volume_id, radial_key, greatest(elevation_number - 1, 0) AS slot, (radial_seq - 1) % 10 AS bucket FROM x")
def pr7_slots(spark, d):
    return windows.sweeps(radials(spark, d)).select("volume_id", "radial_key", P.elevation_slot(F.col("elevation_number")).alias("slot"), P.azimuth_bucket(F.col("radial_seq"), 10).alias("bucket"))


@query(f"""WITH {SW}, m AS (SELECT DISTINCT l_orderkey, l_returnflag AS moment FROM lineitem), n AS (SELECT volume_id, sweep, string_agg(DISTINCT moment, ',' ORDER BY moment) AS moments FROM x JOIN m ON radial_key = l_orderkey GROUP BY 1, 2),
y AS (SELECT volume_id, sweep, count(*) AS radials, min(elevation_number) AS elevation_number, avg(elevation_number * 0.5 + radial_key % 4 * 0.125) AS avg_elevation_angle, min(elevation_number * 0.5 + radial_key % 4 * 0.125)::FLOAT AS min_elevation_angle, max(elevation_number * 0.5 + radial_key % 4 * 0.125)::FLOAT AS max_elevation_angle,
min(radial_key % 3)::INT AS min_cut_sector, max(radial_key % 3)::INT AS max_cut_sector, min(radial_key) AS first_radial, max(radial_key) AS last_radial, min_by(radial_status, radial_key) AS start_status, max_by(radial_status, radial_key) AS end_status,
count(*) AS volume_blocks, count(*) FILTER (WHERE radial_key % 2 = 0) AS elevation_blocks, CAST(sum(radial_key % 3) AS BIGINT) AS radial_blocks FROM x GROUP BY 1, 2)
SELECT y.*, coalesce(moments, '') AS moments FROM y LEFT JOIN n USING (volume_id, sweep)""")
def ag10_sweep_summary(spark, d):
    k = F.col("radial_key")
    moments = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("radial_key")).agg(F.collect_set("l_returnflag").alias("moments"))
    rows = windows.sweeps(radials(spark, d)).join(moments, "radial_key", "left").withColumns({
        "moments": F.coalesce("moments", F.array().cast("array<string>")), "elevation_angle": (F.col("elevation_number") * 0.5 + k % 4 * 0.125).cast("float"), "cut_sector": (k % 3).cast("int"),
        "volume_blocks": F.lit(1), "elevation_blocks": F.when(k % 2 == 0, 1).otherwise(0), "radial_blocks": k % 3})
    return rollups.sweep_summary(rows).withColumn("moments", F.array_join("moments", ","))


@query()
def ck4_chronology(spark, d):
    return checksums.chronology(gates(spark, d), ["radial_key", "gate_index"])


# ---- stream events: keys and payloads ----


@query(f"WITH {V_STREAM} SELECT event_seq, source_id FROM v")
def pr8_source_encode(spark, d):
    return stream_events(spark, d).select("event_seq", "source_id")


@query(f"WITH {V_STREAM} SELECT event_seq, radar_ordinal, elevation_slot, azimuth_bucket, range_band FROM v")
def pr9_source_decode(spark, d):
    return stream_events(spark, d).select("event_seq", *[c.alias(n) for n, c in UNIVERSE.decode(F.col("source_id")).items()])


@query(f"WITH {V_STREAM} SELECT event_seq, source_id FROM v WHERE source_id >= 160 AND source_id < 240")
def pr10_radar_block(spark, d):
    first, end = UNIVERSE.radar_block(2)
    return stream_events(spark, d).filter((F.col("source_id") >= first) & (F.col("source_id") < end)).select("event_seq", "source_id")


BUCKET_SQL = "CASE WHEN source_id < 16 * 27 THEN source_id // 27 ELSE 16 + (source_id - 16 * 27) // 26 END"


@query(f"WITH {V_STREAM} SELECT event_seq, {BUCKET_SQL} AS bucket_id, ({BUCKET_SQL}) * 4 // 24 AS shard_id FROM v")
def pr12_bucket_closed_form(spark, d):
    b = K.bucket_of(F.col("source_id"), N, BUCKETS)
    return stream_events(spark, d).select("event_seq", b.alias("bucket_id")).withColumn("shard_id", K.shard_of(F.col("bucket_id"), BUCKETS, SHARDS))


@query(f"WITH {V_STREAM} SELECT event_seq, {BUCKET_SQL} AS bucket_id, ({BUCKET_SQL}) * 4 // 24 AS shard_id FROM v")
def j3_range_join(spark, d):
    return rollups.range_join(stream_events(spark, d), rollups.assignments(spark, N, BUCKETS, SHARDS)).select("event_seq", "bucket_id", "shard_id")


@query(f"WITH {V_STREAM} SELECT event_seq, gate_count AS n, raw_sum FROM v")
def pr18_payload_sums(spark, d):
    return stream_events(spark, d).select("event_seq", F.size("gates").cast("bigint").alias("n"), "raw_sum")


#: The gates of an event in DuckDB.
GATE_SQL = "e AS (SELECT event_id AS event_seq, [CAST((CAST(floor(value) AS BIGINT) * (i + 1) + k) % 256 AS INT) for i in range(0, 1 + k % 8)] AS gates FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


@query(f"WITH {GATE_SQL}, b AS (SELECT event_seq, gates, len(gates) AS n, unnest(range(0, 4)) AS band FROM e) SELECT event_seq, band, (band * n) // 4 AS start, ((band + 1) * n) // 4 - (band * n) // 4 AS n, array_to_string(gates[(band * n) // 4 + 1:((band + 1) * n) // 4], ' ') AS gates FROM b WHERE ((band + 1) * n) // 4 > (band * n) // 4")
def pr6_band_split(spark, d):
    rows = stream_events(spark, d).select("event_seq", F.explode(P.band_slices("gates", 4)).alias("x"))
    return rows.select("event_seq", F.col("x.band").cast("bigint").alias("band"), F.col("x.start").cast("bigint").alias("start"), F.size("x.gates").cast("bigint").alias("n"), F.array_join(F.col("x.gates").cast("array<string>"), " ").alias("gates"))


@query(f"WITH {GATE_SQL} SELECT event_seq, i - 1 AS gate_index, gates[i] AS raw FROM (SELECT event_seq, gates, unnest(range(1, len(gates) + 1)) AS i FROM e)")
def pr1_gate_explode(spark, d):
    return stream_events(spark, d).select("event_seq", F.posexplode("gates").alias("gate_index", "raw")).withColumn("gate_index", F.col("gate_index").cast("bigint"))


@query(f"WITH {V_STREAM} SELECT event_seq, CASE event_seq % 7 WHEN 1 THEN 'word size' WHEN 2 THEN 'length' WHEN 3 THEN 'outside' WHEN 4 THEN 'empty' END AS error, CASE WHEN event_seq % 7 IN (0, 5, 6) THEN gate_count END AS n, CASE WHEN event_seq % 7 IN (0, 5, 6) THEN raw_sum END AS raw_sum FROM v")
def pr19_payload_slices(spark, d):
    """Gates as big-endian 16-bit words in a binary payload behind two other bytes, and back; some references are wrong."""
    k = F.col("event_seq") % 7
    rows = stream_events(spark, d).select("event_seq", "gate_count", F.unhex(F.concat(F.lit("FFFF"), F.array_join(F.transform("gates", lambda g: F.lpad(F.hex(g), 4, "0")), ""))).alias("payload"))
    rows = rows.withColumns({"gate_count": F.when(k == 4, 0).otherwise(F.col("gate_count")), "word_size": F.when(k == 1, 12).otherwise(16), "at": F.when(k == 3, 1000).otherwise(2)})
    rows = rows.withColumn("size", P.expected_length(F.col("gate_count"), F.col("word_size")) + F.when(k == 2, 1).otherwise(0))
    place = [F.col(c) for c in ("payload", "at", "size", "gate_count", "word_size")]
    good = lambda c: F.when(F.col("error").isNull(), c)
    back = rows.withColumn("error", P.slice_error(*place)).withColumn("g", good(P.gates_of(P.payload_slice(*place), F.lit(0), F.col("gate_count"), F.lit(16))))
    return back.select("event_seq", "error", good(F.size("g").cast("bigint")).alias("n"), P.raw_sum(F.col("g")).alias("raw_sum"))


@query("SELECT event_id, hour(ts) * 60 + minute(ts) AS minute_of_day FROM events")
def pr16_minute_of_day(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", P.minute_of_day(F.col("ts")).cast("bigint").alias("minute_of_day"))


@query("SELECT event_id, epoch_ms(CAST((event_id % 20000) * 86400000 + (event_id * 7919) % 86400000 AS BIGINT)) AS ts FROM events")
def pr15_julian_time(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", P.julian_timestamp(F.col("event_id") % 20000 + 1, F.col("event_id") * 7919 % 86_400_000).cast("timestamp_ntz").alias("ts"))


CASES = "concat(CASE k % 5 WHEN 0 THEN ' ' ELSE '' END, CASE k % 3 WHEN 0 THEN lower(event_type) ELSE upper(event_type) END, CASE k % 7 WHEN 0 THEN '-LONG' ELSE '' END)"


@query(f"""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), t AS (SELECT event_id, {CASES} AS x FROM e), a AS (SELECT event_id, x, length(regexp_extract(x, '^[A-Z0-9_]*')) + 1 AS bad FROM t)
SELECT event_id, CASE WHEN length(x) > 8 THEN 'too long' WHEN bad <= length(x) THEN 'character ' || bad END AS error FROM a""")
def pr13_identity_check(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.withColumn("x", F.expr(CASES)).select("event_id", P.identity_error(F.col("x"), 1, 8, "A-Z0-9_").alias("error"))


@query("SELECT s_suppkey, CASE WHEN regexp_full_match(upper(trim(substr(s_name, 1, 1 + s_suppkey % 7))), '[A-Z0-9]{4}') THEN upper(trim(substr(s_name, 1, 1 + s_suppkey % 7))) END AS radar_id FROM supplier")
def pr14_normal_radar(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select("s_suppkey", P.normal_radar(F.substring("s_name", F.lit(1), (1 + F.col("s_suppkey") % 7).cast("int"))).alias("radar_id"))


@query(f"WITH {V_STREAM}, s AS (SELECT source_id, CAST(count(*) * 900 AS DOUBLE) + sum(gate_count) * CAST(0.001 AS DOUBLE) AS x FROM v GROUP BY 1) SELECT source_id, round(x, 3) AS score, CASE WHEN x >= 100000 THEN 'SuperHot' WHEN x >= 50000 THEN 'Hot' WHEN x >= 10000 THEN 'Warm' WHEN x <= 0 THEN 'Cold' ELSE 'Normal' END AS band FROM s")
def pr20_pressure_score(spark, d):
    s = rollups.source_rollup(stream_events(spark, d))
    x = P.pressure(F.col("event_count") * 900, F.col("value_count"), F.col("raw_checksum"))
    return s.select("source_id", F.round(x, 3).alias("score"), P.static_band(x).alias("band"))


# ---- dictionaries ----

CAT = f"{V_STREAM}, cat AS (SELECT text, row_number() OVER (ORDER BY f, text) - 1 AS id FROM (SELECT moment_name AS text, min(event_seq) AS f FROM v GROUP BY 1))"


def catalog(spark, d):
    return dictionary.assign_ids(stream_events(spark, d), "moment_name", "event_seq").select("text", "id")


@query(f"WITH {CAT} SELECT text, id FROM cat")
def di1_assign_ids(spark, d):
    return catalog(spark, d)


@query(f"WITH {CAT} SELECT event_seq, moment_name, id AS moment_id FROM v LEFT JOIN cat ON moment_name = text")
def di2_lookup(spark, d):
    return dictionary.lookup(stream_events(spark, d), catalog(spark, d), "moment_name", "moment_id").select("event_seq", "moment_name", "moment_id")


@query(f"WITH {CAT} SELECT text, id FROM cat WHERE id < 3")
def di3_snapshot(spark, d):
    return dictionary.snapshot(catalog(spark, d), 4)


@query(f"WITH {CAT} SELECT text, id FROM cat WHERE id >= 1 AND id < 4")
def di4_delta(spark, d):
    return dictionary.delta(catalog(spark, d), 2, 5)


@query(f"WITH {CAT} SELECT text, id FROM cat WHERE id < 4")
def di5_apply_delta(spark, d):
    c = catalog(spark, d)
    return dictionary.apply_delta(dictionary.snapshot(c, 2), dictionary.delta(c, 2, 5), 2)


@query(f"WITH {CAT} SELECT count(*) AS entries, count(*) = max(id) + 1 AS dense, count(DISTINCT text) = count(*) AS \"unique\" FROM cat")
def di6_density(spark, d):
    return dictionary.density(catalog(spark, d))


@query(f"""WITH {V_STREAM}, s AS (SELECT 'radar' AS kind, 0 AS r, radar_code AS text, min(event_seq) AS f FROM v GROUP BY radar_code UNION ALL SELECT 'moment', 1, moment_name, min(event_seq) FROM v GROUP BY moment_name)
SELECT row_number() OVER w + 1 AS version, kind, text, count(*) FILTER (WHERE kind = 'radar') OVER u AS radar_count, count(*) FILTER (WHERE kind = 'moment') OVER u AS moment_count FROM s WINDOW w AS (ORDER BY f, r, text), u AS (ORDER BY f, r, text ROWS UNBOUNDED PRECEDING)""")
def di7_combined_versions(spark, d):
    return dictionary.combined_versions(stream_events(spark, d), {"radar_code": "radar", "moment_name": "moment"}, "event_seq")


@query(f"""WITH {V_STREAM}, x AS (SELECT event_seq, CASE WHEN event_seq % 11 = 0 THEN radar_code || 'X' ELSE radar_code END AS rc, CASE WHEN event_seq % 13 = 0 THEN lower(moment_name) ELSE moment_name END AS m, elevation_slot AS e, azimuth_bucket AS a, range_band AS b,
CASE WHEN event_seq % 11 = 0 THEN 'InvalidRadarCode' WHEN event_seq % 13 = 0 THEN 'InvalidMomentName' WHEN event_seq % 17 = 0 THEN 'SourceOutOfRange' WHEN azimuth_bucket > 3 THEN 'SourceDimensionOutsideStreamEventRange' END AS t FROM v),
ra AS (SELECT rc, row_number() OVER (ORDER BY min(event_seq), rc) - 1 AS rid FROM x WHERE t IS NULL GROUP BY rc),
y AS (SELECT x.*, rid, CASE WHEN rid >= 6 THEN 'RadarOrdinalOutsideSourceUniverse' WHEN rid > 3 THEN 'RadarOrdinalOutsideStreamEventRange' END AS r FROM x LEFT JOIN ra ON x.rc = ra.rc AND t IS NULL),
mo AS (SELECT m, row_number() OVER (ORDER BY min(event_seq), m) - 1 AS mid FROM y WHERE t IS NULL AND r IS NULL GROUP BY m),
z AS (SELECT y.*, mid, coalesce(t, r, CASE WHEN mid > 3 THEN 'MomentIdOutsideStreamEventRange' END) AS error FROM y LEFT JOIN mo ON y.m = mo.m AND t IS NULL AND r IS NULL)
SELECT event_seq, error, CASE WHEN error IS NULL THEN rid END AS radar_ordinal, CASE WHEN error IS NULL THEN mid END AS moment_id, CASE WHEN error IS NULL THEN ((rid * 4 + e) * 10 + a) * 2 + b END AS source_id FROM z""")
def di8_normalise(spark, d):
    """With room for six radars and ids of at most 3, so that each of the seven rules fails somewhere."""
    s = F.col("event_seq")
    v = stream_events(spark, d).withColumn("radar_code", F.when(s % 11 == 0, F.concat("radar_code", F.lit("X"))).otherwise(F.col("radar_code"))).withColumn("moment_name", F.when(s % 13 == 0, F.lower("moment_name")).otherwise(F.col("moment_name"))).withColumn("elevation_slot", F.when(s % 17 == 0, 9).otherwise(F.col("elevation_slot")))
    return dictionary.normalise(v, "radar_code", "moment_name", K.Universe(6, 4, 10, 2), most=3).select("event_seq", "error", "radar_ordinal", "moment_id", "source_id")


@query()
def di9_dictionary_checksum(spark, d):
    v = stream_events(spark, d)
    both = [dictionary.assign_ids(v, c, "event_seq").select(F.lit(k).alias("catalog"), "id", "text") for c, k in (("radar_code", "radar"), ("moment_name", "moment"))]
    return checksums.dictionary_checksum(both[0].unionByName(both[1]), 14)


# ---- rollups ----


@query(f"WITH {V_STREAM} SELECT batch_seq, count(*) AS event_count, CAST(sum(gate_count) AS BIGINT) AS payload_bytes, CAST(sum(gate_count) AS BIGINT) AS value_count, CAST(sum(raw_sum) AS BIGINT) AS raw_checksum FROM v GROUP BY 1")
def ag1_batch_metrics(spark, d):
    return rollups.batch_metrics(stream_events(spark, d))


@query(f"WITH {V_STREAM} SELECT CAST(sum(gate_count) AS BIGINT) AS value_count, CAST(sum(raw_sum) AS BIGINT) AS raw_checksum FROM v")
def ag2_payload_totals(spark, d):
    return stream_events(spark, d).agg(F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"))


SOURCE_SQL = f"WITH {V_STREAM} SELECT source_id, count(*) AS event_count, CAST(sum(gate_count) AS BIGINT) AS value_count, CAST(sum(raw_sum) AS BIGINT) AS raw_checksum, max(message_ticks) AS last_ticks FROM v GROUP BY 1"


@query(SOURCE_SQL)
def ag3_source_rollup(spark, d):
    return rollups.source_rollup(stream_events(spark, d))


@query(f"WITH {V_STREAM} SELECT count(DISTINCT batch_seq) AS batches, count(DISTINCT source_id) AS active_sources, count(*) AS event_count, CAST(sum(gate_count) AS BIGINT) AS value_count, CAST(sum(raw_sum) AS BIGINT) AS raw_checksum FROM v")
def ag4_run_metrics(spark, d):
    return rollups.run_metrics(stream_events(spark, d))


@query(f"WITH {V_STREAM} SELECT batch_seq, source_id, count(*) AS event_count, CAST(sum(gate_count) AS BIGINT) AS value_count, CAST(sum(raw_sum) AS BIGINT) AS raw_checksum, min(message_ticks) AS first_ticks, max(message_ticks) AS last_ticks FROM v GROUP BY 1, 2")
def ag5_batch_deltas(spark, d):
    return rollups.batch_deltas(stream_events(spark, d))


LOAD_SQL = f"""{V_STREAM}, b AS (SELECT unnest(range(0, 24)) AS bucket_id), e AS (SELECT *, {BUCKET_SQL} AS bk FROM v),
l AS (SELECT bucket_id, bucket_id * 4 // 24 AS shard_id, count(bk) AS event_count, CAST(coalesce(sum(gate_count), 0) AS BIGINT) AS value_count, CAST(coalesce(sum(raw_sum), 0) AS BIGINT) AS raw_checksum, count(DISTINCT source_id) AS active_sources FROM b LEFT JOIN e ON bk = bucket_id GROUP BY 1)"""


@query(f"WITH {LOAD_SQL} SELECT * FROM l")
def ag6_bucket_load(spark, d):
    return rollups.bucket_load(stream_events(spark, d), N, BUCKETS, SHARDS)


@query(f"WITH {LOAD_SQL} SELECT shard_id, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(value_count) AS BIGINT) AS value_count, CAST(sum(raw_checksum) AS BIGINT) AS raw_checksum, count(*) FILTER (WHERE event_count > 0) AS active_buckets FROM l GROUP BY 1")
def ag6_shard_load(spark, d):
    return rollups.shard_load(stream_events(spark, d), N, BUCKETS, SHARDS)


@query(f"WITH {LOAD_SQL} SELECT bucket_id AS hot_bucket_id, event_count FROM l ORDER BY event_count DESC, bucket_id LIMIT 1")
def ag7_hot_bucket(spark, d):
    return rollups.hottest(rollups.bucket_load(stream_events(spark, d), N, BUCKETS, SHARDS), "bucket_id")


@query("SELECT CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 31 END AS INT) AS message_type, count(*) AS messages FROM events GROUP BY 1")
def ag8_message_histogram(spark, d):
    kinds = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(31)
    return archive.message_histogram(spark.read.parquet(f"{d}/events.parquet").select(kinds.alias("message_type")))


@query(f"WITH {V_STREAM}, p AS (SELECT batch_seq, source_id, count(*) AS n, sum(raw_sum) AS c, max(message_ticks) AS t FROM v GROUP BY 1, 2) SELECT source_id, CAST(sum(n) AS BIGINT) AS event_count, CAST(sum(c) AS BIGINT) AS raw_checksum, max(t) AS last_ticks FROM p GROUP BY 1")
def ag12_merge_partials(spark, d):
    return rollups.batch_deltas(stream_events(spark, d)).groupBy("source_id").agg(F.sum("event_count").alias("event_count"), F.sum("raw_checksum").alias("raw_checksum"), F.max("last_ticks").alias("last_ticks"))


LEDGER = "SELECT o_orderkey AS sequence, CASE o_orderkey % 9 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Claimed' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Committed' WHEN 4 THEN 'Failed' WHEN 5 THEN 'Poison' WHEN 6 THEN 'Abandoned' WHEN 7 THEN 'Canceled' ELSE 'Released' END AS state, CAST(length(o_orderpriority) % 5 AS INT) AS attempt FROM orders"
STATE_SQL = ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x.lower()}" for x in rollups.STATES)


@query(f"WITH l AS ({LEDGER}) SELECT count(*) AS entries, {STATE_SQL}, CAST(sum(greatest(0, attempt - 1)) AS BIGINT) AS retries, min(sequence) FILTER (WHERE state NOT IN ('Committed', 'Released')) AS oldest_open, min(sequence) FILTER (WHERE state IN ('Failed', 'Poison')) AS first_blocking, min_by(state, sequence) FILTER (WHERE state IN ('Failed', 'Poison')) AS blocking_reason FROM l")
def ag20_ledger_summary(spark, d):
    names = F.array(*[F.lit(x) for x in rollups.STATES])
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sequence"), F.element_at(names, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("state"), (F.length("o_orderpriority") % 5).alias("attempt"))
    return rollups.ledger_summary(o)


@query(f"WITH {V_STREAM} SELECT count(DISTINCT batch_seq) AS batches, count(*) AS events, CAST(sum(gate_count) AS BIGINT) AS bytes, CAST(sum(gate_count) AS BIGINT) AS \"values\", CAST(sum(raw_sum) AS BIGINT) AS checksum FROM v")
def ag22_counting_sink(spark, d):
    totals = runs.counted_write(detailed(stream_events(spark, d)), f"{work_folder(spark)}/events", first=F.col("message") == 0)
    return spark.createDataFrame([totals], "batches bigint, events bigint, bytes bigint, values bigint, checksum bigint")


@query(f"WITH s AS ({SOURCE_SQL}) SELECT CAST(i AS BIGINT) AS source_id, s.source_id IS NOT NULL AS active, coalesce(event_count, 0) AS event_count, coalesce(value_count, 0) AS value_count, coalesce(raw_checksum, 0) AS raw_checksum, coalesce(last_ticks, 0) AS last_ticks FROM (SELECT unnest(range(0, 640)) AS i) LEFT JOIN s ON i = s.source_id")
def j6_all_sources(spark, d):
    return rollups.all_sources(rollups.source_rollup(stream_events(spark, d)), N)


def processed(spark, d):
    m = rollups.batch_metrics(stream_events(spark, d)).filter("batch_seq % 7 <> 3")
    return m.select("batch_seq", F.when(F.col("batch_seq") % 5 == 4, "Failed").otherwise("Succeeded").alias("status"), "event_count")


OUT_SQL = f"""{V_STREAM}, m AS (SELECT batch_seq, count(*) AS n, CAST(sum(gate_count) AS BIGINT) AS g FROM v GROUP BY 1), a AS (SELECT * FROM m WHERE batch_seq % 3 <> 1), p AS (SELECT batch_seq, CASE WHEN batch_seq % 5 = 4 THEN 'Failed' ELSE 'Succeeded' END AS status, n FROM m WHERE batch_seq % 7 <> 3),
o AS (SELECT coalesce(a.batch_seq, p.batch_seq) AS batch_seq, coalesce(a.n, 0) AS accepted_events, coalesce(a.g, 0) AS accepted_values, coalesce(status, '') AS status, coalesce(p.n, 0) AS processed_events FROM a FULL JOIN p ON a.batch_seq = p.batch_seq)"""


def outcomes(spark, d):
    return runs.batch_outcomes(rollups.batch_metrics(stream_events(spark, d)).filter("batch_seq % 3 <> 1"), processed(spark, d))


@query(f"WITH {OUT_SQL} SELECT * FROM o")
def j2_batch_outcomes(spark, d):
    return outcomes(spark, d)


@query(f"WITH {OUT_SQL} SELECT count(*) FILTER (WHERE accepted_events > 0) AS accepted, count(*) FILTER (WHERE status = 'Succeeded') AS succeeded, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE accepted_events > 0) = count(*) FILTER (WHERE status = 'Succeeded') AS complete FROM o")
def ag21_diagnostics(spark, d):
    return runs.diagnostics(outcomes(spark, d))


@query(f"WITH {OUT_SQL}, j AS (SELECT batch_seq, min(message_ticks) AS s, max(message_ticks) AS f FROM v WHERE batch_seq % 7 <> 3 GROUP BY 1) SELECT count(*) FILTER (WHERE accepted_events > 0) AS accepted_batches, count(*) FILTER (WHERE status <> '') AS processed_batches, count(*) FILTER (WHERE status = 'Succeeded') AS committed_batches, CAST(sum(accepted_events) AS BIGINT) AS accepted_events, max(f) - min(s) AS elapsed_ticks FROM o LEFT JOIN j ON o.batch_seq = j.batch_seq")
def qa7_capacity(spark, d):
    jobs = stream_events(spark, d).filter("batch_seq % 7 <> 3").groupBy("batch_seq").agg(F.min("message_ticks").alias("started_ticks"), F.max("message_ticks").alias("ended_ticks"))
    return runs.capacity(outcomes(spark, d), jobs)


@query(f"WITH {V_STREAM}, a AS (SELECT DISTINCT batch_seq FROM v WHERE batch_seq % 3 <> 1), p AS (SELECT DISTINCT batch_seq FROM v WHERE batch_seq % 7 <> 3) SELECT batch_seq FROM (SELECT * FROM a UNION SELECT * FROM p) ORDER BY 1")
def se1_sequences(spark, d):
    m = stream_events(spark, d).select("batch_seq")
    return m.filter("batch_seq % 3 <> 1").union(m.filter("batch_seq % 7 <> 3")).distinct().orderBy("batch_seq")


@query(f"WITH {CAT} SELECT text, id FROM cat UNION ALL SELECT text, id FROM cat WHERE id >= 2")
def se3_union_all(spark, d):
    c = catalog(spark, d)
    return c.unionByName(dictionary.delta(c, 3, 6))


@query(f"WITH {V_STREAM} SELECT batch_seq, event_seq, source_id FROM v WHERE batch_seq % 3 <> 1")
def j5_not_yet_stored(spark, d):
    stored = stream_events(spark, d).filter("batch_seq % 3 = 1").select("batch_seq").distinct()
    return stream_events(spark, d).join(stored, "batch_seq", "left_anti").select("batch_seq", "event_seq", "source_id")


@query(f"WITH s AS ({SOURCE_SQL}) SELECT source_id, CASE WHEN source_id % 11 = 0 THEN 'Missing' ELSE 'Changed' END AS problem FROM s WHERE source_id % 11 = 0 OR source_id % 13 = 0")
def j7_reconcile(spark, d):
    s = rollups.source_rollup(stream_events(spark, d))
    actual = s.filter("source_id % 11 <> 0").withColumn("event_count", F.when(F.col("source_id") % 13 == 0, F.col("event_count") + 1).otherwise(F.col("event_count")))
    return validation.reconcile(s, actual, "source_id", ["event_count", "value_count", "raw_checksum", "last_ticks"])


@query(f"WITH {V_STREAM} SELECT 'value_count: ' || CAST(sum(gate_count) AS BIGINT) || ' and ' || CAST(sum(gate_count) + 1 AS BIGINT) AS difference FROM v")
def j8_first_difference(spark, d):
    m = rollups.run_metrics(stream_events(spark, d))
    return validation.first_difference(m, m.withColumn("value_count", F.col("value_count") + 1), ["batches", "event_count", "value_count", "raw_checksum"])


@query(f"""WITH {LOAD_SQL}, a AS (SELECT sum(event_count) AS n, sum(value_count) AS g, sum(raw_checksum) AS c FROM l), tot AS (SELECT 'all' AS events, count(*) AS n, sum(gate_count) AS g, sum(raw_sum) AS c FROM v UNION ALL SELECT 'less one batch', count(*), sum(gate_count), sum(raw_sum) FROM v WHERE batch_seq > 0)
SELECT events, CASE WHEN a.n <> tot.n THEN 'event_count: ' || CAST(a.n AS BIGINT) || ' and ' || tot.n WHEN a.g <> tot.g THEN 'value_count: ' || CAST(a.g AS BIGINT) || ' and ' || CAST(tot.g AS BIGINT) WHEN a.c <> tot.c THEN 'raw_checksum: ' || CAST(a.c AS BIGINT) || ' and ' || CAST(tot.c AS BIGINT) END AS difference FROM a, tot""")
def va4_totals_agree(spark, d):
    """The load by bucket against all events, and against those of all but the first batch."""
    v = stream_events(spark, d)
    load = rollups.bucket_load(v, N, BUCKETS, SHARDS)
    of = lambda name, rows: validation.totals_agree(load, rows).select(F.lit(name).alias("events"), "difference")
    return of("all", v).unionByName(of("less one batch", v.filter("batch_seq > 0")))


# ---- windows ----

SHAKEN_SQL = f"{V_STREAM}, z AS (SELECT event_seq, batch_seq, source_id, CASE WHEN event_seq % 997 = 0 THEN message_ticks - 500000000000 ELSE message_ticks END AS t FROM v)"


def shaken(spark, d):
    """Stream events with some ticks set back."""
    return stream_events(spark, d).withColumn("message_ticks", F.when(F.col("event_seq") % 997 == 0, F.col("message_ticks") - 500_000_000_000).otherwise(F.col("message_ticks")))


@query(f"WITH {SHAKEN_SQL}, y AS (SELECT *, lag(t) OVER (PARTITION BY source_id ORDER BY event_seq) AS p FROM z) SELECT event_seq, source_id, t AS message_ticks, p AS previous_ticks FROM y WHERE t < p")
def wn3_source_order(spark, d):
    return windows.order_violations(shaken(spark, d), "source_id").select("event_seq", "source_id", "message_ticks", "previous_ticks")


@query(f"WITH {SHAKEN_SQL}, y AS (SELECT *, lag(t) OVER (PARTITION BY batch_seq ORDER BY event_seq) AS p FROM z) SELECT event_seq, batch_seq, t AS message_ticks, p AS previous_ticks FROM y WHERE t < p")
def wn4_batch_order(spark, d):
    return windows.order_violations(shaken(spark, d), "batch_seq").select("event_seq", "batch_seq", "message_ticks", "previous_ticks")


@query(f"WITH {V_STREAM} SELECT event_seq, CAST(coalesce(sum(gate_count) OVER (PARTITION BY batch_seq ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload_offset FROM v")
def wn5_payload_offsets(spark, d):
    return windows.payload_offsets(stream_events(spark, d)).select("event_seq", "payload_offset")


def samples(spark, d):
    """Load samples: per radar and batch."""
    v = stream_events(spark, d).groupBy(F.col("radar_ordinal").cast("bigint").alias("key"), F.col("batch_seq").alias("seq")).agg(F.count("*").alias("events"), F.sum("gate_count").alias("n"))
    return v.select("key", "seq", (F.col("events") * 1000 + F.col("n")).cast("double").alias("score"))


SAMPLE_SQL = f"{V_STREAM}, s AS (SELECT radar_ordinal AS key, batch_seq AS seq, CAST(count(*) * 1000 + sum(gate_count) AS DOUBLE) AS score FROM v GROUP BY 1, 2)"
ROLL_SQL = f"WITH {SAMPLE_SQL} SELECT key, seq, count(*) OVER w AS samples, round(avg(score) OVER w, 6) AS mean_score, count(*) OVER w >= 3 AS eligible FROM s WINDOW w AS (PARTITION BY key ORDER BY seq ROWS 7 PRECEDING)"


@query(ROLL_SQL)
def wn6_rolling_pressure(spark, d):
    return windows.rolling_pressure(samples(spark, d), "key", "seq", "score").select("key", "seq", "samples", F.round("mean_score", 6).alias("mean_score"), "eligible")


#: Levels 0 to 4 of q (key, seq, samples, score, i), each from the one before.
BAND_STEPS = """w AS (
SELECT key, seq, samples, score, i, CASE WHEN score >= 50000 THEN 4 WHEN score >= 25000 THEN 3 WHEN score >= 5000 THEN 2 WHEN score <= 0 THEN 0 ELSE 1 END AS r FROM q WHERE i = 1
UNION ALL SELECT q.key, q.seq, q.samples, q.score, q.i, CASE WHEN q.score >= 50000 OR r >= 4 AND q.score >= 40000 THEN 4 WHEN q.score >= 25000 OR r >= 3 AND q.score >= 20000 THEN 3 WHEN q.score >= 5000 OR r >= 2 AND q.score >= 4000 THEN 2 WHEN q.score <= 0 THEN 0 ELSE 1 END FROM w JOIN q ON q.key = w.key AND q.i = w.i + 1)"""
BAND_NAME = "CASE r WHEN 4 THEN 'SuperHot' WHEN 3 THEN 'Hot' WHEN 2 THEN 'Warm' WHEN 1 THEN 'Normal' ELSE 'Cold' END"
BAND_SQL = f"WITH RECURSIVE {SAMPLE_SQL}, q AS (SELECT *, 1 AS samples, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM s), {BAND_STEPS} SELECT key, seq, {BAND_NAME} AS band FROM w"


@query(BAND_SQL)
def wn7_hysteresis(spark, d):
    return pressure.hysteresis(samples(spark, d), "key", "seq", "score", scale=0.5).select("key", "seq", "band")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def wn9_latest(spark, d):
    return windows.latest(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


GAP_SQL = f"{V_STREAM}, a AS (SELECT radar_code AS handler, batch_seq AS sequence FROM v GROUP BY 1, 2 HAVING batch_seq % 17 <> 16), b AS (SELECT *, row_number() OVER (PARTITION BY handler ORDER BY sequence) - 1 = sequence AS ok FROM a)"


def arrived(spark, d):
    return stream_events(spark, d).select(F.col("radar_code").alias("handler"), F.col("batch_seq").alias("sequence")).filter("sequence % 17 <> 16").distinct()


@query(f"WITH {GAP_SQL} SELECT handler, sequence, ok AS released FROM b")
def wn10_released_prefix(spark, d):
    return windows.released(arrived(spark, d))


@query(f"WITH {GAP_SQL} SELECT handler, count(*) FILTER (WHERE ok) AS released, count(*) FILTER (WHERE NOT ok) AS waiting, coalesce(max(sequence) FILTER (WHERE ok) + 1, 0) AS blocking_sequence FROM b GROUP BY 1")
def wn10_blocking(spark, d):
    return windows.blocking(arrived(spark, d))


@query(f"WITH {V_STREAM}, x AS (SELECT batch_seq AS sequence, source_id, CAST(sum(raw_sum) AS BIGINT) AS value FROM v GROUP BY 1, 2) SELECT sequence, source_id, value, CAST(sum(value) OVER (PARTITION BY source_id ORDER BY sequence) AS BIGINT) AS running FROM x")
def wn11_running_values(spark, d):
    x = stream_events(spark, d).groupBy(F.col("batch_seq").alias("sequence"), "source_id").agg(F.sum("raw_sum").alias("value")).withColumn("field", F.lit("raw_checksum"))
    return windows.running_values(x).select("sequence", "source_id", "value", "running")


@query(f"WITH {V_GATES} SELECT volume_id, radial_key, gate_index, raw_value FROM g ORDER BY volume_id, radial_key, gate_index")
def so1_replay_order(spark, d):
    return gate_events(spark, d).select("volume_id", "radial_key", "gate_index", "raw_value").orderBy("volume_id", "radial_key", "gate_index")


# ---- validation ----


CHECKED = K.Universe(9, 4, 10, 2)


def rows_to_check(spark, d):
    """Stream events as a batch validator sees them, with each kind of defect somewhere in 40 batches. The universe has a radar that the dictionary lacks."""
    s, b, some = F.col("event_seq"), F.col("batch_seq"), lambda c, x: F.when(c, x)
    rows = windows.payload_offsets(shaken(spark, d))
    size = F.sum("gate_count").over(Window.partitionBy("batch_seq"))
    return rows.withColumns({
        "payload_length": some(s % 1009 == 5, F.col("gate_count") + 1).otherwise(F.col("gate_count")),
        "payload_offset": some(s % 1709 == 19, F.col("payload_offset") + 100_000).when(s % 1801 == 23, F.col("payload_offset") + 1).otherwise(F.col("payload_offset")),
        "source_id": some(s % 1201 == 7, CHECKED.sources).when(s % 1301 == 9, (F.col("source_id") + 1) % N).when(s % 1409 == 11, F.col("source_id") + (8 - F.col("radar_ordinal")) * 80).otherwise(F.col("source_id")),
        "radar_ordinal": some(s % 1409 == 11, 8).otherwise(F.col("radar_ordinal")), "range_band": some(s % 1601 == 17, 2).otherwise(F.col("range_band")), "moment_id": some(s % 1511 == 13, 5).otherwise(0),
        "batch_bytes": size + some(b % 17 == 0, 3).otherwise(0), "word_size": F.lit(8), "schema_version": some(b % 23 == 22, 2).otherwise(1), "universe_version": some(b % 29 == 1, 2).otherwise(1), "dictionary_version": some(b % 31 == 2, 2).otherwise(1)})


CHECK_SQL = f"""{V_STREAM}, z AS (SELECT *, CASE WHEN event_seq % 997 = 0 THEN message_ticks - 500000000000 ELSE message_ticks END AS t, CASE WHEN event_seq % 1009 = 5 THEN gate_count + 1 ELSE gate_count END AS pl,
CASE WHEN event_seq % 1201 = 7 THEN 720 WHEN event_seq % 1301 = 9 THEN (source_id + 1) % 640 WHEN event_seq % 1409 = 11 THEN source_id + (8 - radar_ordinal) * 80 ELSE source_id END AS sid, CASE WHEN event_seq % 1709 = 19 THEN 100000 WHEN event_seq % 1801 = 23 THEN 1 ELSE 0 END AS shift,
CASE WHEN event_seq % 1601 = 17 THEN NULL WHEN event_seq % 1409 = 11 THEN source_id + (8 - radar_ordinal) * 80 ELSE source_id END AS key,
CASE WHEN batch_seq % 23 = 22 THEN 'UnsupportedStreamSchemaVersion' WHEN batch_seq % 29 = 1 THEN 'SourceUniverseVersionMismatch' END AS header FROM v)"""


@query(f"""WITH {CHECK_SQL},
w AS (SELECT *, row_number() OVER o - 1 AS i, lag(t) OVER o AS pt, coalesce(sum(gate_count) OVER o - gate_count, 0) + shift AS po, coalesce(sum(pl) OVER o - pl, 0) AS eo, sum(gate_count) OVER (PARTITION BY batch_seq) + CASE WHEN batch_seq % 17 = 0 THEN 3 ELSE 0 END AS bytes FROM z WINDOW o AS (PARTITION BY batch_seq ORDER BY event_seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN t < pt THEN 'ChronologyOrderViolation' WHEN pl <> gate_count THEN 'PayloadLengthMismatch' WHEN po > bytes - pl THEN 'PayloadReferenceOutsidePayload' WHEN po <> eo THEN 'PayloadReferenceNotContiguous' WHEN sid > 719 THEN 'SourceIdOutsideUniverse' WHEN key IS NULL THEN 'SourceKeyOutsideUniverse' WHEN sid <> key THEN 'SourceKeyMismatch'
WHEN event_seq % 1409 = 11 THEN 'RadarOrdinalOutsideDictionary' WHEN event_seq % 1511 = 13 THEN 'MomentIdOutsideDictionary' END AS rule FROM w),
e AS (SELECT batch_seq, coalesce(max(header), CASE WHEN batch_seq % 31 = 2 THEN 'DictionarySnapshotVersionMismatch' END) AS header, min(i) FILTER (WHERE rule IS NOT NULL) AS fi, min_by(rule, i) FILTER (WHERE rule IS NOT NULL) AS fr, sum(pl) <> max(bytes) AS tail FROM r GROUP BY 1)
SELECT batch_seq, coalesce(header, fr, CASE WHEN tail THEN 'PayloadTailNotReferenced' WHEN batch_seq % 37 = 0 THEN 'MetricsMismatch' END) AS error, CASE WHEN header IS NULL AND fi IS NOT NULL THEN fi ELSE -1 END AS event_index FROM e""")
def va1_batch_errors(spark, d):
    expected = rollups.batch_metrics(stream_events(spark, d)).withColumn("value_count", F.when(F.col("batch_seq") % 37 == 0, F.col("value_count") + 1).otherwise(F.col("value_count")))
    return validation.batch_errors(rows_to_check(spark, d), CHECKED, (8, 5), expected=expected)


@query(f"""WITH {CHECK_SQL}, y AS (SELECT *, CASE WHEN sid > 719 THEN 'SourceIdOutsideUniverse' WHEN key IS NULL OR sid <> key THEN 'SourceOwnershipMismatch' END AS own, t < lag(t) OVER (PARTITION BY batch_seq, sid ORDER BY event_seq) AS back, row_number() OVER (PARTITION BY batch_seq ORDER BY event_seq) - 1 AS i FROM z),
b AS (SELECT batch_seq, count(*) AS events, coalesce(max(header), min_by(own, event_seq) FILTER (WHERE own IS NOT NULL), CASE WHEN bool_or(back) THEN 'SourceOrderViolation' END) AS error, CAST(sum(gate_count) AS BIGINT) AS payload_values, max(header) AS header, coalesce(min(i) FILTER (WHERE own IS NOT NULL), min(i) FILTER (WHERE back)) AS i FROM y GROUP BY 1)
SELECT batch_seq, events, payload_values, error, CASE WHEN header IS NOT NULL THEN -1 ELSE i END AS event_index FROM b""")
def va2_processing_check(spark, d):
    good, bad = validation.accepted_batches(rows_to_check(spark, d), CHECKED)
    return bad.unionByName(good, allowMissingColumns=True)


@query(f"""WITH {SHAKEN_SQL}, lz AS (SELECT batch_seq, source_id, CASE WHEN event_seq % 5 = 0 THEN t - 50000000000000 ELSE t END AS t FROM z), st AS (SELECT source_id, max(t) AS m FROM z WHERE batch_seq < 2 GROUP BY 1), dl AS (SELECT batch_seq, source_id, min(t) AS first_ticks FROM lz WHERE batch_seq >= 2 GROUP BY 1, 2) SELECT batch_seq, source_id, first_ticks, m AS stored_ticks FROM dl JOIN st USING (source_id) WHERE first_ticks < m""")
def va3_commit_check(spark, d):
    z = shaken(spark, d)
    late = z.filter("batch_seq >= 2").withColumn("message_ticks", F.when(F.col("event_seq") % 5 == 0, F.col("message_ticks") - 50_000_000_000_000).otherwise(F.col("message_ticks")))
    found = validation.commit_errors(rollups.batch_deltas(late), rollups.source_rollup(z.filter("batch_seq < 2")))
    return found.select("batch_seq", "source_id", "first_ticks", "stored_ticks")


@query(f"""WITH {V_STREAM}, x AS (SELECT batch_seq, count(*) AS n, CAST(sum(gate_count) AS BIGINT) AS g, CAST(sum(raw_sum) AS BIGINT) AS c FROM v GROUP BY 1) SELECT batch_seq AS sequence, CASE WHEN batch_seq % 5 = 1 THEN 'ContractVersionMismatch' WHEN batch_seq % 5 = 2 THEN 'DeltaIdMismatch' WHEN batch_seq % 5 = 3 THEN 'DuplicateField' WHEN batch_seq % 5 = 4 THEN 'SourceOutside' END AS error FROM x""")
def va5_delta_check(spark, d):
    m, k = rollups.batch_metrics(stream_events(spark, d)), F.col("batch_seq") % 5
    v = lambda s, f: F.struct(s.cast("int").alias("source_id"), F.lit(f).alias("field"), F.lit("bigint").alias("type"), F.lit(1).cast("bigint").alias("int64_value"), F.lit(None).cast("double").alias("double_value"))
    rows = m.select(F.lit("CounterChecksum").alias("handler"), F.when(k == 1, "2").otherwise("1").alias("contract_version"), F.col("batch_seq").alias("sequence"), F.lit(None).cast("string").alias("batch_id"), F.col("event_count"), F.lit(N).alias("source_count"), F.col("value_count").alias("payload_value_count"), F.col("raw_checksum").alias("input_checksum"), F.lit(1).alias("schema_version"),
                    F.array(v(F.lit(1), "a"), v(F.when(k == 4, N).when(k == 3, 1).otherwise(2), "a")).alias("values"))
    rows = rows.withColumn("delta_id", F.when(k_of("sequence") == 2, "none").otherwise(handlers.delta_id()))
    return handlers.delta_errors(rows, "CounterChecksum", "1").select("sequence", "error")


def k_of(c):
    return F.col(c) % 5


# ---- handlers ----

VALUES_SQL = f"""{V_STREAM}, w AS (SELECT source_id, count(*) AS events, CAST(sum(gate_count) AS BIGINT) AS "values", CAST(sum(raw_sum) AS BIGINT) AS raw_checksum FROM v GROUP BY 1),
u AS (SELECT source_id, 'events' AS field, events AS x FROM w UNION ALL SELECT source_id, 'values', "values" FROM w UNION ALL SELECT source_id, 'raw_checksum', raw_checksum FROM w)"""


@query(f"WITH {VALUES_SQL} SELECT source_id, 'CounterChecksum' AS handler, field, 'bigint' AS type, x AS int64_value, CAST(NULL AS DOUBLE) AS double_value FROM u")
def ud3_handler_snapshots(spark, d):
    return handlers.snapshots(stream_events(spark, d), handlers.handler_set("CounterChecksum"))


@query(f"WITH {VALUES_SQL} SELECT source_id, field, x AS int64_value FROM u ORDER BY source_id, field")
def so3_value_order(spark, d):
    return handlers.snapshots(stream_events(spark, d), [handlers.COUNTER]).select("source_id", "field", "int64_value").orderBy("source_id", "field")


def values_of(rows):
    return rows.select("handler", "source_id", "field", F.col("int64_value").alias("value"))


@query(f"WITH {VALUES_SQL} SELECT 'CounterChecksum' AS handler, source_id, field, x AS value FROM u")
def ud5_delta_merge(spark, d):
    return values_of(handlers.merged(handlers.deltas(stream_events(spark, d), handlers.handler_set("CounterChecksum"))))


@query(f"WITH {V_STREAM} SELECT source_id, count(*) AS events, CAST(sum(gate_count) AS BIGINT) AS \"values\", CAST(sum(raw_sum) AS BIGINT) AS raw_checksum FROM v GROUP BY 1")
def ud6_counter_handler(spark, d):
    s = handlers.snapshots(stream_events(spark, d), [handlers.COUNTER])
    return s.groupBy("source_id").pivot("field", list(handlers.COUNTER.fields)).agg(F.first("int64_value"))


@query()
def ud7_heavy_handler(spark, d):
    work = checksums.sampled_checksum(detailed(stream_events(spark, d)), keep="source_id")
    return handlers.snapshots(work, [handlers.HEAVY])


@query(f"WITH {V_STREAM} SELECT source_id, count(*) AS n FROM v GROUP BY 1")
def ud8_counting_handler(spark, d):
    return handlers.snapshots(stream_events(spark, d), [handlers.COUNTING]).select("source_id", F.col("int64_value").alias("n"))


@query(f"WITH {V_STREAM} SELECT source_id, 'LastValue' AS handler, 'last_raw' AS field, max_by(raw_sum, event_seq) AS int64_value FROM v GROUP BY 1")
def ud1_opaque_handler(spark, d):
    last = handlers.Handler("LastValue", {"last_raw": ("bigint", None)}, fold=handlers.Fold(lambda: 0, lambda last, f: f["raw_sum"].iloc[-1], lambda last: {"last_raw": last}), needs=("raw_sum",))
    return handlers.snapshots(stream_events(spark, d).select("source_id", "event_seq", "raw_sum"), [last]).select("source_id", "handler", "field", "int64_value")


@query(f"WITH {VALUES_SQL} SELECT 'CounterChecksum' AS handler, source_id, field, x AS value FROM u")
def ud10_apply_values(spark, d):
    new = handlers.merged(handlers.deltas(stream_events(spark, d), [handlers.COUNTER]))
    return values_of(handlers.applied(new.withColumn("int64_value", F.lit(0).cast("bigint")), new, handlers.contract(spark, [handlers.COUNTER])))


MIXED = handlers.Handler("Mixed", {"weighted": ("bigint", lambda: F.sum(F.col("raw_sum").cast("bigint") * F.col("gate_count"))), "half": ("double", lambda: F.sum(F.col("gate_count") * 0.5))}, handlers.MERGEABLE)
MIXED_SQL = f"{V_STREAM}, m AS (SELECT source_id, CAST(sum(raw_sum * gate_count) AS BIGINT) AS weighted, sum(gate_count * CAST(0.5 AS DOUBLE)) AS half FROM v GROUP BY 1), u AS (SELECT source_id, 'weighted' AS field, 'bigint' AS type, weighted AS int64_value, CAST(NULL AS DOUBLE) AS double_value FROM m UNION ALL SELECT source_id, 'half', 'double', NULL, half FROM m)"


def mixed_deltas(spark, d):
    """64-bit sums beside doubles, each in the column of its type."""
    return handlers.deltas(stream_events(spark, d), [MIXED])


@query(f"WITH {MIXED_SQL} SELECT 'Mixed' AS handler, * FROM u")
def ud5_typed_merge(spark, d):
    return handlers.merged(mixed_deltas(spark, d))


@query(f"WITH {MIXED_SQL} SELECT 'Mixed' AS handler, * FROM u")
def ud10_typed_apply(spark, d):
    new = handlers.merged(mixed_deltas(spark, d))
    return handlers.applied(new.filter("source_id % 2 = 0").withColumns({"int64_value": F.col("int64_value") - 1, "double_value": F.col("double_value") - 1}), new, handlers.contract(spark, [MIXED]))


FIXED = {"record": "0", "message": "radial_seq", "gate_start": "0", "volume_ticks": "90", "scale_bits": "1065353216", "offset_bits": "0", "word_size": "8", "status_model": "1"}
SAID = lambda fields: bytes_sql([(FIXED.get(c, c), n) for c, n in fields])
CK2_SQL = f"{V_DETAIL}, e AS (SELECT source_id, event_seq, gate_count, raw_sum, message_ticks, moment_id, {SAID(checksums.EVENT)} AS b FROM d), c AS (SELECT source_id, count(*) AS event_count, CAST(sum(gate_count) AS BIGINT) AS value_count, CAST(sum(raw_sum) AS BIGINT) AS raw_checksum, max(message_ticks) AS last_ticks, count(DISTINCT moment_id) AS moments, {fnv_sql('flatten(list(b ORDER BY event_seq))')} AS checksum FROM e GROUP BY 1)"
HEAD = bytes_sql([("1", 4), ("1", 8), ("1", 4), ("count(*)", 4), ("sum(gate_count)", 4)])


@query(f"WITH {V_DETAIL}, e AS (SELECT batch_seq, event_seq, gate_count, {SAID(checksums.METADATA)} AS b FROM d), h AS (SELECT batch_seq, {HEAD} AS head, flatten(list(b ORDER BY event_seq)) AS rest FROM e GROUP BY 1) SELECT batch_seq, {fnv_sql('head || rest')} AS checksum FROM h")
def ck1_batch_checksums(spark, d):
    return checksums.batch_checksums(detailed(stream_events(spark, d)))


@query(f"WITH {CK2_SQL} SELECT source_id, checksum FROM c")
def ck2_source_checksums(spark, d):
    return checksums.source_checksums(detailed(stream_events(spark, d)))


STATE_BYTES = bytes_sql([("source_id", 4), ("event_count", 8), ("value_count", 8), ("raw_checksum", 8), ("last_ticks", 8)]) + " || list_transform(range(8), lambda i: CAST('0x' || substr(checksum, 15 - 2 * CAST(i AS INT), 2) AS BIGINT))"


@query(f"WITH {CK2_SQL}, r AS (SELECT source_id, {STATE_BYTES} AS b FROM c) SELECT count(*) AS sources, {fnv_sql('flatten(list(b ORDER BY source_id))')} AS checksum FROM r")
def ck3_run_checksum(spark, d):
    v = detailed(stream_events(spark, d))
    return checksums.run_checksum(rollups.source_rollup(v).join(checksums.source_checksums(v), "source_id"))


@query()
def ck5_sampled_checksum(spark, d):
    return checksums.sampled_checksum(detailed(stream_events(spark, d)))


# ---- health ----

MOVES_SQL = f"{SAMPLE_SQL}, mv AS (SELECT key, seq, score, CASE WHEN seq % 4 < 2 THEN score / 10 ELSE score END AS actual FROM s), i AS (SELECT *, count(*) FILTER (WHERE actual >= score * 0.25) OVER w AS isl FROM mv WINDOW w AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)), n AS (SELECT *, count(*) FILTER (WHERE actual < score * 0.25) OVER (PARTITION BY key, isl ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ineffective FROM i)"


def moves(spark, d):
    return samples(spark, d).withColumn("expected", F.col("score")).withColumn("actual", F.when(F.col("seq") % 4 < 2, F.col("score") / 10).otherwise(F.col("score")))


@query(f"WITH {MOVES_SQL} SELECT key, seq, ineffective, CASE WHEN ineffective >= 2 THEN 'Quarantined' ELSE 'MovableHot' END AS observed FROM n")
def st9_outcomes(spark, d):
    return pressure.outcomes(moves(spark, d), "key", "seq").select("key", "seq", "ineffective", "observed")


def evidence(spark, d):
    o = pressure.outcomes(moves(spark, d), "key", "seq")
    return o.select("key", "seq", "observed", P.static_band(F.col("score"), warm=25_000.0).alias("band"), F.col("score").alias("pressure"))


@query()
def st8_health(spark, d):
    return pressure.health(evidence(spark, d), "key", "seq")


# ---- run tables ----


def stored_run(spark, d):
    folder = work_folder(spark)
    tables = runs.run_tables("run-1", 1, stream_events(spark, d), processed(spark, d), N, [handlers.COUNTER])
    runs.store(spark, tables, folder)
    return folder


@query(f"WITH {V_STREAM}, m AS (SELECT batch_seq, count(*) AS n, sum(gate_count) AS g FROM v GROUP BY 1) SELECT 'run-1' AS run_id, count(*) AS batch_count, CAST(sum(n) AS BIGINT) AS event_count, CAST(sum(g) AS BIGINT) AS value_count, CAST(1 AS BIGINT) AS version FROM m")
def qa2_latest_run(spark, d):
    return runs.latest_run(spark, stored_run(spark, d)).select("run_id", "batch_count", "event_count", "value_count", "version")


@query(f"WITH {V_STREAM} SELECT batch_seq, count(*) AS accepted_events, CASE WHEN batch_seq % 7 = 3 THEN '' WHEN batch_seq % 5 = 4 THEN 'Failed' ELSE 'Succeeded' END AS status FROM v GROUP BY 1")
def qa3_batches(spark, d):
    return runs.of_run(spark, stored_run(spark, d), "batches", "run-1").select("batch_seq", "accepted_events", "status")


@query(f"WITH s AS ({SOURCE_SQL}) SELECT CAST(i AS BIGINT) AS source_id, coalesce(event_count, 0) AS event_count, coalesce(last_ticks, 0) AS last_ticks FROM (SELECT unnest(range(0, 640)) AS i) LEFT JOIN s ON i = s.source_id")
def qa4_sources(spark, d):
    return runs.of_run(spark, stored_run(spark, d), "sources", "run-1").select("source_id", "event_count", "last_ticks")


@query(f"WITH {VALUES_SQL} SELECT source_id, x AS int64_value FROM u WHERE field = 'raw_checksum'")
def qa5_handler_values(spark, d):
    return runs.of_run(spark, stored_run(spark, d), "handler_values", "run-1", field="raw_checksum").select("source_id", "int64_value")


@query(f"WITH {V_STREAM}, m AS (SELECT DISTINCT batch_seq AS b FROM v) SELECT count(*) AS accepted, count(*) FILTER (WHERE b % 7 <> 3 AND b % 5 <> 4) AS succeeded, count(*) FILTER (WHERE b % 7 <> 3 AND b % 5 = 4) AS failed, count(*) = count(*) FILTER (WHERE b % 7 <> 3 AND b % 5 <> 4) AS complete FROM m")
def qa6_diagnostics(spark, d):
    return runs.of_run(spark, stored_run(spark, d), "diagnostics", "run-1").drop("run_id")


# ---- streams ----


def events_stream(spark, d):
    """The events as a stream: copied once into a folder of files, as the source lists folders."""
    folder = work_folder(spark)
    spark.read.parquet(f"{d}/events.parquet").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(f"{folder}/in")
    return pipeline.replay(spark, f"{folder}/in", 4), folder


def appended(folder):
    return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")


@query(SOURCE_SQL)
def st1_micro_batches(spark, d):
    stream, folder = events_stream(spark, d)
    pipeline.run_once(as_stream_events(stream), commits.committer(folder, UNIVERSE), f"{folder}/check")
    return commits.last_state(spark, folder)


@query(f"WITH {CK2_SQL} SELECT *, CAST(0 AS BIGINT) AS late FROM c")
def st2_keyed_state(spark, d):
    folder = work_folder(spark)
    detailed(stream_events(spark, d)).repartitionByRange(4, "event_seq").sortWithinPartitions("event_seq").write.parquet(f"{folder}/in")
    keyed.run_keyed(keyed.source_totals(pipeline.replay(spark, f"{folder}/in", 4)), appended(folder), f"{folder}/check")
    return windows.latest(spark.read.parquet(f"{folder}/out"), "source_id", "epoch").drop("epoch")


LATE = "sequence % 3 = 1"


@query(f"""WITH {V_STREAM}, a AS (SELECT radar_code AS handler, batch_seq AS sequence, source_id, CAST(sum(raw_sum) AS BIGINT) AS value FROM v GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT handler, sequence FROM a WHERE NOT ({LATE} AND sequence >= 20)), r AS (SELECT handler, sequence, row_number() OVER (PARTITION BY handler ORDER BY sequence) - 1 = sequence AS ok FROM s),
n AS (SELECT handler, max(sequence) + 1 AS next FROM r WHERE ok GROUP BY 1)
SELECT a.handler, source_id, next, CAST(sum(value) AS BIGINT) AS value FROM a JOIN n ON a.handler = n.handler AND sequence < next GROUP BY 1, 2, 3""")
def st6_live_release(spark, d):
    """Every third sequence comes late, some of them never: each trigger releases what has become gap-free."""
    folder = work_folder(spark)
    rows = stream_events(spark, d).groupBy(F.col("radar_code").alias("handler"), F.col("batch_seq").alias("sequence"), "source_id").agg(F.sum("raw_sum").alias("value"))
    rows = rows.select("handler", "sequence", F.concat_ws("|", "handler", "sequence").alias("delta_id"), "source_id", F.lit("raw_checksum").alias("field"), "value", F.lit("c").alias("content"))
    write = pipeline.delta_merger(folder)
    for epoch, some in enumerate((f"not ({LATE})", f"{LATE} and sequence < 20 and sequence % 2 = 0", f"{LATE} and sequence < 20")):
        write(rows.filter(some), epoch)
    return pipeline.merged_values(spark, folder).join(pipeline.cursors(spark, folder), "handler").select("handler", "source_id", "next", "value")


@query(f"""WITH RECURSIVE {SAMPLE_SQL}, q AS (SELECT key, seq, avg(score) OVER w AS score, count(*) OVER w AS samples, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM s WINDOW w AS (PARTITION BY key ORDER BY seq ROWS 7 PRECEDING)), {BAND_STEPS}
SELECT key, seq, samples, round(score, 6) AS mean_score, samples >= 3 AS eligible, {BAND_NAME} AS band FROM w""")
def st7_pressure_stream(spark, d):
    folder = work_folder(spark)
    samples(spark, d).repartitionByRange(2, "seq").write.parquet(f"{folder}/in")
    keyed.run_keyed(keyed.keyed(pipeline.replay(spark, f"{folder}/in", 2), "key", keyed.Pressure(scale=0.5)), appended(folder), f"{folder}/check")
    return spark.read.parquet(f"{folder}/out").select("key", "seq", "samples", F.round("mean_score", 6).alias("mean_score"), "eligible", "band")
