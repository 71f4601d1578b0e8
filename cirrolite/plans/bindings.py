"""The driver's tables as radar data: stream events, gate events and archive files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import Universe
from ..functions.payload import EPOCH_TICKS, raw_sum
from ..operators.windows import payload_offsets

#: The event types of the driver's table, as moments.
MOMENTS = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")
UNIVERSE = Universe(radars=8, elevations=4, azimuths=10, bands=2)


def ticks(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(EPOCH_TICKS)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_stream_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_stream_events(events: DataFrame) -> DataFrame:
    """One row per gate run, from the columns of `events`; narrow, so it serves batch and stream alike."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("event_id", "ts", "user_id", "event_type", F.floor("value").cast("bigint").alias("v"), k.alias("k"))
    gates = F.transform(F.sequence(F.lit(0), F.col("k") % 8), lambda i: ((F.col("v") * (i + 1) + F.col("k")) % 256).cast("int"))
    rows = base.select(
        F.col("event_id").alias("event_seq"), F.floor(F.col("event_id") / 250).cast("bigint").alias("batch_seq"), ticks(F.col("ts")).alias("message_ticks"),
        F.concat(F.lit("K"), F.lpad((F.col("user_id") % 8).cast("string"), 3, "0")).alias("radar_code"), F.upper("event_type").alias("moment_name"),
        (F.col("user_id") % 8).cast("int").alias("radar_ordinal"), (F.floor(F.col("user_id") / 8) % 4).cast("int").alias("elevation_slot"),
        (F.col("k") % 10).alias("azimuth_bucket"), (F.col("event_id") % 2).cast("int").alias("range_band"), (1 + F.col("k") % 8).alias("gate_count"), gates.alias("gates"),
    )
    return rows.withColumn("source_id", UNIVERSE.encode()).withColumn("raw_sum", raw_sum(F.col("gates")))


def detailed(events: DataFrame) -> DataFrame:
    """Stream events with the columns that checksums read."""
    moment = F.array_position(F.array(*[F.lit(m) for m in MOMENTS]), F.col("moment_name")) - 1
    seq = F.row_number().over(Window.partitionBy("batch_seq").orderBy("event_seq")) - 1
    zero = F.lit(0).cast("bigint")
    return payload_offsets(events).select(
        "*", (F.col("batch_seq") * 0 + 90).alias("volume_ticks"), zero.alias("record"), seq.cast("bigint").alias("message"), seq.cast("bigint").alias("radial_seq"), moment.cast("bigint").alias("moment_id"),
        zero.alias("gate_start"), F.lit(0x3F800000).cast("bigint").alias("scale_bits"), zero.alias("offset_bits"), F.lit(8).alias("word_size"), F.lit(1).alias("status_model"))


def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per gate, with its radial's and volume's data. The orders join on their key; nothing is broadcast by hint."""
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    gate = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")) - 1
    gate = gate.cast("bigint")
    rows = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", gate.alias("gate_index"))
    moment = F.col("l_returnflag")
    scale = F.when(F.col("l_linenumber") == 7, 0.0).when(moment == "R", 1.0).otherwise(2.0).cast("float")
    return rows.join(orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") % 16).alias("volume_id"), F.col("l_orderkey").alias("radial_key"), "gate_index", F.col("o_orderdate").alias("message_ts"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("elevation_number"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("radial_status"),
        F.when(moment == "A", "REF").when(moment == "N", "VEL").otherwise("CFP").alias("moment_name"), (F.col("l_quantity").cast("int") - 1).alias("raw_value"),
        scale.alias("scale"), F.when(moment == "A", 66.0).when(moment == "N", 129.0).otherwise(8.0).cast("float").alias("offset"),
    )


def radials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per radial, straight from its order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_orderkey") % 16).alias("volume_id"), F.col("o_orderkey").alias("radial_key"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("elevation_number"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("radial_status"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    radar = F.concat(F.lit("K"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 28).cast("int"))
    name = F.concat(radar, F.date_format(day, "yyyyMMdd"), F.lit("_"), F.lpad((F.col("s_suppkey") % 24).cast("string"), 2, "0"), F.lit("0000_V06"))
    return rows.select(radar.alias("radar_id"), F.col("s_suppkey").alias("file_seq"), F.floor(F.abs("s_acctbal") * 100).cast("bigint").alias("size_bytes"),
                       F.concat_ws("/", F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd"), radar, name).alias("path"), name.alias("file_name"))


#: The same views for DuckDB.
V_STREAM = """v AS (
  SELECT event_id AS event_seq, CAST(floor(event_id / 250.0) AS BIGINT) AS batch_seq, epoch_us(ts) * 10 + 621355968000000000 AS message_ticks,
         'K' || lpad(CAST(user_id % 8 AS VARCHAR), 3, '0') AS radar_code, upper(event_type) AS moment_name, user_id % 8 AS radar_ordinal,
         CAST(floor(user_id / 8.0) AS BIGINT) % 4 AS elevation_slot, k % 10 AS azimuth_bucket, event_id % 2 AS range_band, 1 + k % 8 AS gate_count,
         (((user_id % 8) * 4 + CAST(floor(user_id / 8.0) AS BIGINT) % 4) * 10 + k % 10) * 2 + event_id % 2 AS source_id,
         CAST(list_sum([(fv * (i + 1) + k) % 256 for i in range(0, 1 + k % 8)]) AS BIGINT) AS raw_sum
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS fv FROM events)
)"""
V_GATES = """g AS (
  SELECT l_orderkey % 16 AS volume_id, l_orderkey AS radial_key,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS gate_index,
         o_orderdate AS message_ts, CAST(substr(o_orderpriority, 1, 1) AS INT) AS elevation_number, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS radial_status,
         CASE l_returnflag WHEN 'A' THEN 'REF' WHEN 'N' THEN 'VEL' ELSE 'CFP' END AS moment_name, CAST(l_quantity AS INT) - 1 AS raw_value,
         CAST(CASE WHEN l_linenumber = 7 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS FLOAT) AS scale,
         CAST(CASE l_returnflag WHEN 'A' THEN 66 WHEN 'N' THEN 129 ELSE 8 END AS FLOAT) AS "offset"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), s AS (
  SELECT *, CASE WHEN moment_name = 'CFP' AND raw_value = 0 THEN 3 WHEN moment_name = 'CFP' AND raw_value = 1 THEN 4 WHEN moment_name = 'CFP' AND raw_value = 2 THEN 5
                 WHEN moment_name = 'CFP' AND raw_value < 8 THEN 6 WHEN moment_name <> 'CFP' AND raw_value = 0 THEN 1 WHEN moment_name <> 'CFP' AND raw_value = 1 THEN 2
                 WHEN scale <> 0 THEN 0 ELSE 7 END AS status FROM g
), c AS (
  SELECT *, CASE WHEN status = 0 THEN CAST(CAST((CAST(raw_value AS DOUBLE) - "offset") / scale AS FLOAT) AS DOUBLE) END AS calibrated FROM s
)"""
V_FILES = """f AS (
  SELECT radar_id, file_seq, size_bytes, strftime(d, '%Y/%m/%d/') || radar_id || '/' || radar_id || strftime(d, '%Y%m%d') || '_' || hh || '0000_V06' AS path,
         radar_id || strftime(d, '%Y%m%d') || '_' || hh || '0000_V06' AS file_name, d, hh FROM (
    SELECT 'K' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS radar_id, s_suppkey AS file_seq, CAST(floor(abs(s_acctbal) * 100) AS BIGINT) AS size_bytes,
           DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS d, lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') AS hh
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)
)"""
V_DETAIL = f"""{V_STREAM}, d AS (
  SELECT *, row_number() OVER w - 1 AS radial_seq, list_position({list(MOMENTS)}, moment_name) - 1 AS moment_id,
         CAST(coalesce(sum(gate_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload_offset FROM v WINDOW w AS (PARTITION BY batch_seq ORDER BY event_seq)
)"""


def fnv_sql(rows: str) -> str:
    """The FNV-1a fold of a list of bytes in DuckDB, as hex."""
    return f"printf('%016x', CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), CAST({rows} AS UHUGEINT[])), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))"


def bytes_sql(fields: list[tuple[str, int]]) -> str:
    """The little-endian bytes of numbers in DuckDB."""
    return " || ".join(f"list_transform(range({n}), lambda i: (CAST({c} AS BIGINT) >> (8 * i)) & 255)" for c, n in fields)
