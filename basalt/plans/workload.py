"""Security events made from the driver's `events` table, by arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flat columns of each record; both engines run this text. Every fiftieth event is delivered twice.
RECORDS = """
SELECT n, event_type, user_id, n % 12 AS part, n * 2 + copy AS pos, copy,
  n % 307 = 0 AS broken,
  CASE WHEN n % 97 = 0 THEN 'x' WHEN n % 193 = 0 THEN 'bad id $ here' ELSE concat('evt-', lpad(cast(n AS varchar(20)), 9, '0')) END AS event_id,
  CASE WHEN n % 211 = 0 THEN 2 ELSE 1 END AS schema_version,
  CASE WHEN n % 103 = 0 THEN 0 WHEN n % 101 = 0 THEN 4242 ELSE 1 END AS event_class,
  CASE WHEN n % 223 = 0 THEN NULL WHEN n % 227 = 0 THEN timestamp '3000-01-01 00:00:00' ELSE ts END AS event_time,
  ts + interval '1' second AS observed_time,
  CASE WHEN n % 11 = 0 THEN NULL ELSE ts + (n % 600) * interval '1' second END AS ingest_time,
  n % 281 = 0 AS no_origin,
  CASE WHEN n % 229 = 0 THEN '' ELSE concat('tenant-', cast(user_id % 4 AS varchar(20))) END AS tenant_id,
  CASE WHEN n % 233 = 0 THEN '../etc/passwd' ELSE concat('agent-', cast(user_id % 16 AS varchar(20))) END AS agent_id,
  CASE WHEN n % 313 = 0 THEN repeat('h', 256) ELSE concat(CASE WHEN n % 2 = 0 THEN 'HOST-' ELSE 'host-' END, cast(user_id AS varchar(20)), CASE WHEN n % 2 = 0 THEN '.' ELSE '' END) END AS hostname,
  CASE WHEN n % 239 = 0 THEN 'not-an-ip' ELSE concat('10.1.', cast(user_id % 250 AS varchar(20)), '.7') END AS host_ip,
  CASE WHEN n % 317 = 0 THEN repeat('o', 129) WHEN n % 3 = 0 THEN ' Linux ' ELSE 'linux' END AS os,
  CASE WHEN n % 331 = 0 THEN repeat('a', 33) WHEN n % 4 = 0 THEN 'AMD64' ELSE 'amd64' END AS architecture,
  CASE WHEN n % 241 = 0 THEN '' ELSE 'ssh.authlog' END AS collector,
  n AS seq,
  concat('batch-', cast(cast(floor(n / 100) AS bigint) AS varchar(20))) AS batch_id,
  n % 277 = 0 AS no_body,
  CASE WHEN n % 251 = 0 THEN 0 ELSE 1 END AS activity,
  CASE WHEN n % 257 = 0 THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END AS outcome,
  CASE WHEN n % 359 = 0 THEN repeat('r', 65) WHEN event_type = 'error' THEN 'failed_password' ELSE '' END AS outcome_reason,
  CASE WHEN n % 337 = 0 THEN repeat('m', 33) WHEN n % 3 = 0 THEN 'PASSWORD' ELSE 'password' END AS method,
  CASE WHEN n % 347 = 0 THEN repeat('u', 257) ELSE concat(CASE WHEN n % 5 = 0 THEN ' ' ELSE '' END, 'user-', cast(user_id AS varchar(20))) END AS user_name,
  CASE WHEN n % 367 = 0 THEN repeat('d', 256) WHEN n % 6 = 0 THEN 'ACME' ELSE 'acme' END AS user_domain,
  CASE WHEN n % 349 = 0 THEN repeat('9', 65) ELSE cast(user_id AS varchar(20)) END AS user_uid,
  CASE WHEN n % 353 = 0 THEN repeat('s', 65) ELSE 'sshd' END AS service_name,
  CASE WHEN n % 373 = 0 THEN repeat('p', 33) WHEN n % 7 = 0 THEN 'SSH' ELSE 'ssh' END AS protocol,
  CASE WHEN n % 17 = 0 THEN concat('2001:DB8::', cast(1 + user_id % 250 AS varchar(20))) ELSE concat(CASE WHEN n % 7 = 0 THEN '::ffff:' ELSE '' END, CASE WHEN n % 13 = 0 THEN '203.0.' ELSE '10.0.' END, cast(user_id % 250 AS varchar(20)), '.', cast(n % 250 AS varchar(20))) END AS source_ip,
  CASE WHEN n % 263 = 0 THEN 70000 ELSE 1024 + n % 60000 END AS source_port,
  CASE WHEN n % 5 = 0 THEN 0 WHEN n % 269 = 0 THEN 7 ELSE 1 END AS transport,
  CASE WHEN n % 271 = 0 THEN repeat('r', 4097) ELSE 'Failed password for root' END AS raw_record
FROM (
  SELECT event_id AS n, ts, user_id, event_type, 0 AS copy FROM events
  UNION ALL
  SELECT event_id AS n, ts, user_id, event_type, 1 AS copy FROM events WHERE event_id % 50 = 0) AS delivered
"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times in the tables have no zone
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # the JVM only interprets longer methods; short ones for each operator take a fourth of the time
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    text = RECORDS.replace("FROM events", "FROM {events}").replace("timestamp '3000", "timestamp_ntz '3000")
    return spark.sql(text, events=events)


def nested() -> Column:
    """The contract's struct from the flat columns."""
    c, lit = F.col, F.lit
    when = lambda absent, s: F.when(~F.coalesce(c(absent), lit(False)), s)
    ip_port = lambda ip, port: F.struct(ip.alias("ip"), port.cast("long").alias("port"))
    time = F.struct(c("event_time").cast("timestamp").alias("event_time"), c("observed_time").cast("timestamp").alias("observed_time"))
    host = F.struct("hostname", c("host_ip").alias("ip"), "os", "architecture")
    origin = when("no_origin", F.struct("tenant_id", "agent_id", host.alias("host")))
    collection = F.struct("collector", lit("/var/log/auth.log").alias("source"), c("seq").cast("decimal(20,0)").alias("sequence"))
    reception = F.struct(c("ingest_time").cast("timestamp").alias("ingest_time"), lit("gateway-a").alias("gateway"), "batch_id")
    network = F.struct(
        ip_port(c("source_ip"), c("source_port")).alias("source"), ip_port(lit("198.51.100.5"), lit(22)).alias("destination"), c("transport").cast("int").alias("transport")
    )
    body = F.struct(
        c("activity").cast("int").alias("activity"),
        c("outcome").cast("int").alias("outcome"),
        "outcome_reason",
        "method",
        F.struct(c("user_name").alias("name"), c("user_domain").alias("domain"), c("user_uid").alias("uid")).alias("user"),
        F.struct(c("service_name").alias("name"), "protocol").alias("service"),
        network.alias("network"),
        "raw_record",
    )
    return F.struct(
        "event_id",
        c("schema_version").cast("long").alias("schema_version"),
        c("event_class").cast("int").alias("event_class"),
        time.alias("time"),
        origin.alias("origin"),
        collection.alias("collection"),
        reception.alias("reception"),
        when("no_body", body).alias("authentication"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, partition, offset, undecodable (one in 307) and the event of every delivered record."""
    event = F.when(~F.col("broken"), nested())
    keep = ["n", "event_type", "user_id", F.col("part").cast("int").alias("partition"), F.col("pos").alias("offset"), F.col("broken").alias("undecodable")]
    # exploding an array of one makes the event an attribute, as it is when read from a table
    made = flat(spark, sf_dir).select(*keep, event.alias("_made"))
    return made.withColumn("event", F.explode(F.array("_made"))).drop("_made")
