"""Stream and user-function queries. The log is cut into files and read back as a stream."""

from pyspark.sql import functions as F

from clickloom.catalog.aggregates import readable
from clickloom.catalog.joins import KNOWN_USERS, known_users
from clickloom.catalog.registry import query
from clickloom.functions import scalars as S
from clickloom.functions.udfs import gap_apply, map_rows
from clickloom.session import fresh_dir
from clickloom.streaming import streams as T
from clickloom.streaming.keyed import gap_profile, keyed_gaps

PARTS = 4
#: A day: an entry of state is the day of one shard of the users, of about ``ENTRY_ROWS`` rows.
GAP_BUCKET_MS, ENTRY_ROWS = 24 * S.HOUR_MS, 20_000
COUNTS = """SELECT document_id, count(*) AS tot, count(*) FILTER (platform = 1) AS platform1, count(*) FILTER (platform = 2) AS platform2,
  count(*) FILTER (platform = 3) AS platform3, min(ts) AS ts_min, max(ts) AS ts_max, round(avg(CAST(ts AS DOUBLE)) / 3600000, 4) AS ts_avg FROM page_views GROUP BY 1"""
GAPS = """SELECT uuid, tot, ts_min, ts_max, ts_avg, ts_var, CASE WHEN tot = 1 THEN 0 ELSE g_min END AS gap_min, CASE WHEN tot = 1 THEN 0 ELSE g_max END AS gap_max,
  CASE WHEN tot = 1 THEN 0 ELSE round(g_avg, 4) END AS gap_avg, CASE WHEN tot = 1 THEN 0 ELSE round(g_var, 4) END AS gap_var FROM
  (SELECT uuid, count(*) AS tot, min(ts) AS ts_min, max(ts) AS ts_max, round(avg(CAST(ts AS DOUBLE)) / 3600000, 4) AS ts_avg,
    round(var_samp(ts / 604800000.0), 4) AS ts_var, min(d) AS g_min, max(d) AS g_max, avg(CAST(d AS DOUBLE)) / 3600000 AS g_avg, var_samp(d / 604800000.0) AS g_var
   FROM (SELECT uuid, ts, ts - lag(ts) OVER (PARTITION BY uuid ORDER BY ts) AS d FROM page_views) t GROUP BY 1) u"""


def write_parts(v, root, parts):
    """Parts of the log by a hash, written one after the other: each holds rows of all times, so most are late."""
    part = F.pmod(F.xxhash64("uuid", "ts"), F.lit(PARTS))
    for p in parts:
        v.page_views.where(part == p).write.mode("append").parquet(root)


def stream_of(v, root, batches=PARTS):
    """The files as a stream of about ``batches`` batches."""
    files = len(v.spark.read.parquet(root).inputFiles())
    return T.page_view_stream(v.spark, root, -(-files // batches))


@query(
    "str_filtered_append",
    f"""SELECT uuid, document_id, platform, traffic_source, CAST(CASE split_part(geo_location, '>', 1) WHEN 'US' THEN 1 WHEN 'CA' THEN 2 WHEN 'GB' THEN 3 ELSE 4 END AS INTEGER) AS country_id, ts
        FROM page_views WHERE uuid IN ({KNOWN_USERS})""",
)
def _(v):
    root, out = fresh_dir(v.spark, "stream-in"), fresh_dir(v.spark, "stream-out")
    write_parts(v, root, range(PARTS))
    stream = stream_of(v, root)
    T.filtered_append(stream, known_users(v), S.country_group_id(S.geo_part("geo_location", 1)), out, fresh_dir(v.spark, "ckpt"))
    return v.spark.read.parquet(out)


@query("str_key_counts", COUNTS)
def _(v):
    root, out = fresh_dir(v.spark, "stream-in"), fresh_dir(v.spark, "stream-out")
    write_parts(v, root, range(PARTS))
    T.running_counts(stream_of(v, root), "document_id", out, fresh_dir(v.spark, "ckpt"))
    return readable(T.latest(v.spark, out, "document_id"))


@query("str_key_gap_state", GAPS)
def _(v):
    root, out = fresh_dir(v.spark, "stream-in"), fresh_dir(v.spark, "stream-out")
    write_parts(v, root, range(PARTS))
    # The files are dealt by a hash, so a row may come as late as the log is long; at the watermark itself it is too late.
    span, rows = v.page_views.agg(F.max("ts") - F.min("ts"), F.count("*")).first()
    shards = 1 + rows // (ENTRY_ROWS * (1 + (span or 0) // GAP_BUCKET_MS))
    delay = f"{(span or 0) + 1} milliseconds"
    keyed_gaps(stream_of(v, root), "uuid", out, fresh_dir(v.spark, "ckpt"), delay, bucket_ms=GAP_BUCKET_MS, shards=shards)
    return readable(gap_profile(v.spark, out, "uuid"))


@query("str_state_checkpoint", COUNTS)
def _(v):
    root, out, checkpoint = (fresh_dir(v.spark, n) for n in ("stream-in", "stream-out", "ckpt"))
    write_parts(v, root, range(2))
    broken = T.fail_once(1)
    T.with_restart(
        lambda: T.running_counts(stream_of(v, root, 2), "document_id", out, checkpoint, broken),
        lambda: write_parts(v, root, range(2, PARTS)),
    )
    return readable(T.latest(v.spark, out, "document_id"))


@query(
    "udf_gap_agg",
    """SELECT uuid, count(d) AS gaps, min(d)::DOUBLE AS gap_min, max(d)::DOUBLE AS gap_max, round(avg(CAST(d AS DOUBLE)) / 3600000, 4) AS gap_avg, round(var_samp(d / 604800000.0), 4) AS gap_var
       FROM (SELECT uuid, ts - lag(ts) OVER (PARTITION BY uuid ORDER BY ts) AS d FROM page_views) t GROUP BY 1 HAVING count(d) > 0""",
)
def _(v):
    def moments(gaps, counts):
        x, n = gaps.astype("float64"), counts.astype("float64")
        return [n.sum(), (x * n).sum(), (x * x * n).sum(), x.min(), x.max()]

    states = gap_apply(v.page_views, ["uuid"], "ts", moments, 5)
    s = [F.element_at("state", i) for i in range(1, 6)]
    sums = states.groupBy("uuid").agg(
        F.sum(s[0]).alias("n"), F.sum(s[1]).alias("s"), F.sum(s[2]).alias("q"), F.min(s[3]).alias("gap_min"), F.max(s[4]).alias("gap_max")
    )
    out = sums.select(
        "uuid", F.col("n").cast("bigint").alias("gaps"), "gap_min", "gap_max", (F.col("s") / F.col("n")).alias("gap_avg"),
        F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1).alias("gap_var"),
    )
    return readable(out)


@query("udf_row_map", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM lineitem")
def _(v):
    def label_and_vector(pdf):
        out = pdf[["l_orderkey", "l_linenumber"]].copy()
        out["label"] = (pdf["l_returnflag"] == "R").astype("float64")
        out["features"] = list(pdf[["l_quantity", "l_extendedprice", "l_discount", "l_tax"]].to_numpy())
        return out

    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return map_rows(rows, label_and_vector, "l_orderkey bigint, l_linenumber int, label double, features array<double>")
