"""Workspace listings, usage metering, and reading and admitting files derived from the tables."""

from checks.registry import query, table as t
from ledgerline.operators import workspace as K
from ledgerline.runtime import scratch_path
from ledgerline.sources import files as R
from ledgerline.sources.sinks import report_to_csv, report_to_json
from ledgerline.streaming import usage as U
from pyspark.sql import functions as F


@query("workspace_owned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def owned(spark, d):
    return K.owned_by(t(spark, d, "orders"), "o_custkey", 7).select("o_orderkey", "o_totalprice")


# Every third document is taken as a cleaned copy of the one whose number is a third of its own.
@query(
    "workspace_lineage",
    """SELECT c.doc_id AS dataset_id, p.doc_id AS source_dataset_id FROM documents c JOIN documents p
    ON c.doc_id % 3 = 0 AND c.doc_id > 0 AND p.doc_id = c.doc_id // 3""",
)
def lineage(spark, d):
    docs = t(spark, d, "documents").select(
        "doc_id", F.expr("CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN doc_id div 3 END").alias("source_id")
    )
    return K.lineage(docs, "doc_id", "source_id")


@query("workspace_project_contents", "SELECT n_name, c_custkey, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey")
def project_contents(spark, d):
    projects = t(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), "n_name")
    items = t(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), "c_custkey", "c_name")
    return K.project_contents(projects, items, "project_id").drop("project_id")


@query("workspace_unassigned", "SELECT c_custkey FROM customer WHERE c_nationkey = 0")
def unassigned(spark, d):
    items = t(spark, d, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 0)").alias("project_id"))
    return K.unassigned(items, "project_id").select("c_custkey")


@query("workspace_first_messages", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def first_messages(spark, d):
    return K.first_messages(t(spark, d, "conversations"), "conv_id", "turn")


@query(
    "workspace_best_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""",
)
def best_per_group(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice")
    return K.best_per_group(done, "o_custkey", [F.col("o_totalprice"), F.col("o_orderkey")])


@query(
    "workspace_listing_total",
    """SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
def listing_total(spark, d):
    own = t(spark, d, "orders").where("o_orderstatus = 'F'")
    return K.listing(own, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", "total")


@query(
    "workspace_latest_messages",
    """SELECT conv_id % 7 AS dataset, conv_id, turn, role, md5(text) AS digest FROM conversations
    WHERE conv_id IN (SELECT max(conv_id) FROM conversations GROUP BY conv_id % 7)""",
)
def latest_messages(spark, d):
    messages = t(spark, d, "conversations")
    headers = messages.selectExpr("conv_id", "conv_id % 7 AS dataset", "conv_id * 10 AS started").distinct()
    found = K.latest_messages(headers, messages, "dataset", "started", "conv_id")
    return found.select("dataset", "conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "workspace_sums",
    "SELECT count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents",
)
def sums(spark, d):
    return K.sums(t(spark, d, "documents"), characters=F.col("n_chars"), bytes=F.octet_length("text"))


@query(
    "workspace_totals",
    """SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'events', count(*) FROM events""",
)
def totals(spark, d):
    return K.totals({n: t(spark, d, n) for n in ("customer", "orders", "events")})


@query("workspace_requests", "SELECT event_type, count(*) AS requests FROM events GROUP BY 1")
def requests(spark, d):
    return K.requests_per(t(spark, d, "events"), "event_type")


@query("workspace_failures", "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def failures(spark, d):
    return K.requests_and_failures(t(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query("workspace_overall", "SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT user_id) AS users FROM events")
def overall(spark, d):
    return K.overall_counts(t(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query("workspace_search_page", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%MER#0000000%' ORDER BY c_custkey DESC LIMIT 25 OFFSET 25")
def search_page(spark, d):
    found = K.search(t(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "MER#0000000")
    return K.page(found, [F.desc("c_custkey")], 2, 25)


@query(
    "workspace_page_after",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
)
def page_after(spark, d):
    """The third page, from the last row of the second."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = [("o_orderdate", True), ("o_orderkey", False)]
    last = K.page(rows, K.page_order(order), 2, 20).orderBy(F.col("o_orderdate"), F.desc("o_orderkey")).first()
    return K.page_after(rows, order, last.asDict() if last else None, 20)


@query("workspace_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent(spark, d):
    return K.recent(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("workspace_prefix", "SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1-')")
def prefix(spark, d):
    return K.with_prefix(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-")


_USAGE = """SELECT user_id AS "user", CAST(date_trunc('{u}', ts) AS DATE) AS period, count(*) AS requests, count(*) >= {n} AS over_limit
    FROM events WHERE event_type <> 'view' GROUP BY 1, 2"""


@query("usage_daily", _USAGE.format(u="day", n=4))
def usage_daily(spark, d):
    return K.usage(t(spark, d, "events"), "user_id", "ts", "day", 4, F.col("event_type") != "view")


@query("usage_monthly", _USAGE.format(u="month", n=80))
def usage_monthly(spark, d):
    return K.usage(t(spark, d, "events"), "user_id", "ts", "month", 80, F.col("event_type") != "view")


@query(
    "usage_stream",
    """SELECT user_id AS "user", CAST(ts AS DATE) AS period, count(*) AS requests, count(*) >= 5 AS over_limit FROM events GROUP BY 1, 2""",
)
def usage_stream(spark, d):
    return U.usage_stream(spark, d, "events.parquet", "user_id", "ts", 5)


_LOG_PARTS = 4


def _metered(spark, d):
    """The events in several files, one for each remainder of their number, metered file by file."""
    out = scratch_path(spark, "log")
    rows = t(spark, d, "events").select("event_id", "user_id", "ts")
    for part in range(_LOG_PARTS):
        rows.where(F.col("event_id") % _LOG_PARTS == part).coalesce(1).write.mode("append").parquet(f"{out}/log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/log")
    U.meter(stream, f"{out}/counts", f"{out}/checkpoint", "user_id", "ts", delay="20 days")
    return f"{out}/counts"


_LATE = f"""WITH ends AS (SELECT event_id % {_LOG_PARTS} AS b, max(ts) AS hi FROM events GROUP BY 1),
    marks AS (SELECT b, max(hi) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 20 DAY AS mark FROM ends),
    judged AS (SELECT user_id, ts, b, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM events JOIN marks ON b = event_id % {_LOG_PARTS})"""


@query(
    "usage_stream_fates",
    f"""{_LATE} SELECT count(*) AS rows_read, count(*) FILTER (NOT late) AS counted, count(*) FILTER (late) AS late, 0::BIGINT AS undated FROM judged""",
)
def usage_fates(spark, d):
    return U.fates(spark, _metered(spark, d))


@query(
    "usage_stream_late_rows",
    f"""{_LATE} SELECT user_id AS "user", CAST(ts AS DATE) AS period, count(*) AS requests, CAST(b AS BIGINT) AS batch FROM judged WHERE late GROUP BY 1, 2, 4""",
)
def usage_late(spark, d):
    return U.late_rows(spark, _metered(spark, d))


def _landed(spark, df, **options):
    path = scratch_path(spark, "landing")
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


@query(
    "file_csv_types_and_gaps",
    """SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, event_type = 'click' AS clicked, props FROM events""",
)
def csv_types(spark, d):
    path = _landed(
        spark,
        t(spark, d, "events").selectExpr(
            "event_id", "event_type", "CASE WHEN event_id % 10 = 0 THEN 'N/A' ELSE cast(user_id AS string) END AS user_id",
            "CASE WHEN event_id % 9 = 0 THEN '' ELSE cast(value AS string) END AS value", "event_type = 'click' AS clicked", "props",
        ),
    )
    return R.read_csv(spark, path)


@query("file_csv_quoted_line_breaks", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def csv_lines(spark, d):
    path = _landed(spark, t(spark, d, "conversations"), quoteAll=True)
    return R.read_csv(spark, path).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "file_preview",
    """SELECT CAST(json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus, 'o_totalprice', o_totalprice,
    'o_orderdate', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'o_orderpriority', o_orderpriority) AS VARCHAR) AS record FROM orders ORDER BY o_orderkey LIMIT 15""",
)
def preview(spark, d):
    return R.preview(t(spark, d, "orders").orderBy("o_orderkey"))


@query(
    "file_quick_profile",
    """SELECT count(*) AS row_count, 2::BIGINT AS column_count, count(*) - count(CASE WHEN event_id % 9 <> 0 THEN 1 END) AS missing_values_count,
    CAST(NULL AS BIGINT) AS duplicate_rows_count, true AS duplicate_detection_skipped FROM events""",
)
def quick_profile(spark, d):
    path = _landed(spark, t(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 9 = 0 THEN 'NA' ELSE event_type END AS kind"))
    return R.profile_file(spark, path, exact_duplicates=False)


@query(
    "file_profile",
    """SELECT count(*) AS row_count, 2::BIGINT AS column_count, count(*) - count(CASE WHEN event_id % 9 <> 0 THEN 1 END) AS missing_values_count,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, CASE WHEN event_id % 9 <> 0 THEN event_type END FROM events)) AS duplicate_rows_count,
    false AS duplicate_detection_skipped FROM events""",
)
def file_profile(spark, d):
    path = _landed(spark, t(spark, d, "events").selectExpr("user_id", "CASE WHEN event_id % 9 = 0 THEN 'NA' ELSE event_type END AS kind"))
    return R.profile_file(spark, path)


@query(
    "file_admission",
    """SELECT 'csv' AS extension, true AS accepted, CAST(NULL AS VARCHAR) AS reason, count(DISTINCT s_nationkey) AS n FROM supplier
    UNION ALL SELECT 'csv', false, 'nothing in it', count(DISTINCT s_suppkey % 7) FROM supplier
    UNION ALL SELECT 'parquet', false, 'no reader for .parquet', count(DISTINCT s_suppkey % 5) FROM supplier
    UNION ALL SELECT 'txt', false, 'no reader for .txt', count(DISTINCT s_suppkey % 3) FROM supplier""",
)
def admission(spark, d):
    """A landing folder with a file for each nation or remainder; only those that are named and filled as tables pass."""
    rows, path = t(spark, d, "supplier"), scratch_path(spark, "landing")

    def land(df, key, form, **options):
        df.repartition(key).write.partitionBy(key).options(**options).format(form).save(f"{path}/{key}")

    land(rows, "s_nationkey", "csv", header=True)
    land(rows.selectExpr("' ' AS blank", "s_suppkey % 7 AS empty"), "empty", "csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quote="")
    land(rows.withColumn("fifth", F.col("s_suppkey") % 5), "fifth", "parquet", compression="none")
    land(rows.selectExpr("s_name", "s_suppkey % 3 AS third"), "third", "text")
    return R.admit(spark, path).groupBy("extension", "accepted", "reason").agg(F.count("*").alias("n"))


@query(
    "file_stale",
    """SELECT -1 AS hours, count(DISTINCT s_nationkey) AS stale FROM supplier UNION ALL SELECT 24, 0 FROM region WHERE r_regionkey = 0""",
)
def stale(spark, d):
    """The same fresh files, one for each nation, against a limit that all of them exceed and one that none does."""
    path = scratch_path(spark, "landing")
    t(spark, d, "supplier").repartition("s_nationkey").write.partitionBy("s_nationkey").csv(path)
    found = [R.stale_files(spark, path, hours=h).agg(F.lit(h).alias("hours"), F.count("*").alias("stale")) for h in (-1, 24)]
    return found[0].union(found[1])


_ENTRIES = "SELECT 'Status ' || o_orderstatus AS {}, o_orderpriority AS {}, CAST(count(*) AS VARCHAR) AS {} FROM orders GROUP BY o_orderstatus, o_orderpriority"


def _entries(spark, d):
    """A report's long form: an entry for each status and priority."""
    counts = t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").cast("string").alias("value"))
    return counts.select(
        F.ascii("o_orderstatus").cast("long").alias("ord"), F.concat(F.lit("Status "), "o_orderstatus").alias("section"), F.col("o_orderpriority").alias("metric"), "value"
    )


@query("report_csv", _ENTRIES.format("Section", "Metric", "Value"))
def report_csv(spark, d):
    path = scratch_path(spark, "report")
    report_to_csv(_entries(spark, d), path)
    return spark.read.csv(path, header=True, escape='"')


@query("report_json", _ENTRIES.format("section", "metric", "value"))
def report_json(spark, d):
    path = scratch_path(spark, "report")
    report_to_json(_entries(spark, d), path)
    return spark.read.json(path)


@query("file_stored_bytes")
def stored_bytes(spark, d):
    return R.stored_bytes(spark, _landed(spark, t(spark, d, "supplier")))
