"""Queries over the test tables: log groups, tickets, jobs, prices, storage and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ledger
from quire.plans.catalogue import FILES_SQL, USAGE_SQL, files, usage
from quire.plans.tables import ERROR_LOG, error_log, read



def occurrences(s, d):
    e = error_log(s, d)
    return e.where("source = 'api' AND level = 'error'").orderBy(F.desc("created_at"), F.desc("event_id")).limit(500).select("event_id", "fingerprint")


def ticket_counts(s, d):
    hit = F.col("event_type").ilike("%c%") | F.col("props").ilike("%7%")
    return read(s, d, "events").agg(F.count("*").alias("total"), F.count_if(hit).alias("found"), F.count_if(F.col("user_id") % 2 == 0).alias("open"))


def jobs(s, d):
    """Jobs that were at work when the service stopped fail, and their pages go back."""
    return usage(s, d).where("refunded").select(F.col("usage_id").alias("job_id"), F.lit("error").alias("status"), "user_id", F.col("pages").cast("long").alias("pages_back"))


def storage_release(s, d):
    used = files(s, d).groupBy("root").agg(F.sum("size").alias("used"), F.sum(F.when(F.col("mtime") % 2 == 0, F.col("size"))).alias("gone"))
    return used.select("root", F.greatest(F.lit(0).cast("long"), F.col("used") - F.coalesce("gone", F.lit(0))).alias("left"))


def clear_access(s, d):
    paid = F.col("c_mktsegment") != "HOUSEHOLD"
    o = read(s, d, "orders").join(read(s, d, "customer").select("c_custkey", paid.alias("plan_paid")), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", (F.col("plan_paid") | (F.col("o_orderstatus") == "F")).alias("clear"))


def paid_backfill(s, d):
    paid = read(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return read(s, d, "customer").join(paid, F.col("c_custkey") == F.col("k"), "left_semi").select("c_custkey", F.lit(True).alias("paid"))


QUERIES = {
    "group_occurrences": (occurrences, f"WITH {ERROR_LOG} SELECT event_id, fingerprint FROM error_log WHERE source = 'api' AND level = 'error' ORDER BY created_at DESC, event_id DESC LIMIT 500"),
    "log_targets": (lambda s, d: error_log(s, d).where((F.col("event_id") % 7).isin(1, 3) & F.substring("fingerprint", 1, 1).isin("a", "b", "0")).select("event_id", "fingerprint"), f"WITH {ERROR_LOG} SELECT event_id, fingerprint FROM error_log WHERE event_id % 7 IN (1, 3) AND substr(fingerprint, 1, 1) IN ('a', 'b', '0')"),
    "ticket_search": (lambda s, d: read(s, d, "events").where(F.col("event_type").ilike("%c%") | F.col("props").ilike("%7%")).select("event_id"), "SELECT event_id FROM events WHERE event_type ILIKE '%c%' OR props ILIKE '%7%'"),
    "ticket_counts": (ticket_counts, "SELECT count(*) AS total, count_if(event_type ILIKE '%c%' OR props ILIKE '%7%')::BIGINT AS found, count_if(user_id % 2 = 0)::BIGINT AS open FROM events"),
    "my_documents": (lambda s, d: read(s, d, "orders").orderBy("o_custkey", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey"),
    "reconcile_jobs": (jobs, f"WITH {USAGE_SQL} SELECT usage_id AS job_id, 'error' AS status, user_id, pages::BIGINT AS pages_back FROM usage WHERE refunded"),
    "usage_backfill": (lambda s, d: read(s, d, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderkey") % 5, F.lit(0)), F.lit(1)).cast("long").alias("pages"), (F.col("o_orderstatus") == "P").alias("refunded")), "SELECT o_orderkey, coalesce(nullif(o_orderkey % 5, 0), 1)::BIGINT AS pages, o_orderstatus = 'P' AS refunded FROM orders"),
    "payment_lookup": (lambda s, d: read(s, d, "orders").where("o_orderkey = 7 OR o_custkey = 7").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 OR o_custkey = 7"),
    "paid_backfill": (paid_backfill, "SELECT c_custkey, true AS paid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "storage_release": (storage_release, f"WITH {FILES_SQL} SELECT root, greatest(0, sum(size) - coalesce(sum(size) FILTER (WHERE mtime % 2 = 0), 0))::BIGINT AS \"left\" FROM files GROUP BY 1"),
    "clear_access": (clear_access, "SELECT o_orderkey, c_mktsegment <> 'HOUSEHOLD' OR o_orderstatus = 'F' AS clear FROM orders JOIN customer ON o_custkey = c_custkey"),
    "bill_pages": (lambda s, d: read(s, d, "documents").select("doc_id", F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor(F.col("n_chars") / 1800), F.lit(1))).alias("pages")), "SELECT doc_id, greatest(1, coalesce(floor(n_chars / 1800), 1))::BIGINT AS pages FROM documents"),
    "cell_ref": (lambda s, d: read(s, d, "part").select("p_partkey", T.column_number(F.concat(F.char(F.lit(65) + F.col("p_partkey") % 26), F.char(F.lit(65) + F.col("p_size") % 26), F.col("p_size").cast("string"))).alias("c")), "SELECT p_partkey, (p_partkey % 26 + 1) * 26 + p_size % 26 + 1 AS c FROM part"),
    "sanitize_name": (lambda s, d: read(s, d, "pages").select("page_id", T.file_name(F.col("url")).alias("name")), "SELECT page_id, CASE WHEN replace(n, '_', '') = '' THEN 'document' ELSE n END AS name FROM (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}]', '_', 'g'), '_+', '_', 'g'), 1, 50) AS n FROM pages)"),
}
