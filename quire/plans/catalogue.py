"""Queries over the test tables: ledger, storage, layout, fragments, text, operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import errors, fragments, layout, ledger, storage
from quire.plans.tables import ERROR_LOG, NOW, error_log, read

SINCE = "TIMESTAMP '1997-06-01 00:00:00'"
KINDS = "CASE WHEN o_orderpriority LIKE '1%' THEN 'free_offer' WHEN o_orderpriority LIKE '2%' THEN 'credits' WHEN o_orderpriority LIKE '3%' THEN 'plan' ELSE 'legacy' END"
USAGE_SQL = f"usage AS (SELECT o_orderkey AS usage_id, o_custkey AS user_id, 1 + o_orderkey % 5 AS pages, {KINDS} AS kind, o_orderstatus = 'P' AS refunded, o_orderdate AS created_at FROM orders)"
#: Fixed plan dimension of the test data: monthly pages by plan, null as unlimited.
PLANS = [("AUTOMOBILE", 5), ("BUILDING", 20), ("FURNITURE", None), ("MACHINERY", 50), ("HOUSEHOLD", 1)]
PLANS_SQL = "plans AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {'NULL' if n is None else n}::BIGINT)" for p, n in PLANS) + ") t(plan, monthly_pages))"
BOXES_SQL = "boxes AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box_id, ((l_partkey * 7) % 540)::DOUBLE AS x0, ((l_suppkey * 13 + l_linenumber * 17) % 720)::DOUBLE AS y0, ((l_partkey * 7) % 540) + l_quantity AS x1, ((l_suppkey * 13 + l_linenumber * 17) % 720) + 8.0::DOUBLE AS y1 FROM lineitem)"
LINES_SQL = "lines AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS seq, unnest(string_split(text, chr(10))) AS text FROM documents)"
FILES_SQL = "files AS (SELECT substr(sha256(text), 1, 12) AS root, doc_id::VARCHAR AS path, n_chars AS size, doc_id AS mtime FROM documents)"
PAIRS_SQL = "pairs AS (SELECT a.conv_id AS doc_id, a.turn, a.text AS source, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def usage(s, d):
    return read(s, d, "orders").selectExpr("o_orderkey AS usage_id", "o_custkey AS user_id", "1 + o_orderkey % 5 AS pages", f"{KINDS} AS kind", "o_orderstatus = 'P' AS refunded", "o_orderdate AS created_at")


def users(s, d):
    return read(s, d, "customer").selectExpr("c_custkey AS user_id", "c_mktsegment AS plan")


def plans(s):
    return s.createDataFrame(PLANS, "plan string, monthly_pages long")


def boxes(s, d):
    x, y = "(l_partkey * 7) % 540", "(l_suppkey * 13 + l_linenumber * 17) % 720"
    return read(s, d, "lineitem").selectExpr("l_orderkey AS page", "l_orderkey * 10 + l_linenumber AS box_id", f"double({x}) AS x0", f"double({y}) AS y0", f"{x} + l_quantity AS x1", f"double({y}) + 8 AS y1")


def files(s, d):
    return read(s, d, "documents").select(T.content_hash(F.col("text")).alias("root"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))


def pairs(s, d):
    c = read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    b = c.where("role = 'assistant'").select("doc_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return c.where("role = 'user'").join(b, ["doc_id", "turn"]).select("doc_id", "turn", F.col("text").alias("source"), "target")


def doc_lines(s, d):
    return fragments.lines(read(s, d, "documents"))


def even(s, d):
    return doc_lines(s, d).where("seq % 2 = 0")


def zone_payments(s, d):
    n = read(s, d, "nation").selectExpr("n_nationkey", "CASE n_regionkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS zone")
    c = read(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = usage(s, d).join(c, F.col("user_id") == F.col("c_custkey"))
    unit = F.when(F.col("zone") == "A", 50).when(F.col("zone") == "B", 30).otherwise(20)
    return o.withColumns({"unit": unit, "least": F.lit(100)}).select("usage_id", "zone", ledger.billable(F.col("pages"), F.col("unit"), F.col("least")).alias("billed"), (ledger.billable(F.col("pages"), F.col("unit"), F.col("least")) * F.col("unit")).alias("amount"))


def parity(s, d):
    n = read(s, d, "nation").select(F.substring("n_name", 1, 1).alias("k")).distinct().withColumn("a", F.lit(True))
    r = read(s, d, "region").select(F.substring("r_name", 1, 1).alias("k")).distinct().withColumn("b", F.lit(True))
    return n.join(r, "k", "full_outer").where("a is null or b is null").select("k", F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("what"))


def expired(s, d):
    o = read(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("paid_at"))
    end = F.col("paid_at") + F.make_ym_interval(F.lit(0), F.lit(3))
    return o.select(F.col("o_custkey").alias("user_id"), F.when(end <= F.expr(NOW), "free").otherwise("paid").alias("plan"))


def key_col():
    return F.trim(F.regexp_replace(T.strip_tags(F.col("text")), r"[ \t\r]+", " "))


QUERIES = {
    "error_group_total": (lambda s, d: error_log(s, d).agg(F.countDistinct("fingerprint").alias("n")), f"WITH {ERROR_LOG} SELECT count(DISTINCT fingerprint) AS n FROM error_log"),
    "log_filter": (lambda s, d: errors.filtered(error_log(s, d), source="api", status="new", q="1").select("event_id", "message"), f"WITH {ERROR_LOG} SELECT event_id, message FROM error_log WHERE source = 'api' AND status = 'new' AND message ILIKE '%1%'"),
    "log_export": (lambda s, d: errors.newest(error_log(s, d), 5000).select("event_id", "source", "level", "message"), f"WITH {ERROR_LOG} SELECT event_id, source, level, message FROM error_log ORDER BY created_at DESC, event_id DESC LIMIT 5000"),
    "mark_handled": (lambda s, d: errors.mark_handled(error_log(s, d), F.col("level") == "error").select("event_id", "status"), f"WITH {ERROR_LOG} SELECT event_id, CASE WHEN level = 'error' AND status = 'new' THEN 'handled' ELSE status END AS status FROM error_log"),
    "log_delete_guard": (lambda s, d: errors.deletable(error_log(s, d)), f"WITH {ERROR_LOG} SELECT fingerprint, count(*) AS n FROM error_log GROUP BY 1 HAVING count_if(status = 'new') = 0"),
    "truncate_msg": (lambda s, d: read(s, d, "documents").select("doc_id", T.truncated(F.col("text"), 2000).alias("text")), "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…[tronqué]' ELSE text END AS text FROM documents"),
    "json_context": (lambda s, d: read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "pages_used": (lambda s, d: ledger.pages_used(usage(s, d), F.expr(SINCE)), f"WITH {USAGE_SQL} SELECT user_id, coalesce(sum(pages) FILTER (WHERE created_at >= {SINCE} AND NOT refunded AND kind <> 'credits'), 0)::BIGINT AS pages_used FROM usage GROUP BY 1"),
    "free_offer": (lambda s, d: ledger.free_offer_used(usage(s, d), F.expr(SINCE)), f"WITH {USAGE_SQL} SELECT user_id, count(*) AS n FROM usage WHERE created_at >= {SINCE} AND kind IN ('free_offer', 'legacy') GROUP BY 1"),
    "usage_summary": (lambda s, d: ledger.summary(users(s, d), ledger.pages_used(usage(s, d), F.expr(SINCE)), plans(s)), f"WITH {USAGE_SQL}, {PLANS_SQL}, used AS (SELECT user_id, coalesce(sum(pages) FILTER (WHERE created_at >= {SINCE} AND NOT refunded AND kind <> 'credits'), 0) AS n FROM usage GROUP BY 1) SELECT c_custkey AS user_id, c_mktsegment AS plan, monthly_pages AS quota, coalesce(n, 0)::BIGINT AS pages_used, CASE WHEN monthly_pages IS NOT NULL THEN greatest(0, monthly_pages - coalesce(n, 0))::BIGINT END AS remaining FROM customer LEFT JOIN plans ON plan = c_mktsegment LEFT JOIN used ON user_id = c_custkey"),
    "refund_ledger": (lambda s, d: ledger.refund_ledger(usage(s, d)), f"WITH {USAGE_SQL} SELECT user_id, sum(pages)::BIGINT AS pages_back, coalesce(sum(pages) FILTER (WHERE kind = 'credits'), 0)::BIGINT AS credits_back FROM usage WHERE refunded GROUP BY 1"),
    "billable_pages": (zone_payments, f"WITH {USAGE_SQL}, z AS (SELECT usage_id, pages, CASE n_regionkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS zone, CASE n_regionkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 30 ELSE 20 END AS unit FROM usage JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT usage_id, zone, greatest(pages, ceil(100.0 / unit))::BIGINT AS billed, greatest(pages, ceil(100.0 / unit))::BIGINT * unit AS amount FROM z"),
    "credit_once": (lambda s, d: ledger.credit_once(read(s, d, "events").selectExpr("user_id AS payment_id", "event_id AS notice_id", "ts AS at", "event_type = 'purchase' AS ok")).select("payment_id", "notice_id"), "SELECT user_id AS payment_id, event_id AS notice_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1"),
    "expire_plans": (expired, f"SELECT o_custkey AS user_id, CASE WHEN max(o_orderdate) + INTERVAL 3 MONTH <= {NOW} THEN 'free' ELSE 'paid' END AS plan FROM orders GROUP BY 1"),
    "lru_evict": (lambda s, d: storage.lru_evict(files(s, d), 1_000_000), f"WITH {FILES_SQL} SELECT path, size, mtime FROM (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY mtime, size, path) - size AS before FROM files) WHERE total - before > 1000000"),
    "orphan_roots": (lambda s, d: storage.orphans(files(s, d), files(s, d).where("mtime % 3 = 0")), f"WITH {FILES_SQL} SELECT root, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM files WHERE root NOT IN (SELECT root FROM files WHERE mtime % 3 = 0) GROUP BY 1"),
    "root_refs": (lambda s, d: files(s, d).groupBy("root").agg(F.count("*").alias("n")), f"WITH {FILES_SQL} SELECT root, count(*) AS n FROM files GROUP BY 1"),
    "content_hash": (lambda s, d: read(s, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h")), "SELECT doc_id, substr(sha256(text), 1, 12) AS h FROM documents"),
    "strip_tags": (lambda s, d: doc_lines(s, d).select("doc_id", "seq", T.strip_tags(F.concat(F.lit("[["), "seq", F.lit("]]"), "text", F.lit("[[/"), "seq", F.lit("]]"))).alias("text")), f"WITH {LINES_SQL} SELECT doc_id, seq, regexp_replace('[[' || seq || ']]' || text || '[[/' || seq || ']]', '\\[\\[/?\\d+\\]\\]', '', 'g') AS text FROM lines"),
    "inject_apply": (lambda s, d: fragments.inject(doc_lines(s, d), even(s, d).withColumn("text", F.concat(F.lit("T:"), "text"))), f"WITH {LINES_SQL} SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN 'T:' || text ELSE text END AS text FROM lines"),
    "resume_remaining": (lambda s, d: fragments.remaining(doc_lines(s, d), even(s, d)), f"WITH {LINES_SQL} SELECT * FROM lines WHERE seq % 2 = 1"),
    "doc_memory": (lambda s, d: fragments.memory(doc_lines(s, d), key_col()), f"WITH {LINES_SQL} SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r]+', ' ', 'g')) AS key, min(seq) AS first_seq FROM lines GROUP BY 1, 2 HAVING key <> ''"),
    "reattach_pages": (lambda s, d: fragments.reattach(doc_lines(s, d), even(s, d), F.floor(F.col("seq") / 4)), f"WITH {LINES_SQL}, m AS (SELECT doc_id, seq // 4 AS page, EXISTS (SELECT 1 FROM lines o WHERE o.doc_id = l.doc_id AND o.text = l.text AND o.seq % 2 = 0) AS hit FROM lines l) SELECT doc_id, page::BIGINT AS page, bool_and(hit) AS whole, count(*) AS n FROM m GROUP BY 1, 2"),
    "bands": (lambda s, d: layout.bands(boxes(s, d)).groupBy("page").agg(F.max("band").alias("bands")), f"WITH {BOXES_SQL}, m AS (SELECT page, y0, max(y1) OVER (PARTITION BY page ORDER BY y0, y1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes) SELECT page, count_if(reach IS NULL OR y0 > reach)::BIGINT AS bands FROM m GROUP BY 1"),
    "bbox_union": (lambda s, d: layout.union_box(boxes(s, d), "page"), f"WITH {BOXES_SQL} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY 1"),
    "med_gw": (lambda s, d: layout.upper_median(boxes(s, d).withColumn("gw", F.col("x1") - F.col("x0")), "page", "gw"), f"WITH {BOXES_SQL} SELECT page, list_sort(list(x1 - x0))[len(list(x1 - x0)) // 2 + 1] AS median FROM boxes GROUP BY 1"),
    "right_bound": (lambda s, d: layout.right_bound(boxes(s, d), boxes(s, d)), f"WITH {BOXES_SQL} SELECT b.page, b.box_id, min(o.x0) AS bound FROM boxes b LEFT JOIN boxes o ON b.page = o.page AND o.x0 >= b.x1 AND o.y0 < b.y1 AND o.y1 > b.y0 GROUP BY 1, 2"),
    "numeric_cells": (lambda s, d: read(s, d, "part").select("p_partkey", T.is_numeric(F.col("p_name")).alias("name"), T.is_numeric(F.concat(F.col("p_size").cast("string"), F.lit(",5 %"))).alias("size")), "SELECT p_partkey, regexp_matches(replace(regexp_replace(trim(p_name), '[ %]', '', 'g'), ',', '.'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS name, true AS size FROM part"),
    "valid_sheet_names": (lambda s, d: read(s, d, "part").select("p_partkey", T.valid_sheet_name(F.col("p_type")).alias("ok")), "SELECT p_partkey, length(p_type) BETWEEN 1 AND 31 AND NOT regexp_matches(p_type, '[:\\\\/?*\\[\\]'']') AS ok FROM part"),
    "avail_width": (lambda s, d: layout.neighbours(read(s, d, "lineitem").selectExpr("l_suppkey AS sheet", "l_orderkey AS r", "l_linenumber AS c", "l_returnflag = 'N' AS o").groupBy("sheet", "r", "c").agg(F.bool_or("o").alias("occupied"))).select("sheet", "r", "c", "left", "right"), 'WITH c AS (SELECT l_suppkey AS sheet, l_orderkey AS r, l_linenumber AS c, bool_or(l_returnflag = \'N\') AS occupied FROM lineitem GROUP BY 1, 2, 3) SELECT sheet, r, c, max(CASE WHEN occupied THEN c END) OVER (PARTITION BY sheet, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "left", min(CASE WHEN occupied THEN c END) OVER (PARTITION BY sheet, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS "right" FROM c'),
    "user_search": (lambda s, d: read(s, d, "customer").where(F.col("c_name").ilike("%1%") | F.col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%build%'"),
    "user_page": (lambda s, d: read(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(50).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 20"),
    "key_parity": (parity, "WITH n AS (SELECT DISTINCT substr(n_name, 1, 1) AS k FROM nation), r AS (SELECT DISTINCT substr(r_name, 1, 1) AS k FROM region) (SELECT k, 'missing' AS what FROM n WHERE k NOT IN (SELECT k FROM r)) UNION ALL (SELECT k, 'extra' FROM r WHERE k NOT IN (SELECT k FROM n))"),
    "token_usage": (lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens")), "SELECT event_type, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1"),
    "readable_pages": (lambda s, d: read(s, d, "pages").select("page_id", (F.length(F.trim(F.regexp_replace("html", "(?s)<[^>]*>", ""))) > 0).alias("readable")), "SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'gs'))) > 0 AS readable FROM pages"),
}
