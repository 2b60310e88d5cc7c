"""Queries of rules over time: throttles, alerts, queues, jobs, previews; and of page geometry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import folds
from quire.plans.catalogue import BOXES_SQL, FILES_SQL, boxes, files
from quire.plans.tables import read

EVENTS_SQL = "e AS (SELECT *, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def events(s, d):
    return read(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)


def spaced_sql(gap: float, always: str = "false", key: str = "user_id") -> str:
    """Recursive form of folds.spaced over table e (key, rn, t)."""
    ok = f"(e.t - f.last >= {gap} OR {always})"
    return f"f AS (SELECT {key}, rn, event_id, t AS last, true AS allowed FROM e WHERE rn = 1 UNION ALL SELECT e.{key}, e.rn, e.event_id, CASE WHEN {ok} THEN e.t ELSE f.last END, {ok} FROM f JOIN e ON e.{key} = f.{key} AND e.rn = f.rn + 1)"


def resend_throttle(s, d):
    out = folds.fold(events(s, d).select("user_id", "event_id", "ts", "t"), ["user_id"], ["ts", "event_id"], folds.spaced("t", 45 * 60), "allowed boolean", ["allowed"])
    return out.select("event_id", "user_id", "allowed")


def throttle(s, d):
    """Progress reports of a job: written every so often, and the last one always."""
    n = F.count("*").over(W.partitionBy("user_id"))
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(s, d).select("user_id", "event_id", "ts", "t", (n == rn).alias("last"))
    return folds.fold(e, ["user_id"], ["ts", "event_id"], folds.spaced("t", 7200, "last"), "allowed boolean", ["allowed"]).where("allowed").select("user_id", "event_id")


def alert_cooldown(s, d):
    """Of each source's log: an alert whenever 50 entries or more are unhandled and the last alert is an hour back."""
    w = W.partitionBy("source").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = events(s, d).withColumn("source", F.element_at(F.array(*map(F.lit, ("frontend", "backend", "api"))), (F.col("event_id") % 3 + 1).cast("int"))).withColumn("open", F.count_if(F.col("user_id") % 2 == 0).over(w)).where("open >= 50")
    return folds.fold(e.select("source", "event_id", "ts", "t", "open"), ["source"], ["ts", "event_id"], folds.spaced("t", 3600), "alert boolean", ["alert"]).where("alert").select("source", "event_id", "open")


ALERT_SQL = f"""WITH RECURSIVE a AS (SELECT event_id, ts, epoch_us(ts) / 1000000 AS t, CASE event_id % 3 WHEN 0 THEN 'frontend' WHEN 1 THEN 'backend' ELSE 'api' END AS source, user_id FROM events),
o AS (SELECT *, count_if(user_id % 2 = 0) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS open FROM a), e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS rn FROM o WHERE open >= 50),
{spaced_sql(3600, key='source')} SELECT f.source, f.event_id, open::BIGINT AS open FROM f JOIN e USING (event_id) WHERE allowed"""


def drops(s, d):
    """Falls between consecutive readings, summed over the last 24 hours at each reading."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(s, d).withColumn("fall", F.greatest(F.coalesce(F.lag("value").over(w) - F.col("value"), F.lit(0.0)), F.lit(0.0)))
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def balance_alerts(s, d):
    """A low balance alerts once until it has recovered; a high spending of 24 hours once in 24 hours."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    day = W.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    e = drops(s, d).withColumns({"low": (F.col("value") < 50) & ~F.coalesce(F.lag("value").over(w) < 50, F.lit(False)), "spent": F.round(F.sum("fall").over(day), 4)})
    low = e.where("low").select("user_id", "event_id", F.lit("balance").alias("kind"))
    high = folds.fold(e.where("spent > 200").select("user_id", "event_id", "ts", "t"), ["user_id"], ["ts", "event_id"], folds.spaced("t", 86_400), "alert boolean", ["alert"])
    return low.union(high.where("alert").select("user_id", "event_id", F.lit("spending")))


BALANCE_SQL = f"""WITH RECURSIVE r AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) / 1000000 AS t, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, round(sum(greatest(coalesce(before - value, 0), 0)) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS spent FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM s WHERE spent > 200), {spaced_sql(86400)}
SELECT user_id, event_id, 'balance' AS kind FROM r WHERE value < 50 AND NOT coalesce(before < 50, false) UNION ALL SELECT user_id, event_id, 'spending' FROM f WHERE allowed"""


def spend_24h(s, d):
    """Spending of the 24 hours up to each account's last reading: falls only; a rise is a top-up."""
    last = F.max("us").over(W.partitionBy("user_id"))
    return drops(s, d).withColumn("last", last).where("us >= last - 86400000000").groupBy(F.col("user_id").alias("account")).agg(F.round(F.sum("fall"), 4).alias("spent"))


SPEND_SQL = "SELECT user_id AS account, round(sum(fall), 4) AS spent FROM (SELECT user_id, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS last, greatest(coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 0), 0) AS fall FROM events) WHERE us >= last - 86400000000 GROUP BY 1"


def queue_order(s, d):
    """One queue: by priority, then by arrival. Places are counts of the blocks before, and ranks within
    a block, so that no task orders the whole queue."""
    o = read(s, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("p")).withColumn("block", F.floor(F.col("o_orderkey") / 65536))
    n = o.groupBy("p", "block").agg(F.count("*").alias("n"))  # one row for each 65,536 keys and priority
    before = n.withColumn("before", F.sum("n").over(W.orderBy("p", "block")) - F.col("n")).select("p", "block", "before")
    rank = F.row_number().over(W.partitionBy("p", "block").orderBy("o_orderkey"))
    return o.join(before, ["p", "block"]).select("o_orderkey", (F.col("before") + rank).alias("place"))


def latest_per_user(s, d):
    """Each user's newest code that is not used yet."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(s, d, "events").where("event_type <> 'purchase'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "event_type")


def job_ttl(s, d):
    """Jobs still held: finished half an hour ago at most, and none older than a day."""
    e = events(s, d)
    now = e.agg(F.max("t").alias("now"))
    finished = F.when(F.col("event_type") == "purchase", F.col("t") + 600)
    e = e.crossJoin(F.broadcast(now)).withColumn("finished", finished)  # one row
    gone = F.coalesce(F.col("now") - F.col("finished") > 1800, F.lit(False)) | (F.col("now") - F.col("t") > 86_400)
    return e.select("event_id", (~gone).alias("held"))


def cache_valid(s, d):
    """Renders that can be used: of the engine's version, and not older than the translation."""
    f = files(s, d)
    renders = f.where("mtime % 4 <> 0").select("path", F.when(F.col("mtime") % 2 == 0, "v2").otherwise("v1").alias("version"), (F.col("mtime") + F.col("mtime") % 3 - 1).alias("rendered"))
    v = renders.where("version = 'v2'")
    return f.join(v, "path", "left").select("path", F.coalesce(F.col("rendered") >= F.col("mtime"), F.lit(False)).alias("valid"))


def preview_state(s, d):
    """State of each page of a preview: the last event wins."""
    return read(s, d, "events").groupBy(F.col("user_id").alias("doc"), (F.col("event_id") % 5).alias("page")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


def sweep_report(s, d):
    """Files and bytes a sweep would delete, by kind."""
    kind = F.when(F.col("mtime") % 3 == 0, "output").when(F.col("mtime") % 3 == 1, "render").otherwise("translation")
    return files(s, d).where("mtime % 7 < 5").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots"), F.sum("size").cast("long").alias("bytes"))


def merge_bars(s, d):
    """Pieces of one row of a page become one bar unless the gap between them is over 1.2 times their height."""
    b = boxes(s, d).withColumn("line", F.floor(F.col("y0") / 4 + 0.5))
    w = W.partitionBy("page", "line").orderBy("x0", "x1", "box_id")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("new", F.when(reach.isNull() | (F.col("x0") - reach > 1.2 * (F.col("y1") - F.col("y0"))), 1).otherwise(0))
    b = b.withColumn("bar", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return b.groupBy("page", "line", "bar").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def title_or_body(s, d):
    """Body size of each page, that of most characters (of equals the first met, of those the smaller), and whether a box is larger."""
    b = read(s, d, "lineitem").selectExpr("l_orderkey AS page", "l_orderkey * 10 + l_linenumber AS box_id", "8 + l_suppkey % 5 AS size", "CAST(l_quantity AS BIGINT) AS chars")
    per = b.groupBy("page", "size").agg(F.sum("chars").alias("chars"), F.min("box_id").alias("first"))
    body = per.groupBy("page").agg(F.max_by("size", F.struct("chars", -F.col("first"), -F.col("size"))).alias("body"))
    return b.join(body, "page").groupBy("page", "box_id", "size", "body").agg(F.count("*").alias("n")).select("page", "box_id", "body", (F.col("size") > F.col("body")).alias("title"))


def para_order(s, d):
    w = W.partitionBy("page").orderBy(F.bround("y0", 1), "x0", "box_id")
    return boxes(s, d).distinct().select("page", "box_id", F.row_number().over(w).alias("place"))


def edge_clusters(s, d):
    """Left edges of a page by clusters whose first member lies at most 60 to the left."""
    out = folds.fold(boxes(s, d).select("page", "box_id", "x0"), ["page"], ["x0", "box_id"], folds.anchored("x0", 60), "cluster long", ["cluster"])
    return out.select("page", "box_id", "cluster")


def baseline_rows(s, d):
    """Text rows of a page: spans by base line, a row's next base near its last one's."""
    b = boxes(s, d).select("page", "box_id", "x0", F.col("y1").alias("base"), (F.col("box_id") % 40 + 8).cast("double").alias("size"), F.bround("y1", 1).alias("y"))
    out = folds.fold(b, ["page"], ["y", "x0", "box_id"], folds.rows_of_text("base", "size"), "line long", ["line"])
    return out.select("page", "box_id", "line")


def tag_cells(s, d):
    """The first cell of a page that holds a box's centre. Cells are a page's first two boxes, widened."""
    b = boxes(s, d)
    cells = b.where("box_id % 10 <= 2").select("page", F.col("box_id").alias("cell"), (F.col("x0") - 100).alias("a0"), (F.col("y0") - 150).alias("b0"), (F.col("x1") + 100).alias("a1"), (F.col("y1") + 150).alias("b1"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = b.join(cells, "page").where(x.between(F.col("a0"), F.col("a1")) & y.between(F.col("b0"), F.col("b1")))
    return held.groupBy("page", "box_id").agg(F.min("cell").alias("cell"))


def col_widths(s, d):
    """Width of each column of a sheet: of the first range that holds it, else the default. Ranges become
    rows by column, so that the join is one of equal keys."""
    r = read(s, d, "lineitem").selectExpr("l_suppkey AS sheet", "l_linenumber AS lo", "l_linenumber + CAST(l_quantity AS INT) % 3 AS hi", "l_quantity AS width", "l_orderkey * 10 + l_linenumber AS ord", "l_partkey")
    held = r.select("sheet", F.explode(F.sequence("lo", "hi")).alias("c"), "width", "ord", "l_partkey").groupBy("sheet", "c").agg(F.min_by("width", F.struct("ord", "l_partkey", "width")).alias("width"))
    cells = read(s, d, "supplier").select(F.col("s_suppkey").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("c"))
    return cells.join(held, ["sheet", "c"], "left").select("sheet", F.col("c").cast("long").alias("c"), F.coalesce("width", F.lit(8.43)).alias("width"))


PAGE_SQL = f"WITH RECURSIVE {BOXES_SQL}"
QUERIES = {
    "resend_throttle": (resend_throttle, f"WITH RECURSIVE {EVENTS_SQL}, {spaced_sql(2700)} SELECT event_id, user_id, allowed FROM f"),
    "throttle": (throttle, f"WITH RECURSIVE {EVENTS_SQL}, {spaced_sql(7200, 'e.rn = e.n')} SELECT user_id, event_id FROM f WHERE allowed"),
    "alert_cooldown": (alert_cooldown, ALERT_SQL),
    "balance_alerts": (balance_alerts, BALANCE_SQL),
    "spend_24h": (spend_24h, SPEND_SQL),
    "queue_order": (queue_order, "SELECT o_orderkey, row_number() OVER (ORDER BY substr(o_orderpriority, 1, 1)::INT, o_orderkey) AS place FROM orders"),
    "latest_per_user": (latest_per_user, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'purchase') WHERE rn = 1"),
    "job_ttl": (job_ttl, "WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1000000 AS t, max(epoch_us(ts) / 1000000) OVER () AS now FROM events) SELECT event_id, NOT ((event_type = 'purchase' AND now - (t + 600) > 1800) OR now - t > 86400) AS held FROM e"),
    "cache_valid": (cache_valid, f"WITH {FILES_SQL} SELECT path, mtime % 4 <> 0 AND mtime % 2 = 0 AND mtime + mtime % 3 - 1 >= mtime AS valid FROM files"),
    "preview_state": (preview_state, "SELECT user_id AS doc, event_id % 5 AS page, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1, 2"),
    "sweep_report": (sweep_report, f"WITH {FILES_SQL} SELECT CASE mtime % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'render' ELSE 'translation' END AS kind, count(*) AS n, count(DISTINCT root) AS roots, sum(size)::BIGINT AS bytes FROM files WHERE mtime % 7 < 5 GROUP BY 1"),
    "merge_bars": (merge_bars, f"WITH {BOXES_SQL}, b AS (SELECT *, floor(y0 / 4 + 0.5)::BIGINT AS line FROM boxes), r AS (SELECT *, max(x1) OVER (PARTITION BY page, line ORDER BY x0, x1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), n AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 1.2 * (y1 - y0) THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x0, x1, box_id ROWS UNBOUNDED PRECEDING)::BIGINT AS bar FROM r) SELECT page, line, bar, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM n GROUP BY 1, 2, 3"),
    "title_or_body": (title_or_body, "WITH b AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box_id, 8 + l_suppkey % 5 AS size, l_quantity::BIGINT AS chars FROM lineitem), per AS (SELECT page, size, sum(chars) AS chars, min(box_id) AS first FROM b GROUP BY 1, 2), body AS (SELECT page, arg_max(size, (chars, -first, -size)) AS body FROM per GROUP BY 1) SELECT DISTINCT page, box_id, size, body, size > body AS title FROM b JOIN body USING (page)".replace("SELECT DISTINCT page, box_id, size, body, size > body AS title FROM b JOIN body USING (page)", "SELECT page, box_id, body, size > body AS title FROM (SELECT DISTINCT page, box_id, size, body FROM b JOIN body USING (page))")),
    "para_order": (para_order, f"WITH {BOXES_SQL} SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY round_even(y0, 1), x0, box_id)::INT AS place FROM (SELECT DISTINCT * FROM boxes)"),
    "edge_clusters": (edge_clusters, f"{PAGE_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, box_id) AS rn FROM boxes), f AS (SELECT page, rn, box_id, x0 AS first, 0::BIGINT AS cluster FROM e WHERE rn = 1 UNION ALL SELECT e.page, e.rn, e.box_id, CASE WHEN e.x0 - f.first > 60 THEN e.x0 ELSE f.first END, f.cluster + CASE WHEN e.x0 - f.first > 60 THEN 1 ELSE 0 END FROM f JOIN e ON e.page = f.page AND e.rn = f.rn + 1) SELECT page, box_id, cluster FROM f"),
    "baseline_rows": (baseline_rows, f"{PAGE_SQL}, e AS (SELECT page, box_id, y1 AS base, (box_id % 40 + 8)::DOUBLE AS size, row_number() OVER (PARTITION BY page ORDER BY round_even(y1, 1), x0, box_id) AS rn FROM boxes), f AS (SELECT page, rn, box_id, base AS last, size AS first, 0::BIGINT AS line FROM e WHERE rn = 1 UNION ALL SELECT e.page, e.rn, e.box_id, e.base, CASE WHEN abs(e.base - f.last) > 0.45 * greatest(least(e.size, f.first), 1) THEN e.size ELSE f.first END, f.line + CASE WHEN abs(e.base - f.last) > 0.45 * greatest(least(e.size, f.first), 1) THEN 1 ELSE 0 END FROM f JOIN e ON e.page = f.page AND e.rn = f.rn + 1) SELECT page, box_id, line FROM f"),
    "tag_cells": (tag_cells, f"WITH {BOXES_SQL} SELECT b.page, b.box_id, min(c.box_id) AS cell FROM boxes b JOIN boxes c ON c.page = b.page AND c.box_id % 10 <= 2 AND (b.x0 + b.x1) / 2 BETWEEN c.x0 - 100 AND c.x1 + 100 AND (b.y0 + b.y1) / 2 BETWEEN c.y0 - 150 AND c.y1 + 150 GROUP BY 1, 2"),
    "col_widths": (col_widths, "WITH r AS (SELECT l_suppkey AS sheet, l_linenumber AS lo, l_linenumber + l_quantity::INT % 3 AS hi, l_quantity AS width, l_orderkey * 10 + l_linenumber AS ord, l_partkey FROM lineitem), h AS (SELECT sheet, c, arg_min(width, (ord, l_partkey, width)) AS width FROM (SELECT *, unnest(generate_series(lo, hi)) AS c FROM r) GROUP BY 1, 2) SELECT s_suppkey AS sheet, g.c, coalesce(width, 8.43) AS width FROM supplier CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS c) g LEFT JOIN h ON h.sheet = s_suppkey AND h.c = g.c"),
}
