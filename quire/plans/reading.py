"""Queries of reading order, lists, frames, styles, renamed sheets, answers and context."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import answers
from quire.functions import text as T
from quire.operators import folds, layout
from quire.plans.catalogue import LINES_SQL, doc_lines
from quire.plans.sheets import BOXES_SQL, LI_SQL, boxes, numbered
from quire.plans.tables import read

#: Lines at three left edges, a point apart at most; some with markers.
MARKED = [
    "l_orderkey AS page", "l_linenumber AS line_id", "double(l_partkey % 3 * 40 + l_suppkey % 2) AS left", "double(l_linenumber * 12) AS top",
    "CASE l_suppkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN concat('(', l_linenumber, ') x') WHEN 2 THEN concat(chr(int(96 + l_linenumber)), ') item') ELSE concat(' ', l_linenumber, '. item') END AS text",
]
MARKED_SQL = f"""WITH {LI_SQL}, m AS (SELECT l_orderkey AS page, l_linenumber AS line_id, l_partkey % 3 AS edge, l_suppkey % 4 = 2 AS letter FROM li WHERE l_suppkey % 4 <> 0),
n AS (SELECT *, lag(line_id) OVER w AS a, lag(letter) OVER w AS la, lead(line_id) OVER w AS b, lead(letter) OVER w AS lb FROM m WINDOW w AS (PARTITION BY page, edge ORDER BY line_id))
SELECT page, line_id FROM n WHERE coalesce(a = line_id - 1 AND la = letter, false) OR coalesce(b = line_id + 1 AND lb = letter, false)"""


def overhead(s, d):
    """Paragraphs below wide blocks; all have the page's frame."""
    b = boxes(s, d)
    blocks = b.where("box_id % 10 <= 4").selectExpr("page", "x0", "y0 - 30 AS y0", "x1 + 60 AS x1", "y1 + 20 AS y1")
    paras = b.where("box_id % 10 > 4").selectExpr("page", "box_id", "x0", "y0", "x0 + 10 AS x1", "0D AS f0", "100D AS f1")
    return layout.overhead(paras, blocks, 100.0 / 8, 1.5 * 8)


OVERHEAD_SQL = f"""WITH {BOXES_SQL}, o AS (SELECT page, x0, y0 - 30 AS y0, x1 + 60 AS x1, y1 + 20 AS y1 FROM boxes WHERE box_id % 10 <= 4), p AS (SELECT page, box_id, x0, y0, x0 + 10 AS x1 FROM boxes WHERE box_id % 10 > 4),
m AS (SELECT p.page, p.box_id, o.x0 AS ox0, o.x1 AS ox1, row_number() OVER (PARTITION BY p.page, p.box_id ORDER BY o.x1 - o.x0, o.x0) AS rn FROM p JOIN o ON p.page = o.page AND o.y1 <= p.y0 + 1 AND p.y0 - o.y1 <= 150.0 AND o.y1 - o.y0 >= 12.5 AND o.x1 - o.x0 >= 12.5 AND o.x1 - o.x0 < 100 AND o.x0 <= p.x0 + 1 AND o.x1 >= p.x1 - 1)
SELECT page, box_id, ox0, ox1 FROM m WHERE rn = 1"""


def segments(s, d):
    """Runs of a line joined where their style is the same: font without its subset's prefix, rounded size."""
    r = numbered(s, d).selectExpr("l_orderkey AS line", "l_linenumber AS seq", "concat(CASE WHEN l_suppkey % 2 = 0 THEN 'ABCDEF+' ELSE '' END, 'Font', l_partkey % 2) AS font", "10 + l_suppkey % 3 / 100D AS size", "concat(l_returnflag, l_linenumber) AS text")
    style = F.struct(F.substring_index("font", "+", -1).alias("font"), F.round("size", 1).alias("size"))
    w = W.partitionBy("line").orderBy("seq")
    r = r.withColumn("style", style).withColumn("new", F.when(F.lag("style").over(w) == F.col("style"), 0).otherwise(1))
    r = r.withColumn("segment", F.sum("new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return r.groupBy("line", "segment").agg(F.first("style.font").alias("font"), joined.alias("text"))


SEGMENTS_SQL = f"""WITH {LI_SQL}, r AS (SELECT l_orderkey AS line, l_linenumber AS seq, 'Font' || l_partkey % 2 AS font, l_returnflag || l_linenumber AS text FROM li),
n AS (SELECT *, CASE WHEN lag(font) OVER (PARTITION BY line ORDER BY seq) = font THEN 0 ELSE 1 END AS fresh FROM r), g AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY seq)::BIGINT AS segment FROM n)
SELECT line, segment, min(font) AS font, string_agg(text, '' ORDER BY seq) AS text FROM g GROUP BY 1, 2"""

NAMES = [
    "l_orderkey AS book", "l_linenumber AS seq", "concat('S', l_linenumber) AS name",
    "CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/b' ELSE concat(CASE WHEN l_suppkey % 2 = 0 THEN 's' ELSE 'S' END, l_suppkey % 8) END AS offer",
]


def rename_sheets(s, d):
    n = numbered(s, d).selectExpr(*NAMES)
    n = n.withColumn("offer", F.when(T.valid_sheet_name(F.trim("offer")), F.trim("offer"))).withColumn("taken", F.collect_set(F.lower("name")).over(W.partitionBy("book")))
    return folds.fold(n, ["book"], ["seq"], folds.renamed("name", "offer", "taken"), "given string", ["given"]).select("book", "seq", "given")


RENAME_SQL = f"""WITH RECURSIVE {LI_SQL}, n AS (SELECT {', '.join(NAMES)} FROM li), e AS (SELECT book, seq, name, CASE WHEN offer IN ('', 'a/b') THEN NULL ELSE offer END AS offer, row_number() OVER (PARTITION BY book ORDER BY seq) AS rn, list(lower(name)) OVER (PARTITION BY book) AS names FROM n),
o AS (SELECT book, 0::BIGINT AS rn, 0 AS seq, '' AS given, any_value(names) AS taken FROM e GROUP BY 1),
f AS (SELECT * FROM o UNION ALL SELECT e.book, e.rn, e.seq, CASE WHEN k.ok THEN e.offer ELSE e.name END, CASE WHEN k.ok THEN list_append([x FOR x IN f.taken IF x <> lower(e.name)], lower(e.offer)) ELSE f.taken END
 FROM f JOIN e ON e.book = f.book AND e.rn = f.rn + 1, LATERAL (SELECT coalesce(e.offer <> e.name AND (lower(e.offer) = lower(e.name) OR NOT list_contains(f.taken, lower(e.offer))), false) AS ok) k)
SELECT book, seq, given FROM f WHERE rn > 0"""


def align_tables(s, d):
    """Columns of a table named as the header cells say; without a text there the old name stays."""
    t = read(s, d, "orders").select(F.col("o_orderkey").alias("sheet"), (F.col("o_custkey") % 3).alias("start"), F.explode(F.expr("sequence(0, o_custkey % 4)")).alias("i"))
    heads = numbered(s, d).selectExpr("l_orderkey AS of", "bigint(l_linenumber) AS c", "CASE l_partkey % 3 WHEN 0 THEN ' ' ELSE concat(l_returnflag, l_partkey % 7) END AS head").where("trim(head) <> ''")
    return t.join(heads, (F.col("sheet") == F.col("of")) & (F.col("c") == F.col("start") + F.col("i")), "left").select("sheet", "i", F.coalesce("head", F.concat(F.lit("col"), "i")).alias("name"))


ALIGN_SQL = f"""WITH {LI_SQL}, t AS (SELECT o_orderkey AS sheet, o_custkey % 3 AS start, unnest(generate_series(0, o_custkey % 4)) AS i FROM orders)
SELECT sheet, i, CASE WHEN l_partkey % 3 <> 0 THEN l_returnflag || l_partkey % 7 ELSE 'col' || i END AS name FROM t LEFT JOIN li ON l_orderkey = sheet AND l_linenumber = start + i"""


def parsed(s, d):
    """Translations from answers in five forms."""
    i, t = F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("n_chars").cast("string"))
    one = F.concat(F.lit('{"id": "'), i, F.lit('", "translated_text": "'), t, F.lit('"}'))
    forms = [F.concat(F.lit("["), one, F.lit("]")), F.concat(F.lit('```json\n{"translations": ['), one, F.lit("]}\n``` done")), F.concat(F.lit('{"n": 1, "results": ['), one, F.lit(', "x"]}')), one, F.concat(F.lit('```\n{"'), i, F.lit('": "'), t, F.lit('", "n": 3}\n```')), F.concat(F.lit("no json "), i)]
    answer = F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int"))
    return read(s, d, "documents").select("doc_id", F.explode(answers.by_id(answer)).alias("id", "translated"))


def batches(s, d):
    """Batches of up to five fragments of a document's section."""
    f = doc_lines(s, d).where(F.trim("text") != "").select("doc_id", "seq", (F.col("seq") % 3 == 2).alias("notes"))
    return f.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("doc_id", "notes").orderBy("seq")) - 1) / 5))


def row_groups(s, d):
    out = folds.fold(boxes(s, d).select("page", "box_id", "y0", (F.col("y0") + F.col("box_id") % 50 + 8).alias("y1")), ["page"], ["y0", "box_id"], folds.stacked("y0", "y1"), "row long", ["row"])
    return out.select("page", "box_id", "row")


QUERIES = {
    "list_markers": (lambda s, d: layout.list_items(numbered(s, d).selectExpr(*MARKED)), MARKED_SQL),
    "overhead_frame": (overhead, OVERHEAD_SQL),
    "style_segments": (segments, SEGMENTS_SQL),
    "rename_sheets": (rename_sheets, RENAME_SQL),
    "align_tables": (align_tables, ALIGN_SQL),
    "answer_parse": (parsed, "SELECT doc_id, doc_id::VARCHAR AS id, 't' || n_chars AS translated FROM documents WHERE doc_id % 6 < 5"),
    "type_batches": (batches, f"WITH {LINES_SQL} SELECT doc_id, seq, seq % 3 = 2 AS notes, ((row_number() OVER (PARTITION BY doc_id, seq % 3 = 2 ORDER BY seq) - 1) // 5)::BIGINT AS batch FROM lines WHERE trim(text) <> ''"),
    "reading_order": (lambda s, d: layout.read_in_order(boxes(s, d)), None),
    "row_groups": (row_groups, None),
}
