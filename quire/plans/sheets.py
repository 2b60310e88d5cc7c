"""Queries of spreadsheets, formulas, page layout and batches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import formulas
from quire.operators import folds, layout, sheets
from quire.plans.catalogue import LINES_SQL, doc_lines
from quire.plans.tables import read

CELLS = "l_orderkey AS sheet, l_linenumber::BIGINT AS r, l_partkey % 12 AS c, l_suppkey % 9 AS style, l_partkey % 40 AS string_id, l_suppkey % 10 <> 0 AS translated"
CELLS_SQL = f"cells AS (SELECT {CELLS} FROM lineitem)"
MERGES = "o_orderkey AS sheet, 1 AS r0, 1 + o_orderkey % 3 AS r1, o_custkey % 6 AS c0, o_custkey % 6 + 4 AS c1"
#: Styles of the test workbook: index, font, size.
STYLES = [(0, "base", 10.0), (1, "bold", 10.0), (2, "title", 14.0), (3, "note", 8.0)]


def cells(s, d):
    return read(s, d, "lineitem").selectExpr(*CELLS.split(", "))


def merged(s, d):
    return sheets.merged(cells(s, d), read(s, d, "orders").selectExpr(*MERGES.split(", "))).select("sheet", "r", "c")


def styled(s, d):
    styles = F.broadcast(s.createDataFrame(STYLES, "style long, font string, size double"))
    return sheets.styled(cells(s, d), styles).select("sheet", "r", "style", "font", "size")


#: One row for each numbered line of an order: the test table holds some numbers more than once.
LI_SQL = """li AS (SELECT l_orderkey, l_linenumber, sum(l_partkey)::BIGINT AS l_partkey, sum(l_suppkey)::BIGINT AS l_suppkey, max(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"""
BOXES = "l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box_id, double((l_partkey * 7) % 540) AS x0, double((l_suppkey * 13 + l_linenumber * 17) % 720) AS y0, (l_partkey * 7) % 540 + l_quantity AS x1, (l_suppkey * 13 + l_linenumber * 17) % 720 + 8D AS y1"
BOXES_SQL = f"{LI_SQL}, boxes AS (SELECT {BOXES.replace('double(', '(').replace('8D', '8.0::DOUBLE').replace('% 540) AS x0', '% 540)::DOUBLE AS x0').replace('% 720) AS y0', '% 720)::DOUBLE AS y0')} FROM li)"


def numbered(s, d):
    a = {"l_partkey": F.sum, "l_suppkey": F.sum, "l_quantity": F.max, "l_returnflag": F.min, "l_linestatus": F.min}
    return read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[f(c).alias(c) for c, f in a.items()])


def boxes(s, d):
    return numbered(s, d).selectExpr(*BOXES.split(", "))


#: Renamed sheets and columns of the test workbook, and forms of its formulas: before and after, with a part's key for {k}.
SHEETS = {"Ventes": "Sales", "Chiffre d'affaires": "Year's turnover", "Synthese": "Summary"}
COLUMNS = {"Produit": "Product", "Prix": "Price"}
FORMULAS = [
    ("SUM(Ventes!A{k},'Chiffre d''affaires'!B2)", "SUM(Sales!A{k},'Year''s turnover'!B2)"),
    ('"Ventes!x ""Ventes!"""&Ventes!C{k}', '"Ventes!x ""Ventes!"""&Sales!C{k}'),
    ("[1]Ventes!C{k}+Ventes2!D4", "[1]Ventes!C{k}+Ventes2!D4"),
    ("SUM(Ventes:Synthese!A1:A{k})", "SUM(Sales:Summary!A1:A{k})"),
    ("Ventes+{k}", "Ventes+{k}"),
]
TABLES = [
    ("SUM(T[Produit])*{k}", "SUM(T[Product])*{k}"),
    ("T[@Prix]+T[#Totals]-[@Produit]", "T[@Price]+T[#Totals]-[@Product]"),
    ("Produit+T[Autre]+{k}", "Produit+T[Autre]+{k}"),
]


def rewritten(forms, names, rewrite):
    def build(s, d):
        form = F.element_at(F.array(*[F.lit(a) for a, _ in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int"))
        to = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        formula = F.replace(form, F.lit("{k}"), F.col("p_partkey").cast("string"))
        return read(s, d, "part").select("p_partkey", rewrite(formula, to).alias("formula"))

    quoted = ", ".join("'" + b.replace("'", "''") + "'" for _, b in forms)
    return build, f"SELECT p_partkey, replace(([{quoted}])[p_partkey % {len(forms)} + 1], '{{k}}', p_partkey::VARCHAR) AS formula FROM part"


def band_bounds(s, d):
    b = boxes(s, d)
    bands = b.where("box_id % 10 <= 3").withColumnRenamed("box_id", "band_id")
    return layout.band_bounds(b.where("box_id % 10 > 3").select("page", F.col("box_id").alias("line_id"), "y0", "y1"), bands)


BAND_BOUNDS_SQL = f"""WITH {BOXES_SQL}, m AS (SELECT l.page, l.box_id AS line_id, b.x0, b.x1, b.y1 > l.y0 AND b.y0 < l.y1 AS o, row_number() OVER (PARTITION BY l.page, l.box_id ORDER BY abs((b.y0 + b.y1) / 2 - (l.y0 + l.y1) / 2), b.box_id) AS rn
 FROM boxes l JOIN boxes b ON l.page = b.page WHERE l.box_id % 10 > 3 AND b.box_id % 10 <= 3)
SELECT page, line_id, coalesce(max(x0) FILTER (o), max(x0) FILTER (rn = 1)) AS lo, coalesce(min(x1) FILTER (o), max(x1) FILTER (rn = 1)) AS hi FROM m GROUP BY 1, 2"""


def justified(s, d):
    lines = numbered(s, d).selectExpr("l_orderkey AS para", "l_linenumber AS place", "double(l_partkey % 6) AS x0", "double(120 + l_suppkey % 9) AS x1")
    return layout.justified(lines, 10.0)


JUSTIFIED_SQL = f"""WITH {LI_SQL}, l AS (SELECT l_orderkey AS para, l_linenumber AS place, (l_partkey % 6)::DOUBLE AS x0, (120 + l_suppkey % 9)::DOUBLE AS x1 FROM li),
p AS (SELECT para, min(x0) AS x, max(place) AS z, count(*) AS n, max(x1) - min(x0) AS wide FROM l GROUP BY 1),
i AS (SELECT para, max(x1) - min(x1) AS spread FROM l JOIN p USING (para) WHERE place < z GROUP BY 1), f AS (SELECT para, count(*) AS flush FROM l JOIN p USING (para) WHERE x0 - x <= 3 GROUP BY 1)
SELECT para, coalesce(n >= 3 AND flush >= 0.6 * n AND spread <= greatest(5.0, 0.03 * wide), false) AS justified FROM p JOIN f USING (para) LEFT JOIN i USING (para)"""


def folios(s, d):
    """Numbers on pages: the last run of a line if it stands far from the text, or a line of its own."""
    lines = numbered(s, d).selectExpr("l_orderkey AS page", "l_linenumber AS line", "500 + (l_partkey % 90) / 10D AS right", "l_quantity >= 12 AS trailing").where("trailing or line % 2 = 0")
    return layout.aligned_folios(lines).select("page", "line", "aligned")


FOLIOS_SQL = f"""WITH {LI_SQL}, n AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey % 90 AS tenth, l_quantity >= 12 AS trailing FROM li WHERE l_quantity >= 12 OR l_linenumber % 2 = 0)
SELECT a.page, a.line, count(*) AS aligned FROM n a JOIN n b ON a.page = b.page AND abs(a.tenth - b.tenth) <= 25 WHERE a.trailing GROUP BY 1, 2 HAVING count(*) >= 2"""

GLYPHS = "l_orderkey AS page, l_orderkey * 10 + l_linenumber AS glyph_id, chr(int(65 + l_partkey % 2)) AS ch, double(l_partkey % 3 * 10) AS x0, double(l_suppkey % 2 * 10) AS y0, double(l_partkey % 3 * 10 + 8) AS x1, double(l_suppkey % 2 * 10 + 8) AS y1, l_linenumber * 2 AS seq"
COVERS = "l_orderkey AS page, double(l_suppkey % 3 * 10) AS x0, double(l_partkey % 2 * 10) AS y0, double(l_suppkey % 3 * 10 + 18) AS x1, double(l_partkey % 2 * 10 + 7.5) AS y1, l_linenumber * 2 + 1 AS seq"


def visible(s, d):
    li = numbered(s, d)
    return layout.visible(li.selectExpr(*GLYPHS.split(", ")), li.where("l_quantity > 25").selectExpr(*COVERS.split(", "))).select("page", "glyph_id", "ch")


VISIBLE_SQL = f"""WITH {LI_SQL}, g AS (SELECT {GLYPHS.replace('double(', '(').replace('int(', '(').replace('chr((65 + l_partkey % 2))', 'chr((65 + l_partkey % 2)::INT)')} FROM li), c AS (SELECT {COVERS.replace('double(', '(')} FROM li WHERE l_quantity > 25),
h AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE c.page = g.page AND c.seq > g.seq AND g.x0 >= c.x0 - 0.5 AND g.y0 >= c.y0 - 0.5 AND g.x1 <= c.x1 + 0.5 AND g.y1 <= c.y1 + 0.5) AS hid FROM g),
n AS (SELECT *, count_if(hid) OVER (PARTITION BY page, ch, x0, y0) AS gone, row_number() OVER (PARTITION BY page, ch, x0, y0 ORDER BY glyph_id) AS nth FROM h) SELECT page, glyph_id, ch FROM n WHERE nth > gone"""

SPANS = "l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box_id, l_linenumber * 40 + l_partkey % 7 AS x0, l_linenumber * 40 + 30 + l_suppkey % 9 AS x1, CASE l_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE l_returnflag END || l_linestatus || CASE l_suppkey % 4 WHEN 0 THEN ' ' ELSE '' END AS text"


def composed(s, d):
    return layout.composed(numbered(s, d).selectExpr(*SPANS.split(", ")), 20.0)


COMPOSED_SQL = f"""WITH {LI_SQL}, s AS (SELECT {SPANS} FROM li), t AS (SELECT *, lag(x1) OVER w AS px, lag(text) OVER w AS pt FROM s WINDOW w AS (PARTITION BY page ORDER BY x0, box_id))
SELECT page, string_agg(CASE WHEN x0 - px > 0.30 * 20.0 AND pt <> '' AND pt NOT LIKE '% ' AND text NOT LIKE ' %' THEN ' ' ELSE '' END || text, '' ORDER BY x0, box_id) AS text FROM t GROUP BY 1"""

COLUMNS_SQL = f"""WITH RECURSIVE {BOXES_SQL}, links AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page = b.page AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.25 * greatest(1.0, least(a.x1 - a.x0, b.x1 - b.x0))),
reach AS (SELECT page, box_id, box_id AS other FROM boxes UNION SELECT r.page, r.box_id, l.b FROM reach r JOIN links l ON r.other = l.a) SELECT page, box_id, min(other) AS col FROM reach GROUP BY 1, 2"""


def page_batches(s, d):
    """Batches of at most five fragments of a page; headings stay with what follows them."""
    w = W.partitionBy("page").orderBy("id")
    f = numbered(s, d).selectExpr("l_suppkey AS page", "l_orderkey * 10 + l_linenumber AS id", "l_quantity < 15 AS heading").withColumn("rn", F.row_number().over(w))
    after = F.min(F.when(~F.col("heading"), F.col("rn"))).over(w.rowsBetween(0, W.unboundedFollowing))
    n = F.count("*").over(W.partitionBy("page"))
    f = f.withColumn("together", F.least(F.coalesce(after, n + 1) - F.col("rn"), n - F.col("rn")).cast("long")).drop("rn")
    return folds.fold(f, ["page"], ["id"], folds.batches(5, "together"), "batch long", ["batch"]).select("page", "id", "batch")


PAGE_BATCHES_SQL = f"""WITH RECURSIVE {LI_SQL}, x AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_quantity < 15 AS heading, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM li),
e AS (SELECT *, least(coalesce(min(CASE WHEN NOT heading THEN rn END) OVER (PARTITION BY page ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n + 1) - rn, n - rn) AS t FROM x),
f AS (SELECT page, rn, id, 1::BIGINT AS held, 0::BIGINT AS batch FROM e WHERE rn = 1 UNION ALL SELECT e.page, e.rn, e.id, CASE WHEN e.t >= 5 - f.held THEN 1 ELSE f.held + 1 END, CASE WHEN e.t >= 5 - f.held THEN f.batch + 1 ELSE f.batch END FROM f JOIN e ON e.page = f.page AND e.rn = f.rn + 1) SELECT page, id, batch FROM f"""


def spread_sample(s, d):
    w = W.partitionBy("doc_id")
    t = doc_lines(s, d).select("doc_id", "seq", F.length(F.trim("text")).cast("long").alias("n")).where("n > 0")
    t = t.withColumns({"total": F.sum("n").over(w), "before": F.coalesce(F.sum("n").over(w.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    return folds.fold(t, ["doc_id"], ["seq"], folds.spread("n", "before", "total", 600, 90), "taken long", ["taken"]).where("taken > 0").select("doc_id", "seq", "taken")


SPREAD_SQL = f"""WITH RECURSIVE {LINES_SQL}, t AS (SELECT doc_id, seq, length(trim(text)) AS n FROM lines WHERE trim(text) <> ''),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id)::BIGINT AS total, (sum(n) OVER (PARTITION BY doc_id ORDER BY seq) - n)::BIGINT AS bef, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM t),
f AS (SELECT doc_id, seq, rn, CASE WHEN total <= 600 THEN n ELSE least(n, 90) END AS taken, greatest(least(n, 90) * (total / 600.0::DOUBLE), 1.0) AS due FROM e WHERE rn = 1
 UNION ALL SELECT e.doc_id, e.seq, e.rn, CASE WHEN e.total <= 600 THEN e.n WHEN e.bef >= f.due THEN least(e.n, 90) ELSE 0 END, CASE WHEN e.bef >= f.due THEN f.due + greatest(least(e.n, 90) * (e.total / 600.0::DOUBLE), 1.0) ELSE f.due END FROM f JOIN e ON e.doc_id = f.doc_id AND e.rn = f.rn + 1)
SELECT doc_id, seq, taken::BIGINT AS taken FROM f WHERE taken > 0"""


def char_budget(s, d):
    """Characters that a translation may have in its place, in the second round: what the free lines hold,
    not less than 0.92 of the source's."""
    fit = F.when(F.col("natural") > F.col("avail"), F.floor(F.col("len") * (F.col("avail") / F.col("natural")) * F.lit(0.92))).otherwise(F.col("len"))
    t = read(s, d, "documents").selectExpr("doc_id", "bigint(n_chars) AS len", "1 + doc_id % 9 AS natural", "1 + doc_id % 5 AS avail", "bigint(n_chars * 3 div 4) AS src")
    return t.select("doc_id", F.greatest(F.floor(F.lit(0.92) * F.col("src")), F.floor(fit * F.lit(0.92))).alias("budget"))


BUDGET_SQL = """WITH t AS (SELECT doc_id, n_chars::BIGINT AS len, 1 + doc_id % 9 AS natural, 1 + doc_id % 5 AS avail, (n_chars * 3 // 4)::BIGINT AS src FROM documents),
f AS (SELECT *, CASE WHEN "natural" > avail THEN floor(len * (avail / "natural") * 0.92::DOUBLE) ELSE len END AS fit FROM t) SELECT doc_id, greatest(floor(0.92::DOUBLE * src), floor(fit * 0.92::DOUBLE))::BIGINT AS budget FROM f"""
BUDGET_SQL = BUDGET_SQL.replace("AS natural,", 'AS "natural",')

QUERIES = {
    "merged_cells": (merged, f"WITH {CELLS_SQL}, m AS (SELECT {MERGES} FROM orders) SELECT c.sheet, r, c FROM cells c JOIN m ON m.sheet = c.sheet AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1"),
    "cell_styles": (styled, f"WITH {CELLS_SQL}, s(style, font, size) AS (VALUES {', '.join(map(str, STYLES))}) SELECT sheet, r, s.style::BIGINT AS style, font, size::DOUBLE AS size FROM cells c JOIN s ON s.style = CASE WHEN c.style > 3 THEN 0 ELSE c.style END"),
    "sheet_ready": (lambda s, d: sheets.ready(cells(s, d)), f"WITH {CELLS_SQL} SELECT sheet, count(DISTINCT string_id) AS strings, bool_and(translated) AS ready FROM cells GROUP BY 1"),
    "rewrite_refs": rewritten(FORMULAS, SHEETS, formulas.sheet_refs),
    "rewrite_struct_refs": rewritten(TABLES, COLUMNS, formulas.column_refs),
    "band_bounds": (band_bounds, BAND_BOUNDS_SQL),
    "justified_paras": (justified, JUSTIFIED_SQL),
    "folio_columns": (folios, FOLIOS_SQL),
    "hidden_glyphs": (visible, VISIBLE_SQL),
    "compose_line": (composed, COMPOSED_SQL),
    "columns_cc": (lambda s, d: layout.columns(boxes(s, d)), COLUMNS_SQL),
    "page_batches": (page_batches, PAGE_BATCHES_SQL),
    "spread_sample": (spread_sample, SPREAD_SQL),
    "char_budget": (char_budget, BUDGET_SQL),
    "part_types": (lambda s, d: read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("part")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("types")), "SELECT l_orderkey AS part, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS types FROM lineitem GROUP BY 1"),
}
