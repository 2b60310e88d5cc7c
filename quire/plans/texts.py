"""Queries of the text rules: marked runs, defects, terms, lines, names, page ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire.functions import tagged as G
from quire.functions import text as T
from quire.operators import fragments
from quire.plans.catalogue import LINES_SQL, PAIRS_SQL, doc_lines, pairs
from quire.plans.tables import read

#: Test pairs with three marked runs: some given back as they were, run 1 unclosed in every fifth.
RUNS_SQL = f"""{PAIRS_SQL}, parts AS (SELECT doc_id, turn, source, target, split_part(source, ' ', 1) AS p0,
 CASE WHEN (doc_id + turn) % 2 = 0 THEN '' ELSE ' ' END || split_part(source, ' ', 2) AS p1, ' ' || split_part(source, ' ', 3) AS p2 FROM pairs),
runs AS (SELECT *, CASE WHEN (doc_id + turn) % 3 = 0 THEN p0 || ' ' ELSE split_part(target, ' ', 1) END AS r0, CASE WHEN (doc_id + turn) % 3 = 1 THEN p1 || ' ' ELSE split_part(target, ' ', 2) END AS r1,
 CASE WHEN (doc_id + turn) % 3 = 2 THEN p2 || ' ' ELSE split_part(target, ' ', 3) END AS r2 FROM parts),
marked AS (SELECT *, '[[0]]' || p0 || '[[/0]][[1]]' || p1 || '[[/1]][[2]]' || p2 || '[[/2]] 7' AS a,
 '[[0]]' || r0 || '[[/0]][[1]]' || r1 || CASE WHEN (doc_id + turn) % 5 = 0 THEN '' ELSE '[[/1]]' END || '[[2]]' || r2 || '[[/2]] ' || CASE doc_id % 4 WHEN 0 THEN '7 (abc)' WHEN 1 THEN '7 mot(e)s' WHEN 2 THEN '８' ELSE '7' END AS b FROM runs)"""


def runs(s, d):
    k = F.col("doc_id") + F.col("turn")
    p = [F.split_part("source", F.lit(" "), F.lit(i)) for i in (1, 2, 3)]
    t = [F.split_part("target", F.lit(" "), F.lit(i)) for i in (1, 2, 3)]
    out = pairs(s, d).withColumns({"p0": p[0], "p1": F.concat(F.when(k % 2 == 0, "").otherwise(" "), p[1]), "p2": F.concat(F.lit(" "), p[2])})
    out = out.withColumns({f"r{i}": F.when(k % 3 == i, F.concat(f"p{i}", F.lit(" "))).otherwise(t[i]) for i in range(3)})
    tail = F.when(F.col("doc_id") % 4 == 0, "7 (abc)").when(F.col("doc_id") % 4 == 1, "7 mot(e)s").when(F.col("doc_id") % 4 == 2, "８").otherwise("7")
    a = F.concat(F.lit("[[0]]"), "p0", F.lit("[[/0]][[1]]"), "p1", F.lit("[[/1]][[2]]"), "p2", F.lit("[[/2]] 7"))
    b = F.concat(F.lit("[[0]]"), "r0", F.lit("[[/0]][[1]]"), "r1", F.when(k % 5 == 0, "").otherwise("[[/1]]"), F.lit("[[2]]"), "r2", F.lit("[[/2]] "), tail)
    return out.withColumns({"a": a, "b": b})


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g'))"


def run_sql(x: str, i: int) -> str:
    return f"regexp_extract({x}, '(?s)\\[\\[{i}\\]\\](.*?)\\[\\[/{i}\\]\\]', 1)"


def has_sql(x: str) -> str:
    return " AND ".join(f"regexp_matches({x}, '(?s)\\[\\[{i}\\]\\].*?\\[\\[/{i}\\]\\]')" for i in range(3))


def copied_sql(a: list[str], b: list[str]) -> str:
    same = [f"{norm_sql(x)} = {norm_sql(y)}" for x, y in zip(a, b, strict=True)]
    hit = ", ".join(f"CASE WHEN {s} AND regexp_matches({x}, '\\p{{L}}') THEN '{i}' END" for i, (s, x) in enumerate(zip(same, a, strict=True)))
    return f"CASE WHEN {' AND '.join(same)} THEN '' ELSE concat_ws(',', {hit}) END"


def plain_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\[\\[/?\\d+\\]\\]', '', 'g')"


def open_sql(x: str) -> str:
    t = f"replace({plain_sql(x)}, '（', '(')"
    return f"(length({t}) - length(replace({t}, '(', '')) - len(regexp_extract_all({t}, '[a-zà-ÿ]\\([a-zà-ÿ]{{1,3}}\\)')))"


def digits_sql(x: str) -> str:
    return f"list_sort(regexp_extract_all({plain_sql(x)}, '\\p{{Nd}}+'))"


def joined(c):
    return F.array_join(c, ",")


def three(x):
    return [F.col(f"{x}{i}") for i in range(3)]


TERMS_SQL = f"""{PAIRS_SQL}, n AS (SELECT doc_id, turn, list_distinct(regexp_extract_all({norm_sql(plain_sql('source'))}, '\\p{{L}}{{3,}}')) AS s, regexp_extract_all({norm_sql(plain_sql('target'))}, '\\p{{L}}{{3,}}') AS t FROM pairs WHERE trim(target) <> ''),
w AS (SELECT doc_id, turn, t, unnest(s) AS word FROM n), bad AS (SELECT doc_id, word, count_if(NOT list_contains(t, word))::BIGINT AS translated FROM w GROUP BY 1, 2 HAVING count_if(list_contains(t, word)) > 0 AND count_if(NOT list_contains(t, word)) > 0)"""


def terms_to_redo(s, d):
    p = pairs(s, d)
    bad = fragments.inconsistent_terms(p).select("doc_id", "word")
    kept = fragments.pair_words(p).where("kept").join(bad, ["doc_id", "word"])
    return kept.groupBy("doc_id", "turn").agg(joined(F.array_sort(F.collect_set("word"))).alias("terms"))


def defects(s, d):
    r = runs(s, d).select("doc_id", "turn", "a", "b", *[c.alias(f"{x}{i}") for x in "ab" for i, c in enumerate(G.run_texts(F.col(x), 3))])
    r = r.withColumn("same", G.copied(three("a"), three("b")))
    return r.select("doc_id", "turn", joined(G.defects(F.col("a"), F.col("b"), 3, F.col("same"))).alias("found"))


def string_table(s, d):
    """Text to translation of each document's lines: empty and equal ones out, the last entry wins."""
    target = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("T"), "seq", F.lit(":"), "text")).when(F.col("seq") % 3 == 1, F.col("text")).otherwise("")
    t = doc_lines(s, d).withColumn("target", target).where((F.trim("target") != "") & (F.col("target") != F.col("text")))
    return t.groupBy("doc_id", F.col("text").alias("source")).agg(F.max_by("target", "seq").alias("target"))


def specs(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spec = F.concat_ws("", (k % 7).cast("string"), F.lit("-"), (c % 9).cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit(",x, -5,"), F.when(k % 11 == 0, "3--5").otherwise(""))
    return read(s, d, "orders").select("o_orderkey", T.page_set(spec).alias("pages"))


SPECS_SQL = """spec AS (SELECT o_orderkey, (o_orderkey % 7) || '-' || (o_custkey % 9) || ', ' || (o_orderkey % 5) || ',x, -5,' || CASE WHEN o_orderkey % 11 = 0 THEN '3--5' ELSE '' END AS s FROM orders),
tok AS (SELECT o_orderkey, trim(unnest(string_split(s, ','))) AS t FROM spec),
rng AS (SELECT o_orderkey, CASE WHEN regexp_matches(t, '^\\+?\\d+$') THEN t::BIGINT ELSE regexp_extract(t, '^(\\+?\\d+)\\s*-\\s*([+-]?\\d+)$', 1)::BIGINT END AS lo, CASE WHEN regexp_matches(t, '^\\+?\\d+$') THEN t::BIGINT ELSE regexp_extract(t, '^(\\+?\\d+)\\s*-\\s*([+-]?\\d+)$', 2)::BIGINT END AS hi FROM tok WHERE regexp_matches(t, '^\\+?\\d+(\\s*-\\s*[+-]?\\d+)?$')),
one AS (SELECT DISTINCT o_orderkey, unnest(generate_series(least(lo, hi), greatest(lo, hi))) AS p FROM rng),
sets AS (SELECT o_orderkey, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages, min(p) AS lo, max(p) AS hi, count(*) AS n FROM one WHERE p >= 1 GROUP BY 1)"""

#: Test names of fonts.
FONTS = ["Arial", "ABCDEF+ProximaNova-Semibold", "Oswald Bold", "Times New Roman", "Roboto-Medium", "Courier New", "Futura Heavy", "Georgia", "PT Serif Black", "Helvetica Narrow", "Consolas", "Century Gothic"]


def fonts(s, d):
    name = F.element_at(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % len(FONTS) + 1).cast("int"))
    bold = F.col("p_size") % 2 == 0
    return read(s, d, "part").select("p_partkey", T.font_family(name).alias("family"), T.font_weight(name, bold).alias("weight"), T.font_base(name).alias("base"))


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


FONTS_SQL = f"""WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS bold, lower([{', '.join(f"'{x}'" for x in FONTS)}][(p_partkey % {len(FONTS)} + 1)::INT]) AS n FROM part), g AS (SELECT *, replace(replace(n, ' ', ''), '-', '') AS m FROM f)
SELECT p_partkey, CASE {' '.join(f"WHEN {any_sql('n', w)} THEN '{k}'" for k, w in T.FAMILIES)} ELSE 'opensans' END AS family,
 CASE {' '.join(f"WHEN {any_sql('m', w)} THEN '{k}'" for k, w in T.WEIGHTS)} WHEN bold THEN 'bold' ELSE 'regular' END AS weight, CASE {' '.join(f"WHEN {any_sql('n', w)} THEN '{k}'" for k, w in T.BASES)} ELSE 'helv' END AS base FROM g"""


def code():
    return F.concat(F.lit('#,##0" '), "p_type", F.lit('";[Red]-0" ";0"'), "p_size", F.lit('"'))


def cell():
    return F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_size").cast("string"), F.lit(",5"))).otherwise(F.array("p_name", F.lit(" 2026")))


def phone():
    return F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+237 6"), F.lpad(((F.col("c_custkey") * 7919) % 100000000).cast("string"), 8, "0"))).otherwise(F.concat(F.lit("6"), F.lpad(((F.col("c_custkey") * 1000003) % 100000000).cast("string"), 8, "0")))


SIGNAL_SQL = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    "tag_parse": (lambda s, d: runs(s, d).select("doc_id", "turn", G.parse(F.col("b")).alias("m")).select("doc_id", "turn", *[F.coalesce(F.col("m")[i], F.lit("")).alias(f"t{i}") for i in range(3)]), f"WITH {RUNS_SQL} SELECT doc_id, turn, " + ", ".join(f"{run_sql('b', i)} AS t{i}" for i in range(3)) + " FROM marked"),
    "tag_conform": (lambda s, d: runs(s, d).select("doc_id", "turn", G.conforms(F.col("b"), 3).alias("ok")), f"WITH {RUNS_SQL} SELECT doc_id, turn, {has_sql('b')} AS ok FROM marked"),
    "tags_ok": (lambda s, d: runs(s, d).select("doc_id", "turn", T.tags_ok(F.col("a"), F.col("b")).alias("ok")), f"WITH {RUNS_SQL} SELECT doc_id, turn, list_sort(regexp_extract_all(a, '\\[\\[/?\\d+\\]\\]')) = list_sort(regexp_extract_all(b, '\\[\\[/?\\d+\\]\\]')) AS ok FROM marked"),
    "norm_text": (lambda s, d: pairs(s, d).select("doc_id", "turn", G.norm(F.col("source")).alias("form")), f"WITH {PAIRS_SQL} SELECT doc_id, turn, {norm_sql('source')} AS form FROM pairs"),
    "word_aligned": (lambda s, d: runs(s, d).select("doc_id", "turn", G.aligned(three("p")).alias("ok")), f"WITH {RUNS_SQL} SELECT doc_id, turn, " + " AND ".join(f"(regexp_matches({x}, '[  \\t]$') OR regexp_matches({y}, '^[  \\t]'))" for x, y in (("p0", "p1"), ("p1", "p2"))) + " AS ok FROM marked"),
    "copied_runs": (lambda s, d: runs(s, d).select("doc_id", "turn", joined(G.copied(three("p"), three("r"))).alias("runs")), f"WITH {RUNS_SQL} SELECT doc_id, turn, {copied_sql(['p0', 'p1', 'p2'], ['r0', 'r1', 'r2'])} AS runs FROM marked"),
    "added_gloss": (lambda s, d: runs(s, d).select("doc_id", "turn", G.openings(F.col("a")).cast("long").alias("before"), G.openings(F.col("b")).cast("long").alias("after")), f"WITH {RUNS_SQL} SELECT doc_id, turn, {open_sql('a')}::BIGINT AS before, {open_sql('b')}::BIGINT AS after FROM marked"),
    "defects": (defects, f"WITH {RUNS_SQL} SELECT doc_id, turn, concat_ws(',', CASE WHEN NOT ({has_sql('b')}) THEN 'balises' WHEN {copied_sql([run_sql('a', i) for i in range(3)], [run_sql('b', i) for i in range(3)])} <> '' THEN 'recopie' END, CASE WHEN {digits_sql('a')} <> {digits_sql('b')} THEN 'nombres' END, CASE WHEN {open_sql('b')} > {open_sql('a')} THEN 'ajout' END) AS found FROM marked"),
    "inconsistent_terms": (lambda s, d: fragments.inconsistent_terms(pairs(s, d)), f"WITH {TERMS_SQL} SELECT * FROM bad"),
    "terms_to_redo": (terms_to_redo, f"WITH {TERMS_SQL} SELECT doc_id, turn, string_agg(DISTINCT word, ',' ORDER BY word) AS terms FROM w JOIN bad USING (doc_id, word) WHERE list_contains(t, word) GROUP BY 1, 2"),
    "redistribute": (lambda s, d: runs(s, d).select("doc_id", "turn", F.array_join(G.redistributed(F.array(*three("p")), F.when(F.col("turn") % 4 == 0, F.col("target")).otherwise(F.col("b"))), "|").alias("texts")), None),
    "numbers_kept": (lambda s, d: runs(s, d).select("doc_id", "turn", (F.array_sort(T.numbers(G.plain(F.col("a")))) == F.array_sort(T.numbers(G.plain(F.col("b"))))).alias("kept")), f"WITH {RUNS_SQL} SELECT doc_id, turn, {digits_sql('a')} = {digits_sql('b')} AS kept FROM marked"),
    "string_table": (string_table, f"WITH {LINES_SQL}, t AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'T' || seq || ':' || text WHEN 1 THEN text ELSE '' END AS target FROM lines) SELECT doc_id, text AS source, arg_max(target, seq) AS target FROM t WHERE trim(target) <> '' AND target <> text GROUP BY 1, 2"),
    "format_literals": (lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(T.format_literals(code()), "|").alias("literals")), "SELECT p_partkey, ' ' || p_type || '|' || p_size AS literals FROM part"),
    "tag_cell": (lambda s, d: read(s, d, "part").select("p_partkey", T.tag_cell(cell()).alias("cell")), "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '[[0]]' || p_name || '[[/0]][[1]] 2026[[/1]]' END AS cell FROM part"),
    "page_ranges": (lambda s, d: specs(s, d).select("o_orderkey", F.array_join("pages", ",").alias("pages")), f"WITH {SPECS_SQL} SELECT o_orderkey, pages FROM orders LEFT JOIN sets USING (o_orderkey)"),
    "page_token": (lambda s, d: specs(s, d).select("o_orderkey", T.page_token(F.col("pages")).alias("token")), f"WITH {SPECS_SQL} SELECT o_orderkey, CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN 'p' || lo WHEN hi - lo + 1 = n THEN 'p' || lo || '-' || hi ELSE 'p' || substr(sha1(pages), 1, 8) END AS token FROM orders LEFT JOIN sets USING (o_orderkey)"),
    "phone_operator": (lambda s, d: read(s, d, "customer").select("c_custkey", T.phone(phone()).alias("phone"), T.phone_operator(phone()).alias("operator")), "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '2376' || lpad(((c_custkey * 7919) % 100000000)::VARCHAR, 8, '0') ELSE '2376' || lpad(((c_custkey * 1000003) % 100000000)::VARCHAR, 8, '0') END AS phone FROM customer) SELECT c_custkey, phone, CASE WHEN regexp_matches(substr(phone, 4), '^6(5[0-4]|7[0-9]|8[0-4])') THEN 'mtn_momo' WHEN regexp_matches(substr(phone, 4), '^6(5[5-9]|9[0-9]|8[5-9])') THEN 'orange_money' END AS operator FROM p"),
    "font_class": (fonts, FONTS_SQL),
    "join_lines": (lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(T.joined_lines(F.split(F.regexp_replace("text", r"([a-zäöüé]) ([a-z])", "$1-\n$2"), "\n")), 256).alias("h")), None),
    "line_signals": (lambda s, d: doc_lines(s, d).select("doc_id", "seq", T.ends_sentence(F.col("text")).alias("ends"), T.starts(F.col("text"), "Lu").alias("capital"), T.starts(F.col("text"), "Ll").alias("lower"), T.first_word(F.col("text")).alias("first"), T.last_word(F.col("text")).alias("last")), f"""WITH {LINES_SQL} SELECT doc_id, seq, regexp_matches(text, '[.!?…]["”’'')]*\\s*$') AS ends, regexp_matches(regexp_extract(text, '[\\p{{L}}\\p{{Nd}}]'), '^\\p{{Lu}}') AS capital, regexp_matches(regexp_extract(text, '[\\p{{L}}\\p{{Nd}}]'), '^\\p{{Ll}}') AS lower,
 trim(split_part({SIGNAL_SQL}, ' ', 1), '.,;:!?)]}}»”"''') AS first, lower(trim(split_part({SIGNAL_SQL}, ' ', -1), '.,;:!?([{{«"''')) AS last FROM lines"""),
}
