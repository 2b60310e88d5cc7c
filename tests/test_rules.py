"""Vectors of rules that SQL cannot express or that the test tables hardly reach."""

import datetime as dt
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import answers, formulas, tagged, text
from quire.operators import folds, layout, plans


@pytest.mark.parametrize(("parts", "given", "want"), [
    ([], "x", []),
    (["a"], "[[0]]b[[/0]]", ["b"]),
    (["a", "b"], "[[1]]y[[/1]][[0]]x[[/0]]", ["x", "y"]),
    (["a", "b"], "[[0]]x[[/0]][[0]]z[[/0]][[1]]y[[/1]]", ["z", "y"]),
    (["one "], "two [[3]]", ["two"]),
    (["Sub", "title"], "[[1]]titre[[/1]]", ["", "titre"]),
    (["Sub", "title"], "Sous-titre", ["", "Sous-titre"]),
    (["Note: ", "this is long"], "Remarque : ceci est bien long", ["Remarque : ", "ceci est bien long"]),
    (["a ", "b ", "c"], "seul mot", ["seul mot", "", ""]),
    (["a", " b"], "un deux trois", ["un", " deux trois"]),
])
def test_spread(parts, given, want):
    assert tagged.spread(parts, given) == want


def test_norm_and_copied(spark):
    rows = [("Éa  B", "ea b", " •", " •"), ("x", "y", "Same", "SAME"), ("x", "x", "y", "y")]
    d = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = d.select(tagged.copied([F.col("a"), F.col("c")], [F.col("b"), F.col("d")]).alias("r")).collect()
    assert [r.r for r in got] == [[], [1], []]


def test_joined_lines(spark):
    d = spark.createDataFrame([(["trans-", "port  of", "", " goods"],), (["A-", "Big"],), (["1-", "a"],), ([""],)], "x array<string>")
    assert [r[0] for r in d.select(text.joined_lines(F.col("x"))).collect()] == ["transport of goods", "A- Big", "1- a", ""]


def test_joined_lines_long(spark):
    """60,000 cut lines in one text: the work follows the length, not its square."""
    n = 60_000
    d = spark.range(1).select(F.split(F.repeat(F.lit("word-\n"), n), "\n").alias("x"))
    began = time.monotonic()
    assert d.select(F.sha2(text.joined_lines(F.col("x")), 256)).first()[0] == hashlib.sha256(("word" * (n - 1) + "word-").encode()).hexdigest()
    assert time.monotonic() - began < 20
    odd = [(["-", "a"],), (["a", "-", "b"],), (["x-", "y-", "z"],), ([" ab-\t", None, "\x0b", "cd" + " " * 3000 + "e "],), (None,), ([],), (["a\x01-", "\x02b", "\x01\x04-", "c", "d\x01\x03"],), ([" ", "a ", "", " \t", " b- ", "", "c"],)]
    got = [r[0] for r in spark.createDataFrame(odd, "x array<string>").select(text.joined_lines(F.col("x"))).collect()]
    assert got == ["- a", "a - b", "xyz", "abcd e", None, "", "a\x01- \x02b \x01\x04- c d\x01\x03", "a bc"]


def test_pages(spark):
    d = spark.createDataFrame([("5-1",), ("3--5",), ("-5",), (" 2 , x",), ("",), ("0",), ("1,2,9",)], "s string").select(text.page_set(F.col("s")).alias("p"))
    got = d.select("p", text.page_token(F.col("p")).alias("t")).collect()
    assert [r.p for r in got] == [[1, 2, 3, 4, 5], [1, 2, 3], None, [2], None, None, [1, 2, 9]]
    assert [r.t for r in got][:4] == ["p1-5", "p1-3", "", "p2"] and len(got[6].t) == 9


def test_quota_period(spark):
    t = dt.datetime
    rows = [(t(2024, 1, 31, 10), t(2025, 1, 1), t(2024, 2, 29, 9)), (t(2024, 1, 31, 10), t(2025, 1, 1), t(2024, 2, 29, 11)), (None, None, t(2024, 5, 7)), (t(2024, 9, 1), t(2025, 1, 1), t(2024, 5, 7))]
    d = spark.createDataFrame(rows, "a timestamp_ntz, e timestamp_ntz, n timestamp_ntz")
    lo, hi = plans.quota_period(F.col("a"), F.col("e"), F.col("n"))
    got = [(r.lo, r.hi) for r in d.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert got == [(t(2024, 1, 31, 10), t(2024, 2, 29, 10)), (t(2024, 2, 29, 10), t(2024, 3, 31, 10)), (t(2024, 5, 1), t(2024, 6, 1)), (t(2024, 9, 1), t(2024, 10, 1))]


def test_spaced(spark):
    """A refused row does not push the next one back."""
    d = spark.createDataFrame([("u", x) for x in (0, 30, 60, 100)] + [("v", 5)], "u string, t int")
    got = folds.fold(d, ["u"], ["t"], folds.spaced("t", 45), "ok boolean", ["ok"]).orderBy("u", "t").collect()
    assert [r.ok for r in got] == [True, False, True, False, True]
    assert folds.fold(d.limit(0), ["u"], ["t"], folds.spaced("t", 45), "ok boolean", ["ok"]).count() == 0


def test_clusters(spark):
    """Clusters are measured from their first member: values may not drift."""
    d = spark.createDataFrame([(1, x) for x in (1.0, 1.4, 1.8, 5.0)], "p int, x double")
    got = folds.fold(d, ["p"], ["x"], folds.anchored("x", 0.5), "c long", ["c"]).orderBy("x").collect()
    assert [r.c for r in got] == [0, 0, 1, 2]


@pytest.mark.parametrize(("formula", "want"), [
    ("", ""), ("A1+B2", "A1+B2"), ("Old!A1", "New!A1"), ("Old !A1", "New !A1"), ('"Old!"&Old!A1', '"Old!"&New!A1'),
    ("[2]Old!A1", "[2]Old!A1"), ("Older!A1", "Older!A1"), ("'It''s'!A1:Old!B2", "'a b''c'!A1:New!B2"), ("'Old':Old!A1", "New:New!A1"),
])
def test_sheet_refs(spark, formula, want):
    names = F.create_map(F.lit("Old"), F.lit("New"), F.lit("It's"), F.lit("a b'c"))
    d = spark.createDataFrame([(formula,)], "f string")
    assert d.select(formulas.sheet_refs(F.col("f"), names)).first()[0] == want


def test_batches():
    """Against lists: a full batch hands its last headings on, but never its only row."""
    rnd = random.Random(3)
    for _ in range(300):
        heads = [rnd.random() < 0.5 for _ in range(rnd.randrange(1, 30))]
        size = rnd.randrange(1, 6)
        done, now = [], []
        for i in range(len(heads)):
            if len(now) >= size:
                cut = len(now)
                while cut > 1 and heads[now[cut - 1]]:
                    cut -= 1
                done.append(now[:cut])
                now = now[cut:]
            now.append(i)
        want = [n for n, batch in enumerate([*done, now]) for _ in batch]
        step, got = folds.batches(size, "t")(), []
        for i in range(len(heads)):
            run = next((j for j in range(i, len(heads)) if not heads[j]), len(heads)) - i
            got.append(step({"t": min(run, len(heads) - 1 - i)})[0])
        assert got == want


def test_columns(spark):
    """Boxes of a chain are one column; a touch of a quarter of the width or less joins none."""
    rows = [(1, 3, 0.0, 10.0), (1, 2, 8.0, 20.0), (1, 1, 16.0, 30.0), (1, 9, 27.5, 37.5), (2, 4, 0.0, 0.0)]
    b = spark.createDataFrame(rows, "page long, box_id long, x0 double, x1 double")
    assert {(r.box_id, r.col) for r in layout.columns(b).collect()} == {(3, 3), (2, 1), (1, 1), (9, 9), (4, 4)}


@pytest.mark.parametrize(("boxes", "want"), [
    ([], []), ([(0, 0, 1, 1)], [0]),
    ([(0, 20, 40, 30), (60, 20, 99, 30), (0, 40, 40, 50), (60, 40, 99, 50), (0, 0, 99, 10)], [4, 0, 2, 1, 3]),
    ([(0, 20, 50, 30), (0, 0, 50, 10), (40, 40, 90, 50)], [1, 0, 2]),
    ([(5, 0, 20, 10), (0, 5, 15, 12)], [0, 1]),
])
def test_reading_order(boxes, want):
    assert layout.reading_order(np.array(boxes, float).reshape(-1, 4)) == want


def test_stacked():
    step = folds.stacked("a", "b")()
    assert [step({"a": a, "b": b})[0] for a, b in ((0, 10), (2, 9), (9, 19), (12, 18), (30, 31))] == [0, 0, 1, 1, 2]


def test_window():
    page = [f"{i} " * 10 for i in range(9)]
    assert answers.window(page, {0}, (4, 5)).startswith("# 0 0") and len(answers.window(page, set(), (4, 5), 50)) == 50
    assert answers.window(page, set(), (4, 5), 30).split("\n")[0] == "3 3 3 3 3 3 3 3 3 3"
    assert answers.window(["a", None, " b  c "], {2}, (0, 1)) == "a\n# b c" and answers.window([], set(), (0, 1)) == ""


@pytest.mark.parametrize(("text", "want"), [
    (None, None), ("", None), ("3", None), ("{}", {}), ('[{"id": 1, "text": "a"}, 2]', {"1": "a"}),
    ('x ```json\n{"translations": [{"id": "b", "translated_text": "c"}]}``` y', {"b": "c"}), ('{"k": "v", "n": 1}', {"k": "v"}),
])
def test_translations(text, want):
    assert answers.translations(text) == want
