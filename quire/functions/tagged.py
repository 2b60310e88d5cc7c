"""Texts whose runs are marked [[n]] ... [[/n]]: parsing, comparison, defects, redistribution."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions import text as T

RUN = r"(?s)\[\[(\d+)\]\](.*?)\[\[/\1\]\]"
#: What separates words at a run's end.
GAPS = (" ", " ", "\t")


def parse(c: Column) -> Column:
    """Map of run number to text; of runs with one number the last counts."""
    found = F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(RUN), F.lit(1)), lambda x: x.cast("int")).alias("n"), F.regexp_extract_all(c, F.lit(RUN), F.lit(2)).alias("t"))
    keys = F.array_distinct(F.transform(found, lambda x: x["n"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(found, lambda x: x["n"] == k), -1)["t"])
    return F.map_from_arrays(keys, last)


def conforms(c: Column, n: int) -> Column:
    """Whether runs 0 to n - 1 are all there and closed."""
    return F.size(F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.map_keys(parse(c)))) == 0


@F.pandas_udf(StringType())
def norm(s: pd.Series) -> pd.Series:
    """Comparable form: no accents, no case, single spaces; compatibility characters unfolded."""
    def one(x: str | None) -> str:
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", x or "") if unicodedata.combining(ch) == 0)
        return " ".join(plain.lower().split())

    return s.map(one)


def aligned(parts: list[Column]) -> Column:
    """Whether each boundary between two runs lies between two words."""
    ends = lambda p: reduce(lambda x, y: x | y, [F.endswith(p, F.lit(g)) for g in GAPS])
    begins = lambda p: reduce(lambda x, y: x | y, [F.startswith(p, F.lit(g)) for g in GAPS])
    return reduce(lambda x, y: x & y, [ends(a) | begins(b) for a, b in zip(parts, parts[1:], strict=False)], F.lit(True))


def copied(parts: list[Column], out: list[Column]) -> Column:
    """Numbers of the runs given back as they were, if another one changed; only runs with a letter."""
    same = [norm(a) == norm(b) for a, b in zip(parts, out, strict=True)]
    hits = F.array_compact(F.array(*[F.when(s & p.rlike(r"\p{L}"), F.lit(i)) for i, (s, p) in enumerate(zip(same, parts, strict=True))]))
    mixed = ~reduce(lambda x, y: x & y, same) if len(parts) > 1 else F.lit(False)
    return F.when(mixed, hits).otherwise(F.array().cast("array<int>"))


def plain(c: Column) -> Column:
    return T.strip_tags(c)


def openings(c: Column) -> Column:
    """Opening parentheses, full-width ones too, but for endings in brackets within a word."""
    t = F.translate(plain(c), "（", "(")
    return F.length(t) - F.length(F.translate(t, "(", "")) - F.regexp_count(t, F.lit(r"[a-zà-ÿ]\([a-zà-ÿ]{1,3}\)"))


def run_texts(c: Column, n: int) -> list[Column]:
    """The texts of runs 0 to n - 1, empty where missing."""
    return [F.coalesce(F.element_at(parse(c), F.lit(i)), F.lit("")) for i in range(n)]


def defects(source: Column, target: Column, n: int, same_runs: Column) -> Column:
    """Names of what is wrong with a translation of a text of n runs, in a fixed order. ``same_runs``:
    copied() of both texts' runs, as a column of its own (it holds an Arrow function)."""
    digits = lambda c: F.array_sort(T.numbers(plain(c)))
    return F.array_compact(F.array(
        F.when(~conforms(target, n), "balises").when(F.size(same_runs) > 0, "recopie"),
        F.when(digits(source) != digits(target), "nombres"),
        F.when(openings(target) > openings(source), "ajout"),
    ))


def spread(parts: list[str], text: str) -> list[str]:
    """A translation dealt over the source's runs, one text for each run.

    A complete answer is taken as it is. Of an incomplete one the given runs stay and the others are
    emptied where runs cut words; where they do not, words are dealt by the runs' lengths, at least
    one each, and the last run takes the rest. Where that cannot be, the longest run takes all."""
    if not parts:
        return []
    given = {int(n): t for n, t in re.findall(RUN, text or "")}
    if all(i in given for i in range(len(parts))):
        return [given[i] for i in range(len(parts))]
    words = re.sub(r"\[\[/?\d+\]\]", "", text or "").strip()
    if len(parts) == 1:
        return [words]
    clean = all(a.endswith(GAPS) or b.startswith(GAPS) for a, b in zip(parts, parts[1:], strict=False))
    if given and not clean:
        return [given.get(i, "") for i in range(len(parts))]
    tokens, out = words.split(), [""] * len(parts)
    if not clean or len(tokens) < len(parts):
        lengths = [len(p.strip()) for p in parts]
        out[lengths.index(max(lengths))] = words
        return out
    total, at = max(1, sum(map(len, parts))), 0
    for i, p in enumerate(parts[:-1]):
        left = len(tokens) - at - (len(parts) - 1 - i)
        n = max(1, min(round(len(tokens) * len(p) / total), left))
        out[i], at = " ".join(tokens[at : at + n]), at + n
    out[-1] = " ".join(tokens[at:])
    for i in range(len(parts) - 1):
        if parts[i].endswith(GAPS):
            out[i] += " "
        elif parts[i + 1].startswith(GAPS):
            out[i + 1] = " " + out[i + 1]
    return out


@F.pandas_udf(ArrayType(StringType()))
def redistributed(parts: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([spread(list(p), t) for p, t in zip(parts, text, strict=True)])
