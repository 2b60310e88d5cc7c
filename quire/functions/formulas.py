"""References in formulas, as column expressions: a formula is cut into the tokens of one pattern and
what lies between them, and each token is changed on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of names that need no quotes, of string literals, and of references.
PLAIN = r"[A-Za-z_À-ɏ][A-Za-z0-9_.À-ɏ]*"
LITERAL = r'"(?:[^"]|"")*"'
SHEET = rf"(?:\[\d+\])?(?:'(?:[^']|'')+'|{PLAIN})\s*[!:]"
COLUMN = r"\[[^\[\]]*\]"


def each_token(formula: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    gaps = F.split(formula, pattern)
    tokens = F.transform(F.regexp_extract_all(formula, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def cited(name: Column) -> Column:
    """A sheet's name as a reference holds it: in quotes, and its own doubled, unless it is plain."""
    return F.when(name.rlike(f"^{PLAIN}$"), name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def sheet_refs(formula: Column, names: Column) -> Column:
    """``formula`` with its sheets renamed by the map ``names``; literals and other workbooks' sheets stay."""

    def change(token: Column) -> Column:
        held = F.regexp_extract(token, r"(?s)^(.*?)\s*[!:]$", 1)
        name = F.when(held.startswith("'"), F.replace(F.regexp_extract(held, "(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(held)
        to = F.try_element_at(names, name)
        return F.when(token.rlike(r'^["\[]') | to.isNull(), token).otherwise(F.concat(cited(to), F.regexp_extract(token, r"(\s*[!:])$", 1)))

    return each_token(formula, f"{LITERAL}|{SHEET}", change)


def column_refs(formula: Column, names: Column) -> Column:
    """``formula`` with the columns in brackets renamed, also those of this row (@); keywords (#) stay."""

    def change(token: Column) -> Column:
        at = F.regexp_extract(token, r"^\[(@?)", 1)
        to = F.try_element_at(names, F.regexp_extract(token, r"(?s)^\[@?(.*)\]$", 1))
        return F.when(token.startswith("[#") | to.isNull(), token).otherwise(F.concat(F.lit("["), at, to, F.lit("]")))

    return each_token(formula, COLUMN, change)
