"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_tags(c: Column) -> Column:
    """Tagged text without its [[n]] and [[/n]] marks, orphans included."""
    return F.regexp_replace(c, r"\[\[/?\d+\]\]", "")


def tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\[\[/?\d+\]\])"), F.lit(1))


def tags_ok(source: Column, target: Column) -> Column:
    """Whether both texts carry the same tags, each as often."""
    return F.array_sort(tags(source)) == F.array_sort(tags(target))


def numbers(c: Column) -> Column:
    """Runs of digits of any script, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1))


def truncated(c: Column, limit: int, mark: str = "…[tronqué]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def file_name(c: Column) -> Column:
    """Stem with all but letters and digits as single underscores, 50 characters, never empty."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    s = F.substring(F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"), "_+", "_"), 1, 50)
    return F.when(F.regexp_replace(s, "_", "") == "", "document").otherwise(s)


def is_numeric(c: Column) -> Column:
    """Whether a cell's text reads as a number: comma as point; spaces and per cent signs aside."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[  %]", ""), ",", ".")
    return s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def valid_sheet_name(c: Column) -> Column:
    return (F.length(c) > 0) & (F.length(c) <= 31) & ~c.rlike(r"[:\\/?*\[\]']")


def column_number(ref: Column) -> Column:
    """Column of a cell reference, A as 1."""
    letters = F.split(F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1)), "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def format_literals(code: Column) -> Column:
    """Quoted parts of a number format that are not blank."""
    return F.filter(F.regexp_extract_all(code, F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.trim(x) != "")


def tag_cell(runs: Column) -> Column:
    """A cell's runs with their marks; nothing where the whole cell is blank or a number."""
    whole = F.array_join(runs, "")
    marked = F.array_join(F.transform(runs, lambda x, i: F.concat(F.lit("[["), i, F.lit("]]"), x, F.lit("[[/"), i, F.lit("]]"))), "")
    return F.when((F.trim(whole) == "") | is_numeric(whole), "").otherwise(marked)


def page_set(spec: Column) -> Column:
    """Sorted pages of a list such as 1-5, 8: ranges either way round, what does not read left out."""
    tokens = F.transform(F.split(spec, ","), lambda t: F.trim(t))
    good = F.filter(tokens, lambda t: t.rlike(r"^\+?\d+(\s*-\s*[+-]?\d+)?$"))
    ends = F.transform(good, lambda t: F.struct(F.regexp_extract(t, r"^(\+?\d+)", 1).cast("long").alias("a"), F.when(t.rlike(r"^\+?\d+$"), F.regexp_extract(t, r"^(\+?\d+)", 1)).otherwise(F.regexp_extract(t, r"-\s*([+-]?\d+)$", 1)).cast("long").alias("b")))
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(F.greatest(F.least(e["a"], e["b"]), F.lit(0).cast("long")), F.greatest(e["a"], e["b"], F.lit(0).cast("long")))))
    out = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p >= 1)))
    return F.when(F.size(out) > 0, out)


def page_token(pages: Column) -> Column:
    lo, hi = F.array_min(pages).cast("string"), F.array_max(pages).cast("string")
    whole = F.array_max(pages) - F.array_min(pages) + 1 == F.size(pages)
    return F.when(pages.isNull(), "").when(F.size(pages) == 1, F.concat(F.lit("p"), lo)).when(whole, F.concat(F.lit("p"), lo, F.lit("-"), hi)).otherwise(F.concat(F.lit("p"), F.substring(F.sha1(F.array_join(pages, ",")), 1, 8)))


def phone(raw: Column, country: str = "237") -> Column:
    """Digits; nine of them that begin with 6 get the country code."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(digits.rlike("^6[0-9]{8}$"), F.concat(F.lit(country), digits)).otherwise(digits)


#: Prefixes of national numbers by operator.
OPERATORS = [("mtn_momo", "^6(5[0-4]|7[0-9]|8[0-4])"), ("orange_money", "^6(5[5-9]|9[0-9]|8[5-9])")]


def phone_operator(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    local = F.when(digits.rlike("^237[0-9]{9}$"), F.substring(digits, 4, 9)).otherwise(digits)
    out = F.lit(None).cast("string")
    for name, prefix in reversed(OPERATORS):
        out = F.when((F.length(local) == 9) & local.rlike(prefix), name).otherwise(out)
    return out


#: Parts of font names by replacement family, weight and base family, tried in this order.
FAMILIES = [
    ("oswald", ("oswald", "condens", "compress", "narrow", "impact")),
    ("montserrat", ("avenir", "proxima", "futura", "gotham", "montserrat", "circular", "gothic", "geometr", "poppins", "brandon", "century gothic")),
    ("ptserif", ("ptserif", "pt serif", "merri", "georgia", "cambria", "minion", "garamond", "times", "roman", "serif", "book antiqua", "palatino")),
    ("roboto", ("roboto",)),
]
WEIGHTS = [("semibold", ("semibold", "demibold", "demi")), ("medium", ("medium",)), ("extrabold", ("extrabold", "ultrabold", "black", "heavy"))]
BASES = [("cour", ("mono", "courier", "consol", "typewriter")), ("times", ("times", "serif", "georgia", "garamond", "roman", "minion", "cambria", "book"))]


def _first_of(name: Column, table: list, otherwise: Column) -> Column:
    out = otherwise
    for kind, parts in reversed(table):
        out = F.when(name.rlike("|".join(parts)), kind).otherwise(out)
    return out


def font_family(name: Column) -> Column:
    return _first_of(F.lower(F.coalesce(name, F.lit(""))), FAMILIES, F.lit("opensans"))


def font_weight(name: Column, bold: Column) -> Column:
    return _first_of(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[ -]", ""), WEIGHTS, F.when(bold, "bold").otherwise("regular"))


def font_base(name: Column) -> Column:
    return _first_of(F.lower(F.coalesce(name, F.lit(""))), BASES, F.lit("helv"))


def joined_lines(lines: Column) -> Column:
    """A paragraph's lines as one text: a word cut by a hyphen at a line's end is made whole.

    Only the edges of two lines decide how they join, so the lines are put into one string, with a mark
    (2) between them that no line holds (1 escapes it), and each rule is one pass over that string."""
    marked = F.transform(lines, lambda x: F.replace(F.replace(x, F.lit("\x01"), F.lit("\x01\x03")), F.lit("\x02"), F.lit("\x01\x04")))
    one = F.regexp_replace(F.array_join(marked, "\x02"), r"^\s++|(?<!\s)\s*+\x02[\s\x02]*+|(?<!\s)\s++\z", "\x02")
    whole = F.regexp_replace(F.btrim(one, F.lit("\x02")), r"-\x02(?<=\p{L}-\x02)(?=\p{Ll})", "")
    clean = F.regexp_replace(F.translate(whole, "\x02", " "), r"\s{2,}", " ")
    return F.replace(F.replace(clean, F.lit("\x01\x04"), F.lit("\x02")), F.lit("\x01\x03"), F.lit("\x01"))


def ends_sentence(c: Column) -> Column:
    return c.rlike(r"""[.!?…]["”’')]*\s*$""")


def starts(c: Column, kind: str) -> Column:
    """Whether a line's first letter or digit is of a Unicode class."""
    return F.regexp_extract(c, r"([\p{L}\p{Nd}])", 1).rlike(rf"^\p{{{kind}}}")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_word(c: Column) -> Column:
    return F.btrim(F.split_part(_stripped(c), F.lit(" "), F.lit(1)), F.lit(""".,;:!?)]}»”"'"""))


def last_word(c: Column) -> Column:
    return F.lower(F.btrim(F.split_part(_stripped(c), F.lit(" "), F.lit(-1)), F.lit(""".,;:!?([{«"'""")))
