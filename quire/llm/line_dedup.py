"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines are near if their UTF-8 bytes differ by no more edits than the class of the shorter one
allows: none below 8 bytes (copies only if equal), one below 16, two beyond, unless other classes are given. Distinct lines are split into threshold + 1
segments; two lines within the threshold share a segment, whose place in the longer line is bounded by the
length difference and the edits to its left and right. Segments (indexed by line length) and those
substrings (probes) meet as hashed keys; only keys of two lines or more survive, and candidate pairs
are verified by a banded bit-parallel edit distance. Lines linked by chains of such pairs are one
class, and only the first line of a class, by document id and position, stays. Lines without a word
always stay.

The distinct lines are written bucketed by their hash, so that the texts of candidates are joined
without moving the other lines again.

Defined cases: a null text is empty (one line, kept); null ids sort first; rows that repeat both id
and text are one document and return as often as they come; an empty table returns no row; other
columns pass through untouched whatever their names. Lines are named by 64-bit hashes; of two lines
with one hash only the earlier takes part in near classes, the other stays.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, discard, fresh, release, scratch, stored
from .graph import components

#: (threshold, bytes from which it holds), both rising. A line has 4 keys at threshold 1, 12 at 2, 26
#: at 3, and about 2 tau^2 + 2 tau + 1 beyond: each step costs that share of the run.
Classes = tuple[tuple[int, int], ...]
CLASSES: Classes = ((1, 8), (2, 16))


def allowed(n: Column, classes: Classes) -> Column:
    """Edits by which a line of ``n`` bytes, the shorter of two, may differ from the other."""
    return reduce(lambda out, c: F.when(n >= c[1], c[0]).otherwise(out), classes, F.lit(0))


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line; the last ones are longer."""
    base = F.shiftright(length, 1) if tau == 1 else F.floor(length / (tau + 1)).cast("int")
    longer = length - base * (tau + 1)  # this many segments at the end have one more
    start = base * (i - 1) + F.greatest(F.lit(0), longer - (tau + 1 - (i - 1))) + 1
    return start.cast("int"), (base + F.when(longer >= tau + 2 - i, 1).otherwise(0)).cast("int")


def keys(line: Column, n: Column, tau: int) -> Column:
    """The line's index keys (odd) and probe keys (even), the latter for lengths down to tau below
    its own; the places follow from at most i - 1 edits left of segment i and tau + 1 - i right of it.
    line: its bytes, n: their number."""

    def key(gap: int, i: int, shift: int, own: bool) -> Column:
        start, size = _segment(n - gap, i, tau)
        h = F.xxhash64(((n - gap) * 64 + tau) * 64 + i, F.substring(line, start + shift, size))
        return h.bitwiseOR(F.lit(1)) if own else h.bitwiseAND(F.lit(-2))

    out = [key(0, i, 0, True) for i in range(1, tau + 2)]
    for gap in range(tau + 1):
        for i in range(1, tau + 2):
            lo, hi = max(1 - i, gap - (tau + 1 - i)), min(i - 1, gap + (tau + 1 - i))
            out += [key(gap, i, s, False) for s in range(lo, hi + 1) if gap or s]
    return F.array(*out)


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix of two strings, at most ``most``: a search by halves."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= most) & (F.substring(a, acc + 1, s) == F.substring(b, acc + 1, s)), acc + s).otherwise(acc))


def within(a: str, b: str, tau: int) -> Column:
    """Whether string columns ``a`` and ``b`` differ by at most ``tau`` edits.

    Equal ends are cut off; over the rest runs a banded bit-parallel automaton: after j characters
    of b, bit d + tau of field k says that j + d characters of a match with at most k edits. The
    tau + 1 fields of 2 tau + 1 bits are one integer, and a character updates all of them. From five
    edits on they don't fit into one; the built-in banded distance verifies then."""
    if tau > 4:
        return F.levenshtein(a, b, tau) >= 0
    width = 2 * tau + 1
    full = (1 << width) - 1

    def shifted(field: Column, by: int) -> Column:
        return F.shiftleft(field, by).bitwiseAND(F.lit(full)) if by > 0 else F.shiftright(field, -by)

    def step(xs: Column, y: Column, at: Column, state: Column) -> Column:
        def update(match: Column) -> Column:
            old = [F.shiftright(state, k * width).bitwiseAND(F.lit(full)) for k in range(tau + 1)]
            new: list[Column] = []
            for k in range(tau + 1):
                v = old[k].bitwiseAND(match)
                if k:  # a character of b replaced or dropped, or one of a dropped
                    v = v.bitwiseOR(old[k - 1]).bitwiseOR(shifted(old[k - 1], -1)).bitwiseOR(shifted(new[k - 1], 1))
                new.append(v)
            return _either([F.shiftleft(c, k * width) for k, c in enumerate(new)])

        return _let(_either([F.when((at + d >= 1) & (F.get(xs, at + d - 1) == y), 1 << (d + tau)).otherwise(0) for d in range(-tau, tau + 1)]), update)

    start = 0
    for k in range(tau + 1):
        start |= sum(1 << (d + tau) for d in range(k + 1)) << (k * width)

    def run(v: Column) -> Column:
        """v: the characters between the equal ends."""
        n, m = F.size(v["x"]), F.size(v["y"])
        end = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), F.lit(start), lambda state, at: step(v["x"], F.element_at(v["y"], at), at, state))
        return F.call_function("shiftright", end, (tau * width + tau + n - m).cast("int")).bitwiseAND(F.lit(1)) == 1

    def rest(v: Column) -> Column:
        """v: the strings after their equal heads."""
        la, lb = F.length(v["a"]), F.length(v["b"])
        tail = _common(F.reverse(v["a"]), F.reverse(v["b"]), F.least(la, lb))
        return _let(tail, lambda t: _let(F.struct(_chars(F.substring(v["a"], F.lit(1), la - t)).alias("x"), _chars(F.substring(v["b"], F.lit(1), lb - t)).alias("y")), run))

    a_, b_ = F.col(a), F.col(b)
    la, lb = F.length(a_), F.length(b_)
    return F.when(F.abs(la - lb) > tau, False).otherwise(_let(_common(a_, b_, F.least(la, lb)), lambda h: _let(F.struct(F.substring(a_, h + 1, la).alias("a"), F.substring(b_, h + 1, lb).alias("b")), rest)))


def _either(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), cols)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often its expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def distinct_lines(docs: DataFrame) -> tuple[DataFrame, str]:
    """id, line, n (times it comes), first (its first place) of each distinct line with a word, as a
    table bucketed by id, and the table's name."""
    spark = docs.sparkSession
    lines = docs.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(WORD))
    grouped = lines.groupBy(F.xxhash64("line").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("doc", "key", "pos", "line")).alias("x"))
    out = grouped.select("id", "n", F.struct("x.doc", "x.key", "x.pos").alias("first"), F.col("x.line").alias("line"))
    name = f"quire_lines_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out.write.bucketBy(buckets, "id").option("compression", "zstd").option("path", scratch(spark, "lines")).saveAsTable(name)
    release(spark)
    return spark.table(name), name


def letters(line: Column) -> list[Column]:
    """How often each pair of neighbours of the alphabet comes in a line."""
    pairs = ["".join(chr(c) + chr(c).upper() for c in (i, i + 1)) for i in range(ord("a"), ord("z"), 2)]
    return [(F.length(line) - F.length(F.translate(line, x, ""))).alias(f"n_{x[0]}") for x in pairs]


def links(lines: DataFrame, classes: Classes = CLASSES) -> DataFrame:
    """(a, b): ids of distinct lines within the edits allowed; they link each pair's lines by chains.

    A line first meets the first line of each of its keys; then only lines of one key that no chain
    links yet meet, so that a large group of near copies is not a square of pairs."""
    sized = lines.select("id", F.col("line").cast("binary").alias("line"), F.octet_length("line").alias("n"))
    some = []
    for (tau, lo), above in zip(classes, (*[c[1] for c in classes[1:]], None), strict=True):
        mine = sized.where(F.col("n") >= lo)
        mine = mine if above is None else mine.where(F.col("n") < above + tau)  # the longer line of a pair may be in the next class
        some.append(mine.select("id", F.explode(keys(F.col("line"), F.col("n"), tau)).alias("k")))
    rows = reduce(DataFrame.union, some)
    w = W.partitionBy(F.shiftright("k", 1))
    live = rows.withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w)}).where("lo < hi")
    live = stored(live.select(F.shiftright("k", 1).alias("key"), "lo", "id", (F.col("k").bitwiseAND(F.lit(1)) == 1).alias("own")), "line-keys")
    used = lines.join(live.select("id").distinct().hint("merge"), "id", "left_semi")
    plain = F.decode(F.col("line").cast("binary"), "ISO-8859-1")  # a character for each byte
    used = stored(used.select("id", F.octet_length("line").alias("n"), plain.alias("line"), *letters(F.col("line"))), "line-texts", small=True)
    # an edit changes two letter counts by one at most: most chance meetings end here, unemitted
    counts = [c for c in used.columns if c not in ("id", "line")]
    side = lambda x: used.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in counts])
    tau = allowed(F.least("a_n", "b_n"), classes)
    apart = reduce(lambda x, y: x + y, [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in counts if c != "n"])
    may = (F.abs(F.col("a_n") - F.col("b_n")) <= tau) & (apart <= 2 * tau)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        text = used.select("id", "line", "n")
        both = pairs.join(text.toDF("a", "x", "nx"), "a").join(text.toDF("b", "y", "ny"), "b")
        edits = allowed(F.least("nx", "ny"), classes)
        near = reduce(lambda out, c: F.when(edits == c[0], within("x", "y", c[0])).otherwise(out), classes, F.lit(False))
        return stored(both.where(near).select("a", "b"), name, small=True)

    first = live.where("lo < id").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    first = verified(first.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b"), "line-links")
    of = components(first, native=True)
    met = live.select("key", "id", "own").join(of, F.col("id") == F.col("node"), "left").select("key", "id", "own", F.coalesce("component", "id").alias("of"))
    own = met.where("own").select(F.col("key").alias("k"), F.col("id").alias("a"), F.col("of").alias("a_of")).join(side("a"), "a")
    met = met.withColumnRenamed("id", "b").join(side("b"), "b")
    pairs = own.join(met, (F.col("k") == F.col("key")) & (F.col("a_of") != F.col("of")) & may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = verified(pairs, "line-links")
    discard(live)
    discard(used)
    return first.union(rest)


COUNTS = ("__n_lines", "__n_equal", "__n_near")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Classes = CLASSES) -> DataFrame:
    """``docs`` with the text reduced to its kept lines, and as its last three columns the number of
    lines, of those removed as equal to an earlier one, and of those removed as near one (COUNTS;
    longer names where ``docs`` has these)."""
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col), text)
    d = docs.select(id_.alias("doc"), key.alias("key"), text.alias("text"))
    lines, name = distinct_lines(d)
    linked = components(links(lines, classes), native=True)
    # the first place of each class, for the lines of classes of two lines or more
    member = lines.select("id", "first").join(linked.hint("merge"), F.col("id") == F.col("node"))
    member = stored(member.select("id", "first", "component"), "line-members", small=True)
    class_first = member.groupBy("component").agg(F.min("first").alias("cf")).withColumnRenamed("component", "c")
    near = stored(member.join(class_first, F.col("component") == F.col("c")).select("id", "cf"), "line-classes", small=True)
    busy = lines.join(near.hint("merge"), "id", "left").where("n > 1 or cf is not null")
    busy = busy.select(F.col("id").alias("h"), F.hash("line").alias("h2"), F.length("line").alias("len"), "first", F.coalesce("cf", "first").alias("cf"))
    at = d.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(WORD))
    at = at.select(F.struct("doc", "key", "pos").alias("at"), F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), F.length("line").alias("len"))
    gone = at.join(busy, ["h", "h2", "len"]).where("at <> cf").select("at.doc", "at.key", "at.pos", (F.col("first") == F.col("cf")).alias("equal"))
    # an equal line may also be a copy within a near class: it counts as near only if its text differs from the first's
    gone = stored(gone.distinct(), "line-gone", small=True)
    spark.sql(f"DROP TABLE {name}")
    discard(lines)
    n, e, g, i, k = fresh(docs, "__doc", "__equal", "__gone", "__id", "__key")
    per = gone.groupBy("doc", "key").agg(F.collect_list("pos").alias(g), F.count_if("equal").alias(e)).withColumnsRenamed({"doc": i, "key": k})
    whole = docs.withColumns({n: id_, f"{k}x": key})
    out = whole.join(per.hint("shuffle_hash"), (F.col(n) == F.col(i)) & (F.col(f"{k}x") == F.col(k)), "left")
    every = F.split(text, "\n")
    # a lookup by place: no search through the removed lines for each line
    rest = _let(every, lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col(g)), lambda at: F.get(v, at)), "\n"))
    equal = F.coalesce(F.col(e), F.lit(0)).cast("long")
    names = fresh(docs, *COUNTS)
    more = [F.size(every).cast("long").alias(names[0]), equal.alias(names[1]), (F.coalesce(F.array_size(g), F.lit(0)) - equal).cast("long").alias(names[2])]
    kept = F.when(F.col(g).isNull(), text).otherwise(rest).alias(text_col)
    return out.select(*[kept if c == text_col else F.col(f"`{c}`") for c in docs.columns], *more)
