"""Fragment operators: resume, memory, reattachment, string tables, term consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.tagged import norm, plain


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, text) of each line of a text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


def inject(fragments: DataFrame, translations: DataFrame) -> DataFrame:
    """Each fragment's translation by id, or its own text."""
    t = translations.select("doc_id", "seq", F.col("text").alias("tr"))
    return fragments.join(t, ["doc_id", "seq"], "left").select("doc_id", "seq", F.coalesce("tr", "text").alias("text"))


def remaining(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fragments that no earlier run holds under the same id with the same text."""
    return current.join(previous.select("doc_id", "seq", "text"), ["doc_id", "seq", "text"], "left_anti")


def memory(fragments: DataFrame, key) -> DataFrame:
    """First place of each key of a document."""
    return fragments.withColumn("key", key).where("key <> ''").groupBy("doc_id", "key").agg(F.min("seq").alias("first_seq"))


def reattach(new: DataFrame, old: DataFrame, page) -> DataFrame:
    """Pages whose fragments all have a translation from before: all or nothing."""
    o = old.select("doc_id", F.col("text").alias("t")).distinct().withColumn("hit", F.lit(True))
    n = new.withColumn("page", page)
    m = n.join(o, (n.doc_id == o.doc_id) & (F.col("text") == F.col("t")), "left").select(n.doc_id, "page", "hit")
    return m.groupBy("doc_id", "page").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("whole"), F.count("*").alias("n"))


def pair_words(pairs: DataFrame) -> DataFrame:
    """doc_id, turn, word, kept: each source word of a pair in comparable form, marks aside, and whether
    the target holds it too. Pairs without a target are left out: they are not translated yet."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(norm(plain(c)), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    w = pairs.where(F.trim("target") != "").select("doc_id", "turn", words(F.col("source")).alias("s"), words(F.col("target")).alias("t"))
    return w.select("doc_id", "turn", "t", F.explode("s").alias("word")).select("doc_id", "turn", "word", F.array_contains("t", F.col("word")).alias("kept"))


def inconsistent_terms(pairs: DataFrame) -> DataFrame:
    """Words of a document that stay in one pair's target and are translated in another's."""
    g = pair_words(pairs).groupBy("doc_id", "word").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("translated"))
    return g.where("kept > 0 and translated > 0").select("doc_id", "word", "translated")
