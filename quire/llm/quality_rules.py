"""Host-level quality rules.

Text rules give each document a verdict; failures are then summed by host, each host's failure
rate is shrunk towards the corpus by an empirical beta prior (method of moments over hosts), and
the host's verdict is joined back to its documents.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated
rows count and return as often as they come; an empty table returns no row; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, chunks, per_doc, span_hashes, stored

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = Words(texts)
    n, buf, bounds = w.n, w.buf, w.bounds
    solid = ~SPACE[buf]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # lines: a text's last line ends at the line feed that joins the texts
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    solids = np.concatenate([[0], np.cumsum(solid)])
    full = solids[ends] > solids[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(bounds, starts, "right") - 1
    _, first = np.unique(np.stack([doc.astype(np.uint64), span_hashes(buf, starts, ends)], 1), axis=0, return_index=True) if len(doc) else (0, np.zeros(0, int))
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    # words in windows found more than once in their text
    at, h = w.windows(5)
    covered = np.zeros(len(w.doc) + 5, bool)
    if len(at):
        order = np.lexsort((h, w.doc[at]))
        s, d = h[order], w.doc[at][order]
        same = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
        again = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        for i in range(5):
            covered[again + i] = True
    repeat = np.bincount(w.doc[covered[: len(w.doc)]], minlength=n)
    return [w.counts, per_doc(solid & ((buf & 0xC0) != 0x80), bounds), per_doc(symbol[buf], bounds), dup, repeat]


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and the five measures of its texts, in one pass without a shuffle."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks((b.set_column(b.schema.get_field_index(text_col), text_col, b.column(text_col).fill_null("")) for b in batches), text_col):
            cols = [pa.array(x.astype(np.int64)) for x in measure(texts)]
            keep = [i for i, f in enumerate(rows.schema) if f.name != text_col]
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in keep] + cols, [rows.schema.field(i).name for i in keep] + names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInArrow(run, f"{kept}, {MEASURES}")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """One row per document: doc_id, host, the measures, base_failed, host_rate, kept.

    host_rate is the posterior mean (a + failures) / (a + b + documents) of the host's failure
    rate under a beta prior fitted to all hosts; a document is kept if it passes its own rules and
    its host's rate is at most ``max_host_rate``. Only one row per host is joined back."""
    base = with_measures(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")))
    base = stored(base.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))), "quality")
    return base.join(host_rates(base).select(F.col("host").alias("h"), "host_rate"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def host_rates(base: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, host_rate: the beta prior has the mean of all documents and the
    strength that explains how far hosts' rates spread beyond binomial noise, 1 at least."""
    hosts = base.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    # moments over hosts as sums: one row to the driver
    one = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("m"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("k2")).first()
    mu, strength = 0.0, 1e4
    if one.n:
        mu = one.k / one.n
        noise, scale = mu * (1 - mu), one.n - one.n2 / one.n
        between = one.k2 - one.n * mu * mu  # sum of n (rate - mu)^2
        rho = (between - (one.m - 1) * noise) / (scale * noise) if noise > 0 and scale > 0 else 0.0
        strength = max(1.0, 1 / rho - 1) if rho > 1e-4 else strength
    return hosts.select("host", "n_docs", "n_failed", ((F.lit(mu * strength) + F.col("n_failed")) / (F.lit(strength) + F.col("n_docs"))).alias("host_rate"))
