"""The pipeline's stages on the smallest test table: what each may change, and the packing."""

import re
from collections import defaultdict

import corpus_pipeline
from quire.llm.common import stored

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        docs = stored(out, "test-stage")
        seen.append(docs.collect())
    raw, ruled, lined, single, mixed, packed = seen
    texts = {r.doc_id: r.text for r in raw}
    assert all(r.text == texts[r.doc_id] for r in ruled) and len(ruled) >= len(raw) / 2
    assert {r.doc_id for r in lined} <= {r.doc_id for r in ruled}
    near, sets = set(), {r.doc_id: shingles(r.text) for r in lined}
    link = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                link[a].add(b)
    want = set()
    for a in sorted(sets):
        if a not in near:
            want.add(a)
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in near:
                    near.add(x)
                    todo += link[x]
    assert sorted(r.doc_id for r in single) == sorted(want)
    assert {r.doc_id for r in mixed} <= want
    assert max(list(map([r.doc_id for r in mixed].count, want))) <= 2
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 1024


def test_odd_rows(spark):
    """Null and repeated ids, null and empty texts, clashing names: each row is decided by itself."""
    good = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"term{i}" for i in range(40))
    rows = [(1, good), (1, "too short"), (None, other), (None, None), (2, ""), (3, good), (3, good)]
    names = ("__id", "__times", "__copy", "__doc", "size", "kept", "host")
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(7)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    ruled = stored(corpus_pipeline.rules(spark, d, SF), "odd")
    assert ruled.columns == d.columns
    assert sorted(r.text for r in ruled.collect()) == sorted([good, other, good, good])
    single = stored(corpus_pipeline.near_copies(spark, ruled, SF), "odd")
    assert sorted(r.text for r in single.collect()) == sorted([good, other])
    mixed = corpus_pipeline.mix(spark, stored(single, "odd"), SF)
    assert mixed.columns == d.columns and all(tuple(r)[5:] == tuple(range(7)) for r in mixed.collect())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
