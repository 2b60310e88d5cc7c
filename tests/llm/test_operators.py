"""Corpus operators against brute force on small tables with nulls, ties, copies and odd texts."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import graph, html_extract, line_dedup, media, mixing, packing, quality_rules, repeats, shingle_join, suffix_tree, warc

random.seed(5)
WORDS = [f"w{i}" for i in range(60)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


BASE = [text(random.randrange(20, 90)) for _ in range(12)]
TEXTS = BASE + BASE[:4] + [b.replace("w7 ", "x ", 1) for b in BASE] + [BASE[0] + "\n" + BASE[1], "", None, " \n\t ", "one", "ab cd", "Ab CD", "a b c d e a b c d e\nx\nx", "é " * 40, "z" * 700, "z" * 900]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n string").repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_suffix_tree(docs):
    got = {r.doc_id: r for r in suffix_tree.score(docs, support=2).collect()}
    low = [(t or "").encode().lower().split() + [None] for t in TEXTS]
    c = Counter(w for i, ws in enumerate(low) if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(low):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0
    joined = {r.doc_id: r.score for r in suffix_tree.score(docs, support=2, broadcast=0).collect()}
    assert all(joined[i] == pytest.approx(got[i].score) for i in got)


def test_suffix_tree_vocabulary(docs):
    """How many words are at hand in each task changes no score: no word is cut by rank."""
    whole = {r.doc_id: r for r in suffix_tree.score(docs, support=2).collect()}
    few = {r.doc_id: r for r in suffix_tree.score(docs, support=2, vocabulary=3).collect()}
    assert any(r.score != pytest.approx(r.base_score) for r in whole.values())
    for i, r in whole.items():
        assert (few[i].n_known, few[i].base_score, few[i].score) == (r.n_known, pytest.approx(r.base_score), pytest.approx(r.score))


def suffix_tree_scores(texts, support):
    """Scores by trying every context of every length, and the words of the longest retained one."""
    low = [(t or "").lower().split() + [None] for t in texts]
    train = [ws for i, ws in enumerate(low) if zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for ws in train for w in ws)
    total, n = sum(one.values()), len(one)
    root = {w: (c + 0.1) / (total + 0.1 * (n + 1)) for w, c in one.items()}
    rest = 0.1 / (total + 0.1 * (n + 1))
    held, k = {}, 1
    after = {(): one}

    def prob(context, w):
        for i in range(len(context)):
            if context[i:] in held:
                symbols, weight = held[context[i:]]
                return symbols[w] if w in symbols else weight * prob(context[i + 1 :], w)
        return root.get(w, rest)

    while after:
        after = {}
        for ws in train:
            for i in range(k, len(ws)):
                after.setdefault(tuple(ws[i - k : i]), Counter())[ws[i]] += 1
        level = {}
        for s, cs in after.items():
            m, some = sum(cs.values()), {w: c for w, c in cs.items() if c >= support}
            if not some:
                continue
            q = {w: prob(s[1:], w) for w in some}
            f, qs = {w: c / m for w, c in some.items()}, sum(q.values())
            other = 1 - sum(f.values())
            kl = sum(f[w] * np.log(f[w] / q[w]) for w in some) + (other * np.log(other / (1 - qs)) if other > 1e-12 and qs < 1 else 0)
            if m * kl > len(some) * 0.5 * np.log(total) and qs < 1:
                p = {w: (c - 0.5) / m for w, c in some.items()}
                level[s] = p, (1 - sum(p.values())) / (1 - qs)
        held |= level
        k += 1
    return [sum(np.log10(prob(tuple(ws[:i]), w)) for i, w in enumerate(ws)) for ws in low], max(map(len, held))


def test_suffix_tree_depth(spark):
    """Contexts of any length: symbols that only a word far back tells apart."""
    rng = random.Random(3)
    texts = [text(30) for _ in range(20)]
    for _ in range(200):
        a = rng.randrange(4)
        texts.append(f"{text(3)} from{a} one two three four five six then to{a if rng.random() < 0.9 else rng.randrange(4)} {text(4)}")
    want, deepest = suffix_tree_scores(texts, 8)
    assert deepest == 8
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most in (1 << 22, 0):
        got = {r.doc_id: r.score for r in suffix_tree.score(d, broadcast=most).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_suffix_tree_pieces(spark):
    """Later rounds read only the words around places that may have support: of texts of 300 words of
    their own around a common passage of 20, the passage, not the texts."""
    common = words(" ".join(f"w{i}" for i in range(20)))
    texts = [[f"a{j}_{i}" for i in range(150)] + common + [f"b{j}_{i}" for i in range(150)] for j in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = suffix_tree.training(spark.createDataFrame(rows, "doc_id long, text string"))
    n = docs.where("not held_out").count()

    class All:
        def __init__(self, grams):
            self.value, self.keys = self, np.array(sorted(grams), np.uint64)

        def has(self, x):
            return np.isin(x, self.keys)

    t = suffix_tree.Tokens([" ".join(common).encode()])
    kept, grown, x = [], [None], t.hash[:20]
    for k in range(3):
        kept.append(All(x.tolist()))
        grown.append(All(x.tolist()))
        x = suffix_tree._grow(x[1:], t.hash[: len(x) - 1])
    got = suffix_tree.holding(docs, kept, grown, 3).collect()
    assert len(got) == n and all(np.frombuffer(r.lengths, np.int32).tolist() == [21] for r in got)
    assert all(np.frombuffer(r.pieces, np.uint64)[:20].tolist() == t.hash[:20].tolist() for r in got)


def test_suffix_tree_subtrees(spark):
    """Contexts that longer ones never improve on, such as the end of a passage of 150 words that goes
    on in two ways, make no rows for each of their lengths; with no room in a task the scores are the same."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [f"{passage} {'ab'[j % 2]} {' '.join(rng.choice(WORDS) for _ in range(3))}" for j in range(60)]
    docs = suffix_tree.training(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    counts = suffix_tree.word_counts(docs)
    n = counts.agg({"c": "sum", "word": "count"}).first()
    tree = suffix_tree.tree(docs, counts, n["sum(c)"], n["count(word)"], 8)
    assert tree.where("size = 1 and weight is not null").count() and tree.where("size > 4").count() < 40
    for a in range(4):
        texts += [f"from{a} one two three four five six then to{a if rng.random() < 0.9 else rng.randrange(4)} {rng.choice(WORDS)}" for _ in range(50)]
    texts += ["a " * 40] * 3 + ["a " * 30 + "b"] * 12
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, want = ({r.doc_id: r.score for r in suffix_tree.score(d, room=room).collect()} for room in (suffix_tree.ROOM, 0))
    assert got == pytest.approx(want) and [got[i] for i in range(len(texts))] == pytest.approx(suffix_tree_scores(texts, 8)[0])


def test_repeats(docs):
    raw = [(t or "").encode() for t in TEXTS]
    c = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    for hot in (20_000, 1):
        d = docs.selectExpr("doc_id", "coalesce(text, '') as text").selectExpr("doc_id as doc", "xxhash64(doc_id, text) as key", "text", "doc_id")
        spans = repeats.removed(d, hot=hot).collect()
        gone = {i: np.zeros(len(b) + 1, bool) for i, b in enumerate(raw)}
        for s in spans:
            gone[s.doc][s.first : s.first + s.n + 199] = True
        for i, b in enumerate(raw):
            want = np.zeros(len(b) + 1, bool)
            for p in range(len(b) - 199):
                if c[b[p : p + 200]] > 1:
                    want[p : p + 200] = True
            assert (gone[i] == want).all(), (i, hot)
    r = {x.doc_id: x for x in repeats.remove(docs).collect()}
    assert r[0].n_bytes == len(raw[0]) and r[TEXTS.index(None)].n_bytes == 0


def test_repeats_room():
    """20,000 contexts of one anchor, 3.5 million starts: what is held follows ``room``, with the same result."""
    rng = np.random.default_rng(1)
    tail = rng.integers(0, 256, 199, np.uint8).tobytes()
    contexts = [rng.integers(0, 3, 40, np.uint8).tobytes() + tail + bytes([i % 251] * 136) for i in range(20_000)]
    args = contexts, np.full(20_000, 160), np.full(20_000, 7, np.uint64), np.arange(20_000) % 5
    tracemalloc.start()
    got = repeats.merge(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak
    few = [x[:300] for x in args]
    assert [x.tolist() for x in repeats.merge(*few, room=500)] == [x.tolist() for x in repeats.merge(*few, room=1 << 30)]
    assert len(got) == 20_000 and len(got[0]) == 176


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.size == len(words(TEXTS[r.doc_id])) and r.taken in (0, r.size, 2 * r.size) for r in rows)
    total = sum(r.size for r in rows)
    by = {r.source: r for r in rows}
    assert sum(r.target for r in by.values()) == pytest.approx(1.5 * total)
    for s, r in by.items():
        assert r.target <= 2 * r.source_size + 1e-9
        mine = [x for x in rows if x.source == s]
        whole, sums = int(r.target // r.source_size) * r.source_size, {0}
        for x in mine:
            sums |= {y + x.size for y in sums}
        best = min(abs(whole + y - round(r.target)) for y in sums)
        assert abs(sum(x.taken for x in mine) - round(r.target)) == best
    assert sorted(rows) == sorted(mixing.mix(docs).collect())


def test_html():
    page = "<html><nav><a>Menu</a></nav><div class=ad>Buy</div><article><h1>T&amp;x</h1><p>a  b<br><p>c</p><aside>no</aside></article><footer>f</footer>"
    assert html_extract.keep(html_extract.lines(page), None) == ["T&x", "a b", "c"]
    one, two = "<div>same</div><div>mine</div><div>end</div>", "<div>same</div><div>yours</div><div>end</div>"
    assert html_extract.keep(html_extract.lines(one), html_extract.lines(two)) == ["mine"]
    assert html_extract.lines("") == []


def test_html_hostile():
    """Unclosed tags and quotes take time with the page's length only; text around them stays."""
    import time

    begin = time.time()
    for page in ("<a " * 350_000, "<a \"" * 250_000 + ">", "<p '" * 250_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 130_000, "<p>x" * 100_000):
        html_extract.lines(page)
    assert time.time() - begin < 60
    assert [x for x, _, _ in html_extract.lines("a < b <p title='x>y'>one<br>two</p> <!-- no --> 1<2 <")] == ["a < b", "one two", "1<2 <"]


def test_html_table(spark):
    rows = [(1, "http://a/x/1", "<p>menu</p><p>one</p>"), (2, "http://a/x/2", "<p>menu</p><p>two</p>"), (3, None, None), (4, "http://b/", "<p>alone</p>")]
    many = spark.createDataFrame([(i, f"http://h{i % 3}/p/{i}", f"<article>text {i}</article><p>x</p>") for i in range(60)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(many, per_range=10).collect()} == {i: f"text {i}" for i in range(60)}
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "two", 3: "", 4: "alone"}


def test_html_table_cuts(spark):
    """Pages at the cuts see their neighbours beyond them: the text does not depend on the ranges."""
    pages = [(i, f"http://h{i // 2:03}/p/{i}", f"<p>menu {i // 2}</p><p>text {i}</p><p>end {i // 2}</p>") for i in range(120)]
    d = spark.createDataFrame([*pages, (None, None, None), (120, "http://z/", "<p>alone</p>")], "page_id long, url string, html string")
    for size in (2, 3, 7, 1000):
        got = {r.page_id: r.text for r in html_extract.extract(d, per_range=size).collect()}
        assert got == {i: f"text {i}" for i in range(120)} | {None: "", 120: "alone"}, size


def test_quality(docs):
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    for i, t in enumerate(TEXTS):
        w, r = words(t), got[i]
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, line + "\nshort\n\nonly here in the first of these"), (2, line.replace("quick", "quack") + "\nshort\nshorx"), (3, None), (4, line)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(d).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text == "shorx" and (got[2]["__n_equal"], got[2]["__n_near"]) == (1, 1)
    assert got[3].text is None or got[3].text == ""
    assert got[4].text == ""
    assert line_dedup.dedup(d.limit(0)).count() == 0


def test_lines_share(spark):
    """Longer lines may differ by more edits, and short ones by one or two: classes by brute force."""
    def lev(a, b):
        a, b = a.encode(), b.encode()
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    made = ["Ly. Reonhe onble.", "Ly reonhe onble."]
    for n in (6, 9, 15, 16, 31, 50, 119, 121, 160, 205, 240):
        first = "w" + letters(n - 1)
        for edits in (0, 1, 2, 3, 4, 5, 6, 7, 9):
            line = list(first)
            for _ in range(edits):
                at = rng.randrange(1, len(line))
                line[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "x", "y"])
            made.append("".join(line))
    made = list(dict.fromkeys(made))
    d = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    by_share = ((1, 8), (2, 16), (3, 120), (4, 160), (5, 200), (6, 240))
    for classes, most in ((by_share, lambda n: max(min(n // 8, 2), n // 40)), (line_dedup.CLASSES, lambda n: min(n // 8, 2))):
        up = list(range(len(made)))
        for i in range(len(made)):
            for j in range(i):
                if up[i] != up[j] and lev(made[i], made[j]) <= most(min(len(made[i].encode()), len(made[j].encode()))):
                    lo, hi = sorted((up[i], up[j]))
                    up = [lo if x == hi else x for x in up]
        assert up[1] == 0
        got = {r.doc_id: r["__n_near"] for r in line_dedup.dedup(d, classes=classes).collect()}
        assert got == {i: int(up[i] != i) for i in range(len(made))}


def test_lines_columns(spark):
    """Other columns, whatever their names, and a null id come through; a repeated row returns twice."""
    rows = [(None, "one line of words here", 1, 2, 3, 4, 5, 6, 7, 8)] * 2 + [(3, "one line of words here\nand two", 1, 2, 3, 4, 5, 6, 7, 8)]
    names = ("__doc", "__key", "__d", "__k", "__gone", "__eq", "__id", "__n_lines")
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.dedup(d)
    assert out.columns[:-3] == d.columns and len(set(out.columns)) == len(out.columns)
    got = sorted(out.collect(), key=lambda r: r.doc_id or 0)
    assert [r.text for r in got] == ["one line of words here"] * 2 + ["and two"]
    assert all(tuple(r)[2:10] == (1, 2, 3, 4, 5, 6, 7, 8) for r in got)


def test_edit_distance(spark):
    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    rows = [("".join(random.choice("abé") for _ in range(random.randrange(9))), "".join(random.choice("abé") for _ in range(random.randrange(9)))) for _ in range(300)]
    for r in spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.within("x", "y", 2).alias("w")).collect():
        assert r.w == (lev(r.x, r.y) <= 2), r


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small"), (4, "u", None), (5, "v", big), (6, "w", "small")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].refers_to for i in range(1, 7)] == [5, 5, None, None, None, None]
    assert all(got[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() and got[i].payload_bytes == len(h or "") for i, _, h in rows)


def test_media(docs):
    got = {r.doc_id: r for r in media.digest(media.with_media(docs)).collect()}
    for i, t in enumerate(TEXTS):
        p = media.pad((t or "").encode())
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-32:])
    p = bytes(random.randrange(256) for _ in range(1152))
    assert media.decode(media.encode(p))[1].tobytes() == p
    assert media.clips(media.with_media(docs)).count() >= len(TEXTS)


@pytest.mark.parametrize(("kind", "size", "bare"), [(10, (40, 24), False), (5, (37, 21), False), (5, (37, 21), True)])
def test_media_baseline(spark, kind, size, bare):
    """Frames of another writer: grey and colour, all coefficients, halved colour, sizes that are no
    multiple of a block, frames without Huffman tables."""
    jvm, (w, h) = spark._jvm, size
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, (5 * x % 256) << 16 | (90 + 3 * y) << 8 | (x * y % 200))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
    if kind == 10:
        want = np.array([[back.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
    else:
        rgb = np.array([[back.getRGB(x, y) for x in range(w)] for y in range(h)])
        want = 0.299 * (rgb >> 16 & 255) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)
    if bare:
        at = 2
        while jpeg[at + 1] != 0xDA:
            n = 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
            jpeg, at = (jpeg[:at] + jpeg[at + n :], at) if jpeg[at + 1] == 0xC4 else (jpeg, at + n)
    fps, got = media.decode(media.container([jpeg, jpeg, b""], w, h))
    assert fps == 25 and got.shape == (3, w * h)
    # colours out of range are clipped in RGB
    assert np.quantile(np.abs(got[2].reshape(h, w) - want), 0.9) <= 2
    own = media.encode(media.pad(bytes(range(256)) * 3))
    at, n = media.index(own)[1][0]
    assert media.picture(own[at : at + n])[::8, ::8, 0].ravel().tolist() == media.decode(own)[1][0].tolist()


@pytest.mark.parametrize("room", [shingle_join.ROOM, 0])
def test_shingle_join(docs, room):
    low = [words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for t in TEXTS]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in low]
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    for r in shingle_join.classes(docs, room=room).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(40, 30), (30, 35)]
    e = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(21)} | {30: 30, 35: 30, 40: 30}
    for how in ({}, {"native": True}, {"one_task": 0}):
        assert {r.node: r.component for r in graph.components(e, **how).collect()} == want


def test_packing(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    more = [*TEXTS, "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "<|endoftext| >"]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more))[len(TEXTS) :], "doc_id long, text string"))
    rows = packing.pack(docs, per_part=8).collect()
    for i, x in enumerate(more):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing_wide(spark):
    """Items that cannot pair end the rounds, and no task takes all of them; an empty table has no row."""
    d = spark.createDataFrame([(i, " ".join(["a"] * 600)) for i in range(40)], "doc_id long, text string")
    rows = packing.pack(d, per_part=5).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 40 and all(r.offset == 0 for r in rows)
    assert packing.pack(d.limit(0)).count() == 0


@pytest.mark.parametrize("room", [shingle_join.ROOM, 0])
def test_shingle_join_chains(spark, room):
    """Groups of drifting variants, so that pivots have boundaries and chains cross them."""
    rng, texts = random.Random(9), []
    for _ in range(4):
        first = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(45):
            one = list(first)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                one[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(one))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))
    for i in range(len(up)):
        for j in range(i):
            if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in shingle_join.classes(docs, room=room).collect()}
    assert got == dict(enumerate(up))


def test_shingle_join_ids(spark):
    """Null and repeated ids: a class takes its smallest id, null only where it has none."""
    a, b = text(40), text(40)
    near = a.replace(a.split()[-1], "x")
    rows = [(None, a, 1), (7, near, 2), (7, b, 3), (9, b, 4), (None, text(30), 5), (None, None, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in shingle_join.classes(d).collect())
    assert len(got) == 6 and all(r[2] in (0, 7) for r in got)
    assert [r for r in got if r[0] == 9][0][2] == 7 and [r for r in got if r[1] == 0][0][2] == 0
    assert [r[2] for r in got if r[0] == 0 and r[1] == len({tuple(a.split()[i : i + 5]) for i in range(36)})] == [7]


def test_shingle_join_null_near(spark):
    """A null id takes the smallest id of a text that differs in its last word only."""
    a = " ".join(f"v{i}" for i in range(40))
    d = spark.createDataFrame([(None, a, 1), (7, a[:-3] + "x", 2), (7, a.replace("v", "u"), 3)], "doc_id long, text string, id int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in shingle_join.classes(d).collect())
    assert got == [(0, 7), (7, 7), (7, 7)]


def test_shingle_join_empty(spark):
    assert shingle_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
