"""Ranked search, page text and collocations against brute force on small and awkward tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from moodtide.llm import alignment, collocations, lexical, page_text
from small_tables import awkward, docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search


def plain_ranks(docs, items, k):
    """(item, rank, doc, score) of texts by their definition; docs and items are (id, text) pairs."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for doc, ts in terms:
            tf, score = Counter(ts), 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 12 * (75 + 25 * len(ts) * n_docs // words)))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"vocabulary_terms": 3, "block_items": 2, "block_terms": 2}])
def test_ranks_against_brute_force(spark, sizes):
    draw = random.Random(2)
    pool = ["alpha", "Beta", "BETA", "été", "ÉTÉ", "x1", "9", "文字", "-", "no break", "gamma"]
    texts = [None, "", "..."] + [" ".join(draw.choices(pool, k=draw.randint(1, 9))) for _ in range(120)]
    texts += ["alpha beta"] * 40  # ties far beyond k
    items = [(i, " ".join(draw.choices(pool, k=draw.randint(0, 6)))) for i in range(9)] + [(9, None), (10, "unseen"), (11, "alpha " * 50)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked_documents(docs_of(spark, texts), table, k=5, **sizes)
    assert sorted(tuple(r) for r in got.collect()) == plain_ranks(list(enumerate(texts)), items, 5)


def test_ranks_of_awkward_tables(spark):
    rows = awkward(spark)
    plain = [(r["doc_id"], r["text"]) for r in rows.collect()]
    items = [(1, "one six rows"), (None, "again"), (2**53 + 1, "文字 a b")]
    table = spark.createDataFrame([(*i, "x", 5) for i in items], "item_id long, text string, rank string, score int")
    got = {tuple(r) for r in lexical.ranked_documents(rows, table).collect()}
    assert got == {tuple(r) for i in items for r in plain_ranks(plain, [i], 20)}
    assert lexical.ranked_documents(rows.limit(0), table).count() == 0
    assert lexical.ranked_documents(rows, table.limit(0)).count() == 0
    assert lexical.ranked_documents(rows, table.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_equal_ids_are_documents_and_items_of_their_own(spark):
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b"), (1, "b")], "item_id long, text string")
    got = lexical.ranked_documents(docs, items).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got) == [(1, 1, 7), (1, 1, 7), (1, 2, 7), (1, 2, 7)]


def test_no_sum_in_a_tile_passes_the_limit():
    draw = np.random.default_rng(3)
    limit = lexical.SUM_LIMIT // lexical.MOST_IMPACT
    worth = draw.integers(0, 40_000, (3000, 7))
    worth[::100] = draw.integers(limit // 3, 4 * limit, (30, 7))
    tiles = lexical.tiles_of(np.arange(3000), worth)
    total = np.zeros_like(worth)
    for tile in tiles:
        assert len(tile.terms) <= lexical.TILE_TERMS and len(set(tile.terms)) == len(tile.terms)
        assert (tile.worth.sum(axis=0) * lexical.MOST_IMPACT < 2**53).all()
        total[tile.terms] += tile.worth.astype(np.int64)
    assert (total == worth).all()


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "run_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    words = ["ab", "cd", "efg", "hi"]
    data = np.frombuffer(b"cd xx hi ab efg yyy", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12, 16]), np.array([2, 5, 8, 11, 15, 19])
    at, number = lexical.Vocabulary(words).find(data, starts, ends)
    assert sorted(zip(at.tolist(), number.tolist())) == [(0, 1), (2, 3), (3, 0), (4, 2)]


# collocations


def plain_collocations(rows, least, share, first, longest=4):
    by_lang = {}
    for lang, text in rows:
        pieces = by_lang.setdefault(lang or "und", [])
        pieces += [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]
    out = []
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + n]) for p in pieces for n in range(1, longest + 1) for i in range(len(p) - n + 1))
        words = sum(map(len, pieces))
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            inside = any(
                len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h)))
                for h, b in candidates.items()
            )
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, g.decode(), -a, l, r, words, -s))
    return sorted(out)


def some_rows(seed):
    draw = random.Random(seed)
    pool = ["The", "the", "new", "york", "Été", "été", "b c", "c", "d", "e,", "f.", "g\t", "\n", "!"]
    rows = [("en", None), (None, ""), ("fr", "\n\n..")]
    for _ in range(150):
        words = draw.choices(pool, [9, 3, 5, 5, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1], k=draw.randint(0, 25))
        rows.append((draw.choice(["en", "en", "en", None, "und", "EN"]), draw.choice([" ", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("first", [2000, 3])
def test_collocations_against_brute_force(spark, first, monkeypatch):
    monkeypatch.setattr(collocations, "PER_RANKING", 7)
    rows = some_rows(4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, rank int, phrase string")
    got = collocations.collocations(df, least=5, first=first)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 5, 80, first)


def test_collocations_where_all_fingerprints_meet(spark, monkeypatch):
    """Every word gets one hash: the counts by text still hold."""
    import pyarrow as pa

    rows = some_rows(5)
    real = collocations.run_hashes
    monkeypatch.setattr(collocations, "run_hashes", lambda data, starts, ends: real(data, starts, ends) & np.uint64(1))
    words = collocations.Words(pa.array([l or "und" for l, _ in rows]), pa.array([t or "" for _, t in rows]))
    number = words.word_numbers(words.places(1))
    texts = words.texts(words.places(1), 1)
    langs = words.lang.tolist()
    assert len(set(zip(number.tolist(), langs, texts))) == len(set(number.tolist())) == len(set(zip(langs, texts)))


def test_collocations_of_awkward_tables(spark):
    rows = awkward(spark)
    plain = [(r["lang"], r["text"]) for r in rows.select("lang", "text").collect()]
    got = collocations.collocations(rows, least=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(plain, 2, 80, 2000)
    assert collocations.collocations(rows.limit(0), least=2).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 8 * 10**12
    table = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang string, size int, phrase string, f long")
    assert collocations.scored(table).first()["score"] == 2_000_000 * big // (2 * big + 4)


# page text


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if False else _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


@pytest.mark.parametrize("cells", [1 << 24, 1, 12])
def test_alignment_against_the_full_matrix(cells, monkeypatch):
    monkeypatch.setattr(alignment, "CELLS_AT_ONCE", cells)
    draw = random.Random(6)
    for _ in range(150):
        a = draw.choices("abcde", k=draw.randint(0, 14))
        b = draw.choices("abcdef", k=draw.randint(0, 14))
        found = alignment.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:]))
        assert len(found) == plain_lcs(a, b)


def test_alignment_of_long_pages():
    a = list(range(20_000)) + [0] * 20_000
    assert len(alignment.common_lines(a, a[::2] + [0] * 9)) >= 20_000
    assert len(alignment.common_lines([1] * 30_000, [2] + [1] * 30_000)) == 30_000


def text_of(html):
    return "\n\n".join(t for t, kind in page_text.lines_of(html) if kind != page_text.BOXED)


def test_declared_boxes_are_no_text():
    html = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><div class="cookie-notice">We use</div>
    <main><article class="post"><header><h1>Head\n line</h1><p>By line</p></header><!-- no <p>text</p> -->
    <p>One &lt;b&gt; <b>bold</b>&nbsp;x<br>y<p>Two &eacute;&#233;<script>no()</script> z</p><ul><li>i<li>ii</ul>
    <div id="ad-3">Buy</div><span class="advert">Buy <b>now</b></span><form><p>Mail</p><input value="x"></form>
    <table><tr><td>a<td>b</table><aside>Side</aside><section class="comments"><article><p>Reader</p></article></section>
    <p hidden>h</p><div style="display: none">n</div><pre> x\n  y </pre></article></main><div>Outside</div>
    <footer>&copy; foot</footer></body></html>"""
    assert text_of(html).split("\n\n") == [
        "Head line", "By line", "One <b> bold x y", "Two éé z", "i", "ii", "a", "b", "x y",
    ]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
        ("<article><p>a<b>b<p>c</article><p>out", "ab\n\nc"), ("<p title='a>b'>x</p>", "x"), ("<p title=\"a>x</p>", "x"),
        ("<script>never closed <p>x", ""), ("<!-- never closed <p>x", ""), ("a<", "a<"), ("a <3 b", "a <3 b"),
        ("<p>x</P><SCRIPT>y</sCript >z", "x\n\nz"), ("</p></div>x</b>", "x"), ("<p>&am &amp &quot;&#x41;", "&am & \"A"),
        ("<textarea><p>no</textarea>y", "y"), ("<div role='navigation'>n</div><div role=main><p>m</div><p>o", "m"),
        ("<nav><p>n<nav>m</nav>k</nav>x", "x"),
    ],
)
def test_pieces_of_markup(html, want):
    assert text_of(html) == want


def test_reading_takes_linear_time():
    import time

    started = time.time()
    for html in ("<div>" * 100_000 + "x" + "</b>" * 100_000, "<p title=\"" * 100_000, "<a b='\"" * 100_000, "<" * 500_000, "<!--" * 200_000, "<li>" * 100_000):
        page_text.lines_of(html)
    assert time.time() - started < 20


PAGES = "page_id long, url string, html string, host string, lines string, k1 int"


def pages_of(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, (u, h) in enumerate(pages)], PAGES)


def test_shared_lines_of_the_nearest_page_go(spark):
    def page(body):
        return f"<html><body><div>Welcome to the shop</div>{body}<div>All rights kept</div></body></html>"

    pages = [("http://a.example/x/%d" % i, page(f"<p>Body of page {i} with words of its own</p>")) for i in range(6)]
    pages += [("http://b.example/x/1", page("<p>Body of page 1 with words of its own</p>"))]  # alone on its host
    pages += [("http://a.example/x/3?again", pages[3][1])]  # a copy is no template
    got = {r["page_id"]: r for r in page_text.main_text(pages_of(spark, pages)).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Body of page {i} with words of its own" and got[i]["n_dropped"] == 2
    assert got[6]["text"] == "Welcome to the shop\n\nBody of page 1 with words of its own\n\nAll rights kept"
    assert got[7]["text"] == got[3]["text"]


def test_articles_keep_lines_that_pages_share(spark):
    def page(i):
        return f"<body><article><h1>Head {i}</h1><div>Follow us</div><p>A line that all pages quote.</p><p>Own words {i * 7}</p></article></body>"

    got = page_text.main_text(pages_of(spark, [(f"http://a.example/{i}", page(i)) for i in range(5)])).collect()
    for r in got:
        i = r["page_id"]
        assert r["text"] == f"Head {i}\n\nA line that all pages quote.\n\nOwn words {i * 7}", r


def test_page_text_of_awkward_tables(spark):
    pages = [
        (None, None), (None, "<p>x"), ("", ""), ("no scheme", "<p>a</p>"), ("http://h/p", "<p>a</p>" * 3000), ("http://h/p", "<p>a</p>" * 3000),
        ("http://h/q", "<div>" * 3000 + "deep"), ("http://h/q", " " * 1_000_000 + "x"), ("http://h/" + "r" * 60_000, "<p>y"),
    ]
    rows = pages_of(spark, pages).unionByName(spark.createDataFrame([(None, "http://h/p", "<p>z", None, None, None), (2**53 + 1, "http://i/", "<p>big", None, None, None)], PAGES))
    got = page_text.main_text(rows).collect()
    assert len(got) == rows.count()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[0] == "" and texts[2] == "" and texts[2**53 + 1] == "big" and texts[6] == "deep" and texts[7] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert page_text.main_text(rows.limit(0)).count() == 0


def test_pages_are_numbered_in_order(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 AS int) AS v")
    got = page_text.numbered_in_order(rows, ["v"]).collect()
    assert sorted((r["place"], r["v"]) for r in got) == [(i, i) for i in range(1000)]
