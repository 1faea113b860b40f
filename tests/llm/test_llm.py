"""Brute-force versions, round trips and edge cases of the training-data operators."""

import hashlib
import io
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, html_extract, jaccard_join, language_id, mixing, packing, quality, suffix_dedup, topk_search, warc
from strandlake.llm.graph import components
from strandlake.llm.runtime import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, rid long, class long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 0.5, "k", 7, 8) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choices(words, k=n)) for n in (1, 4, 5, 6, 30, 200, 600)]
    near = base[5].split()
    near[100] = "changed"
    out = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word", "b"), (5, "Word", None), (None, "no id at all here now", "b"), (6, "é" * 300, "a"), (7, "ab" * 5000, "b")]
    out += [(10 + i, t, "abc"[i % 3]) for i, t in enumerate(base)] + [(30, base[5], "c"), (31, " ".join(near), "a"), (32, base[6].upper(), "a"), (33, base[4] + " " + base[3], "c"), (34, "x " + base[5][:900], "c"), (34, "x " + base[5][:900], "c")]
    return docs(spark, out)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_against_all_pairs(spark, edge, none):
    rows = edge.collect()
    sets = [shingles(r.text) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = lambda c: min((r.doc_id for r, k in zip(rows, comp, strict=True) if k == c and r.doc_id is not None), default=None)
    want = sorted(((r.doc_id, len(s), least(c)) for r, s, c in zip(rows, sets, comp, strict=True)), key=repr)
    assert sorted(map(tuple, jaccard_join.near_duplicates(edge).collect()), key=repr) == want
    assert jaccard_join.near_duplicates(none).collect() == []


def test_jaccard_hub_of_near_copies(spark):
    """Near copies that are linked to their base but not to each other are one component."""
    r = random.Random(1)
    base = [f"t{r.random()}" for _ in range(104)]
    texts = [" ".join(base)]
    for k in range(30):
        w = list(base)
        w[3 + 3 * k] = f"own{k}"
        w[(50 + 3 * k) % 104] = f"other{k}"
        texts.append(" ".join(w))
    got = jaccard_join.near_duplicates(docs(spark, [(100 - i, t, "a") for i, t in enumerate(texts)])).collect()
    assert {x.component_id for x in got} == {70}


def test_jaccard_hot_keys_are_split(spark, edge, monkeypatch):
    """Keys of many classes in parts by class give the same result, and no part has more than its share by far."""
    r = random.Random(4)
    base = [f"t{r.random()}" for _ in range(80)]
    texts = [" ".join([*base[:k], f"own{n}", *base[k + 1 :]]) for n, k in enumerate([*range(0, 80, 4)] * 3)] + [" ".join(base)] * 5
    d = docs(spark, [(100 - i, t, "a") for i, t in enumerate(texts)]).unionByName(edge.select("doc_id", "text", "source"), allowMissingColumns=True)
    plain = sorted(map(tuple, jaccard_join.near_duplicates(d).collect()), key=repr)
    seen = []
    real = jaccard_join._hot
    monkeypatch.setattr(jaccard_join, "_hot", lambda *a: seen.append(real(*a)) or seen[-1])
    assert sorted(map(tuple, jaccard_join.near_duplicates(d, probe=1, hot=5).collect()), key=repr) == plain
    assert len(seen[0][0]) > 5 and seen[0][1].max() > 5 and len(jaccard_join._hot(*_shown(spark, d, 1), 5, 1)[0]) == len(seen[0][0])


def _shown(spark, d, probe):
    return jaccard_join._classes(d.select(F.col("doc_id").cast("long"), "text"), 5, probe), probe


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 5), (200, 201), (7, 7)] + [(300, k) for k in range(301, 350)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got[40] == got[100] == got[1] == 1 and got[201] == 200 and got[349] == 300


def removed(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        yield bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())


def test_suffix_dedup_against_all_strings(spark, edge, none):
    rows = edge.collect()
    got = suffix_dedup.remove_repeats(edge).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), k, s, hashlib.sha256(b).hexdigest()) for r, (b, k, s) in zip(rows, removed([r.text for r in rows], 200), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want
    again = suffix_dedup.remove_repeats(edge, hot=0).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in again), key=repr) == want
    assert suffix_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("size", [60, 150, 190, 205, 400])
def test_suffix_dedup_with_a_line_in_every_document(spark, size):
    r = random.Random(size)
    noise = lambda n: "".join(r.choices("abcdefgh ", k=n))
    line, other = noise(size), noise(230)
    texts = [noise(250) + line + noise(r.choice([0, 30, 250])) for _ in range(40)]
    texts += texts[:4] + [texts[5][100:] + other, texts[6][:-20] + other, line * 3, texts[7][120:420] + line + texts[8][120:420]]
    got = suffix_dedup.remove_repeats(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), hot=5).collect()
    want = [(i, k, n, hashlib.sha256(b).hexdigest()) for i, (b, k, n) in enumerate(removed(texts, 200))]
    assert sorted((x.doc_id, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_induced_sorting_with_files():
    r = np.random.default_rng(5)
    for trial in range(60):
        n = int(r.integers(2, 30))
        t = r.integers(1, r.integers(2, 6), r.integers(2, 400))
        t = np.r_[np.tile(r.integers(1, 4, 7), trial % 5), t, 0].astype(np.uint16)
        sink = []
        flag = suffix_dedup.repeated_starts(t, n, queue_bytes=[60, 1 << 20][trial % 2], sink=sink)
        grams = [tuple(t[i : i + n]) for i in range(len(t))]
        assert flag.tolist() == [len(g) == n and grams.count(g) > 1 for g in grams]
        order = []
        for _, low, high in sorted(sink, key=lambda x: x[0]):
            order += [k for a, _ in low for k in a.tolist()] + [k for a, _ in high for k in a.tolist()][::-1]
        assert [grams[i] for i in order] == sorted(grams) and sorted(order) == list(range(len(t)))


def test_top_k_and_nearest(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 12)).astype(np.float32)
    x[200:260] = x[7]
    rows = [(i, x[i].tolist()) for i in range(400)] + [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (903, [0.0] * 12)]
    df = spark.createDataFrame([(*t, 1, 2) for t in rows], "vec_id long, embedding array<float>, score int, rank int")
    s = np.floor(256 * x.astype(float)) @ np.floor(256 * x.astype(float)).T
    got = {}
    for t in topk_search.exact_top_k(df, df.where("vec_id % 50 = 0"), k=5, query_block=3, bins=16).collect():
        got.setdefault(t.query_id, []).append((t.rank, t.vec_id, t.score))
    for q in range(0, 400, 50):
        ids = [*[i for i in range(400) if i != q], 903]
        value = lambda i: int(s[q, i]) if i < 400 else 0  # noqa: B023, E731
        best = sorted(ids, key=lambda i: (-value(i), i))[:5]
        assert sorted(got[q]) == [(k + 1, i, value(i)) for k, i in enumerate(best)]
    assert topk_search.exact_top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5).count() == 2
    assert topk_search.exact_top_k(df.where("false"), df.where("false"), k=5).count() == 0
    found = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    full = x.astype(float) @ x.astype(float).T
    hit = sum(1 for t in found if t.query_id != t.vec_id and full[t.query_id, t.vec_id] >= np.sort(np.delete(full[t.query_id], t.query_id))[-20] - 1e-9)
    assert hit >= 0.9 * 20 * 20 and len(found) == 400 and 903 not in {t.vec_id for t in found}
    assert all(t.score == pytest.approx(full[t.query_id, t.vec_id], abs=1e-12) for t in found)
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_top_k_counts_no_score_of_the_next_bin_twice(spark):
    x = [1.0] + [128 / 256] * 1000 + [129 / 256] * 3  # bins of 257: the copies in one, the better rows early in the next
    df = spark.createDataFrame([(i, [v, 0.0]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk_search.exact_top_k(df, df.where("vec_id = 0"), k=5, bins=512).collect()
    assert sorted((t.rank, t.vec_id, t.score) for t in got) == [(1, 1001, 33024), (2, 1002, 33024), (3, 1003, 33024), (4, 1, 32768), (5, 2, 32768)]


def test_top_k_is_exact_for_large_components(spark):
    r = random.Random(3)
    x = [[r.uniform(-1, 1) * 10 ** r.choice([0, 3, 9, 12, 13]) for _ in range(3)] for _ in range(60)] + [[1e300, 0.0, 1.0], [-1e300, 0.0, 1.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    e = [[max(-(2**63), min(2**63 - 1, math.floor(256 * v))) for v in row] for row in x]
    got = {}
    for t in topk_search.exact_top_k(df, df.where("vec_id % 10 = 0"), k=5, bins=64).collect():
        got.setdefault(t.query_id, []).append((t.rank, t.vec_id, t.score))
    for q in range(0, len(x), 10):
        score = {i: max(-(2**61), min(2**61, sum(a * b for a, b in zip(e[q], e[i], strict=True)))) for i in range(len(x)) if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(best)]


def test_nearest_finds_long_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((6000, 64))
    x *= np.exp(r.standard_normal(6000))[:, None] / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.where("vec_id % 60 = 0"), k=20).collect()
    s = x[::60] @ x.T
    s[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
    least = np.sort(s, axis=1)[:, -20]
    assert sum(s[t.query_id // 60, t.vec_id] >= least[t.query_id // 60] - 1e-9 for t in found) >= 0.9 * 2000


def test_hilbert_curve_is_continuous():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert np.abs(np.diff(order, axis=0)).sum(1).max() == 1


def test_mixing_meets_budgets(spark, edge, none):
    got = mixing.mix_sources(edge, carry=["source"]).collect()
    assert len(got) == edge.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert sum(r.taken for r in v) == int(v[0].target) and v[0].source_size == sum(r["size"] for r in v)
    assert mixing.mix_sources(none).collect() == []


def test_packing_covers_every_word_once(spark, edge, none):
    rows = packing.pack(edge, capacities=(64, 128, 256)).collect()
    used, parts = {}, {}
    for r in rows:
        if r.length:
            used.setdefault((r.shard, r.sequence, r.capacity), []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    for (_, _, cap), spans in used.items():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= cap
        assert cap == min(c for c in (64, 128, 256) if c >= sum(n for _, n in spans))
    sizes = {}
    for r in edge.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {k: sum(n for _, n in v) for k, v in parts.items()} == sizes
    assert packing.pack(none).collect() == []
    r = np.random.default_rng(1)
    n = r.integers(1, 257, 3000)
    _, _, cap = packing.best_fit(n, (64, 128, 256))
    assert n.sum() / cap.sum() > 0.97


def test_packing_keeps_ids_bit_for_bit(spark):
    ids = [9007199254740993, 9007199254740995, -9007199254740993, None, None, 2**63 - 1, 1, 1]
    got = packing.pack(docs(spark, [(i, "a b " * 300, "a") for i in ids])).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr)
    assert all(r.length == 600 and r.capacity >= 600 and r.offset is not None for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if(a<b){x="</p>"}</script></head><body><header class=top>Site name</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies, many of them, on this site, for you.</div><div id=main><article><h1>The&nbsp;title</h1><p>First <b>bold</b>ed, part,
of the text &amp; more &eacute;.<p>Second paragraph, with words, and others, and still more of them to be long.<div class="ad">Buy this, now, today, at once, here!</div>
<p>Third, the last one, which ends here.</p></article><aside>Related things, other things</aside><div class=comments><p>Reader says, long, comments, with, commas, more, and more text.</p></div></div><footer>&copy; all</footer>"""


def test_html(spark):
    want = "The title First bolded, part, of the text & more é. Second paragraph, with words, and others, and still more of them to be long. Third, the last one, which ends here."
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain <b>text", "x"), (5, "u", "<p>" + "a, " * 50000, "x"), (None, "u", "<<<>>&&<a", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == "" and got[4].text == "plain text" and got[5].n_chars == 149999
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_attributes_are_whole_names():
    body = "<p title='The hidden cost, id=nav'>One, two, three.</p><p data-id=share>Four, five.</p><p>Six, <a href='/p?id=comments'>see</a>, <a href=/hidden-gems>gems</a>.</p>"
    assert html_extract.main_text(f'<article data-hidden="false">{body}</article>') == "One, two, three. Four, five. Six, see, gems."
    for bad in ("hidden", "x=1 HIDDEN", "hidden=''", "class='a ad'", "id = nav", "aria-hidden=true", "title='a b' role=banner", "style='display: none'", "a='x'id='menu'"):
        assert html_extract.main_text(f"<article><p>Kept, this.</p><div {bad}><p>Gone, this.</p></div></article>") == "Kept, this.", bad
    assert html_extract.main_text("<article><p>Kept, this.</p><div id=text id=ad><p>And, this.</p></div></article>") == "Kept, this. And, this."


def test_html_keeps_what_stands_beside_the_best_container():
    ps = [f"Paragraph {k}, with words, and others, and still more of them." for k in range(6)]
    inner = "<div class='text'>" + "".join(f"<p>{p}</p>" for p in ps) + "</div>"
    links = "<section><h2>More</h2><ul><li><a href=x>One linked title here</a></li><li><a href=y>Another linked title</a></li></ul></section>"
    parts = f"<header><div><h1>Title</h1></div></header><p>Short.</p>{inner}<ul><li>An item</li><li><a href=z>A source</a></li><li>One more item of it</li></ul><section><p>End, of it.</p></section>{links}"
    want = " ".join(["Title Short.", *ps, "An item A source One more item of it End, of it."])
    assert html_extract.main_text(f"<body><p>Outside</p><article>{parts}</article><p>Outside</p></body>") == want
    other = "<article class=teaser><h2>Other</h2><p>Teaser.</p></article><article><h2><a href=x>Other title</a></h2><p>A teaser.</p></article>"
    assert html_extract.main_text(f"<body><main><h1>Top</h1><article>{parts}</article>{other}</main></body>") == "Top " + want
    second = "<article><h2>Second</h2><p>It goes on, here.</p></article>"
    assert html_extract.main_text(f"<body><main><h1>Top</h1><article>{parts}</article>{second}</main></body>") == f"Top {want} Second It goes on, here."
    assert html_extract.main_text(f"<body><h1>Top</h1>{inner}</body>") == "Top " + " ".join(ps)
    beside = f"<div><h1>Title</h1><p>Lead.</p></div>{inner}<div><p>Final remark.</p></div>"
    around = "<div class=menu><a href=x>Home</a></div><div class='related'><p>See also this.</p></div><div><a href=x>One</a> | <a href=y>Two</a></div>"
    assert html_extract.main_text(f"<body>{around}{beside}{around}</body>") == " ".join(["Title Lead.", *ps, "Final remark."])


@pytest.mark.parametrize("name", ["ad-hoc-analysis", "dinner-menu", "notice-period", "editor-comment", "popup-store", "form-of-words", "loginHistory"])
def test_html_names_of_several_words_are_no_kinds(name):
    assert html_extract.main_text(f"<article><p>One, two.</p><div class='{name}'><p>Three, four.</p></div><p>Five.</p></article>") == "One, two. Three, four. Five."


@pytest.mark.parametrize("name", ["ad", "ad-slot", "comment-list", "main-menu", "cookie-banner", "sidebar_left", "siteNotice", "newsletter-box", "ad-1"])
def test_html_names_of_kinds_drop(name):
    assert html_extract.main_text(f"<article><p>One, two.</p><div class='{name}'><p>Three, four.</p></div><p>Five.</p></article>") == "One, two. Five."


def test_html_labels_in_sentences():
    assert html_extract.main_text("<article><p>Set the <label>upper, or lower</label> bound.</p><label>Gone</label><form><p><label>Name</label></p></form></article>") == "Set the upper, or lower bound."


def test_html_class_words_drop_only_the_kinds_named():
    art = "<p>One, two, three.</p><p class='tags'>Four, five.</p><p class=legal>Six, seven.</p>"
    want = "One, two, three. Four, five. Six, seven."
    assert html_extract.main_text(f"<article>{art}</article>") == want
    assert html_extract.main_text(f"<body><div class='side-by-side'>{art}</div></body>") == want
    assert html_extract.main_text(f"<body><div class='no-sidebar layout'>{art}</div><div class=sidebar>Left out</div></body>") == want
    assert html_extract.main_text(f"<body><div class='page menu'><div class=nav>Left out</div><article>{art}</article></div></body>") == want
    assert html_extract.main_text(f"<body><article>{art}</article><div class=comments>{'<article class=comment><p>Reader, says.</p></article>' * 40}</div></body>") == want
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi></math>, be.</p></article>") == "Let x, be."


@pytest.mark.parametrize("page", ["<div>" * 100000 + "a, b" + "</div>" * 100000, "<div>a, b" * 30000, '<a "' * 100000, '<a "' * 100000 + ">", "<a " * 100000, "<ul><li>x" * 20000, "<li><div>" * 30000, "<b>x</i>" * 100000, "<!x" * 100000, "<table><tr><td>x" * 10000])
def test_html_takes_linear_time(page):
    at = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - at < 5


def brute_text(page):
    """The text of a well-formed page of p and h1 in one article, by a plain parser."""
    from html.parser import HTMLParser

    out, own = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            own.append(tag)
            out.append([] if tag in ("p", "h1") else None)

        def handle_endtag(self, tag):
            own.pop()
            out.append(None)

        def handle_data(self, data):
            if "article" in own and out and (block := next((b for b in reversed(out) if b is not None), None)) is not None:
                block.append(data)

    Reader().feed(page)
    return " ".join(t for b in out if b is not None and (t := " ".join("".join(b).split())))


def test_html_against_a_plain_parser():
    r = random.Random(8)
    word = lambda: r.choice(["one", "two,", "é", "&amp;", "&lt;b&gt;", "three.", "x\n y", "four"])
    for _ in range(60):
        body = "".join(f"<p>{' '.join(word() for _ in range(r.randint(1, 60)))}</p>" for _ in range(r.randint(1, 9)))
        page = f"<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class=ad>Buy</div><article><h1>{word()}</h1>{body}</article><footer>End</footer></body></html>"
        assert html_extract.main_text(page) == brute_text(page)


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "u", big), (2, "u", big), (3, "u", None), (4, None, ""), (5, "u\r\nX: y", "é" * 600), (6, "u", "WARC/1.0\r\n\r\n" * 200), (7, "u", "s"), (8, "u", "s"), (9, "u", big)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        twin = h == big and i != 9
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if twin else "response", 9 if twin else None)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_gives_one_row_for_each_page_of_repeated_ids(spark):
    one, two = "a" * 1500, "b" * 2500
    rows = [(9, one)] * 3 + [(9, two), (9, two), (4, one), (4, one), (5, two), (4, "s"), (4, "s")]
    got = warc.round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    # of each payload one row is the response, also where its id is repeated
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), *(("revisit", 9) if len(h) > 1 and k not in (0, 3) else ("response", None))) for k, (i, h) in enumerate(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_warc_without_ids_and_bounds(spark):
    big = "a" * 1500
    rows = [(None, "u", big), (None, "v", big), (None, "u", "b" * 1500), (3, "u", "b" * 1500), (None, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted([(None, 1500, "response", None)] * 2 + [(None, 1500, "revisit", 3), (3, 1500, "response", None), (None, 0, "response", None)], key=repr)
    data = b"".join(warc.member(warc.record("response", "u", b"x" * n, {})) for n in (10, 5000, 20))
    assert [len(g[2]) for g in warc.salvage(io.BytesIO(data)) if g[0] == "record"] == [10, 5000, 20]
    part = list(warc.salvage(io.BytesIO(data), 1000))
    assert [(g[0], len(g[2]), g[1].get("reason")) for g in part] == [("record", 10, None), ("gap", 0, "size"), ("record", 20, None)]


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    recs = [warc.record("response", f"u{i}", bytes([65 + i]) * 3000, {}) for i in range(6)]
    parts = [warc.member(r) if zipped else r for r in recs]
    bad = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    bad[at : at + 3] = b"\x00\x01\x02"
    place = sum(map(len, parts[:4]))
    bad[place : place + 2] = b"??"
    data = b"junk before" + bytes(bad) + parts[5][: len(parts[5]) // 2]
    got = list(warc.salvage(io.BytesIO(data)))
    assert [g[2][:1] for g in got if g[0] == "record"] == [b"A", b"C", b"D", b"F"]
    assert sum(g[4] for g in got) == len(data) and [g[3] for g in got] == sorted(g[3] for g in got)
    assert all(g[1]["reason"] for g in got if g[0] == "gap")


def test_quality_and_language_held_out(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = quality.classify(d, lab).join(lab, "doc_id").toPandas()
    assert ((q.predicted == 1) == (q.quality == 1)).mean() > 0.9
    p = language_id.identify(d).join(d, "doc_id").toPandas()
    assert (p.lang == p.lang_pred)[p.held_out].mean() > 0.9 and p.score.between(0, 1).all()


def test_quality_and_language_edges(spark, edge, none):
    lab = spark.createDataFrame([(4, 1, 0), (13, None, 0), (14, 0, 0), (14, 0, 0), (15, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge, lab).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in quality.classify(edge, lab.where("false")).collect()} == {0.5}
    assert quality.classify(none, lab).collect() == []
    lang = {r.doc_id: r.lang_pred for r in language_id.identify(edge).collect()}
    assert lang[1] == lang[2] == lang[3] == "und" and lang[4] == "en"
    assert language_id.identify(none).collect() == []


def test_gradients():
    r = np.random.default_rng(0)
    m = language_id.ByteTagger(["a", "b"], hidden=3)
    ids, y = r.integers(0, 256, (40, 12)).astype(np.uint8), r.integers(0, 2, 40)
    ids[y == 1] |= 128
    ids[y == 0] &= 127
    m.train(ids, np.full(40, 12), y, steps=60, batch=20)
    assert (m.probs(ids, np.full(40, 12)).argmax(1) == y).mean() > 0.95


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in cp.STAGES[:-1]:
        assert (n := f(spark, d, SF)).columns == d.columns
        d = Scratch(spark, "t").save(n, "s")
    once = cp.drop_near_duplicates(spark, d.unionAll(d), SF)
    assert once.groupBy("doc_id").count().where("count > 1").count() == 0
    assert cp.pack(spark, d, SF).where(F.col("length") > 4096).count() == 0


def test_pipeline_decides_by_id_and_text(spark):
    import corpus_pipeline as cp

    r = random.Random(6)
    text = lambda: " ".join(f"t{r.random()}" for _ in range(60))
    a, b, c, e, f = (text() for _ in range(5))
    near = lambda t: t + " end"
    rows = [(1, a), (2, near(a)), (2, b), (3, c), (3, e), (3, e), (None, near(b)), (None, f), (None, near(f)), (None, f), (4, None), (4, None), (4, ""), (None, None), (None, None)]
    got = cp.drop_near_duplicates(spark, docs(spark, [(i, t, "a") for i, t in rows]), SF)
    assert got.columns[:2] == ["doc_id", "text"] and len(got.columns) == len(DOCS.split(", "))
    got = [(x.doc_id, x.text) for x in got.collect()]
    first = [x for x in got if x[1] in (f, near(f))]
    assert len(first) == 1 and first[0][0] is None
    want = [(1, a), (2, b), (3, c), (3, e), (4, None), (4, ""), (None, None), first[0]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_with_clashing_columns_and_empty_tables(spark, edge):
    import corpus_pipeline as cp

    clash = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_rid", "_cuts", "_quality", "_row", "_key", "_of", "_id", "_again", "quality", "cuts", "c0", "n0", "taken", "_copy", "shard", "odd name", "a.b"]
    d = edge.selectExpr("*", *[f"cast({i} as int) as `{c.replace('`', '``')}`" for i, c in enumerate(clash)])
    for _, f in cp.STAGES[1:-1]:
        got = f(spark, d, SF)
        assert got.columns == d.columns
        for row in got.collect():
            assert [row.asDict()[c] for c in clash] == list(range(len(clash)))
    assert cp.pack(spark, d, SF).count() >= d.count()
    good = cp.filter_quality(spark, d, SF)
    assert good.columns == d.columns and good.count() <= d.count()
    for _, f in cp.STAGES:
        assert f(spark, d.where("false"), SF).count() == 0


def numeric(f, w, eps=1e-6):
    out = np.zeros_like(w)
    for i in np.ndindex(w.shape):
        keep = w[i]
        w[i] = keep + eps
        up = f()
        w[i] = keep - eps
        out[i] = (up - f()) / (2 * eps)
        w[i] = keep
    return out


def test_gated_attention_gradients_match_differences():
    r = np.random.default_rng(1)
    m = quality.BagModel(hidden=4, gate=3)
    x, at, y = r.standard_normal((9, quality.WIDTH)), np.array([0, 2, 3, 7, 9]), np.array([0.0, 1.0, 1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(p := m.forward(x, at)[0]) + (1 - y) * np.log(1 - p))
    got = m.gradients(x, at, y)
    for k, w in m.w.items():
        assert np.allclose(got[k], numeric(loss, w), atol=1e-6), k


def test_recurrent_gradients_match_differences():
    r = np.random.default_rng(2)
    m = language_id.ByteTagger(["a", "b", "c"], hidden=2)
    x, size, y = r.integers(0, 4, (5, 6)).astype(np.uint8), np.array([6, 3, 1, 5, 6]), np.array([0, 1, 2, 1, 0])

    def loss():
        total = 0.0
        for i in range(len(x)):
            p = m.byte_probs(x[i, : size[i]])
            total -= np.log(p[:, y[i]]).sum()
        return total / size.sum()

    got = m.gradients(x, size, y)
    for k, w in m.w.items():
        part = w[:, :4] if k.startswith("emb") else w
        assert np.allclose(got[k][:, :4] if k.startswith("emb") else got[k], numeric(loss, part), atol=2e-5), k


def test_language_scores_are_means_over_bytes(spark, edge):
    """Pooling against one byte at a time, in the windows that the operator reads."""
    train = spark.createDataFrame([(k, ("der die das und " if k % 2 else "the of and to ") * (3 + k), "de" if k % 2 else "en") for k in range(40)], "doc_id long, text string, lang string")
    m = language_id.fit(train, steps=20)
    got = {r.doc_id: r for r in language_id.predict(edge, m).collect() if r.doc_id is not None}
    for r in edge.where("doc_id in (4, 5, 6, 7, 15, 16)").collect():
        b = np.frombuffer(r.text.encode(), np.uint8)
        p = np.concatenate([m.byte_probs(b[i : i + language_id.WINDOW]) for i in range(0, len(b), language_id.WINDOW)]).mean(0)
        assert got[r.doc_id].lang_pred == m.langs[int(p.argmax())] and got[r.doc_id].score == pytest.approx(p.max(), abs=1e-4)


def test_quality_scores_against_one_bag_at_a_time(spark, edge):
    lab = spark.createDataFrame([(i, i % 2) for i in range(10, 17)], "doc_id long, quality int")
    m = quality.fit(edge, lab)
    for r in quality.score(edge.select("doc_id", "text"), m).collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x, at = quality.passage_features(data, np.array([0, len(data)]))
        h = np.tanh((x - m.mean) / m.dev @ m.w["W"] + m.w["b"])
        e = [(np.tanh(v @ m.w["V"]) / (1 + np.exp(-(v @ m.w["U"])))) @ m.w["a"] for v in h]
        share = np.exp(e - np.max(e)) / np.exp(e - np.max(e)).sum()
        assert r.score == pytest.approx(1 / (1 + np.exp(-(share @ h @ m.w["o"] + m.w["c"][0]))), abs=1e-6)
