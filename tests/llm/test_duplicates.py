import random

import numpy as np
import pytest

from corroba.llm import minhash, vectors, wrappers
from corroba.llm.graph import components


def sets_of(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def linked(texts):
    """doc -> smallest doc reachable, by comparing all."""
    sets = {i: sets_of(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 4 * small >= 3 * large:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicate_query(spark, sf_dir, texts):
    want = linked(texts)
    for r in minhash.op3_near_duplicates(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets_of(texts[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with words changed: some linked to few others, some to none."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts[i + 1] = " ".join(w)
    texts |= {500: texts[3], 501: texts[3].upper(), 502: None, 503: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == linked(texts)


def test_a_component_does_not_meet_itself(spark, monkeypatch):
    """20,000 near copies that are one component already, and three others in their bucket."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "materialise", lambda df, name: df)
    members = spark.range(20_003).select(F.lit(1).alias("band"), F.struct("id", F.when(F.col("id") < 20_000, F.lit(0)).otherwise(F.col("id")).alias("component")).alias("member"))
    pairs = minhash._met(members, 100).select(F.expr("transform(left, x -> x.id)").alias("a"), F.expr("transform(right, x -> x.id)").alias("b")).collect()
    assert 190 < len(pairs) <= 201
    met = {frozenset((x, y)) for r in pairs for x in r.a for y in r.b}
    others = range(20_000, 20_003)
    assert all(frozenset((x, y)) in met for y in others for x in range(20_003) if x != y)


def test_large_groups_of_near_copies_at_size(spark):
    """One bucket of 20,000 near copies, and copies of another text: labels by construction."""
    rng = random.Random(9)
    base, other = ([f"{w}{rng.randrange(9000)}" for _ in range(60)] for w in "wv")
    texts = {}
    for i in range(20_000):
        w = list(base if i % 4 else other)
        w[-1 - i % 3] = f"x{i}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: 1 if i % 4 else 0 for i in texts}


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (6, 6, True), (7, 7, True), (8, 8, True)]
    assert (None, None, True) in got
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one(odd).columns == odd.columns and minhash.keep_one(odd).count() == 9


def test_estimates_are_not_biased():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8):
        both = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        n = int(3000 * (1 - share) / (1 + share))
        a, b = both[: 3000 - n], both[n:]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        low = [minhash.minima(x) for x in (a, b)]
        e = minhash.estimates(*(np.frombuffer(minhash.packed(x), np.uint8) for x in low))
        assert abs(e - true) < 0.12


def test_pairs_at_the_threshold_are_candidates():
    """Sets of similarity 0.75: the share that shares no band or falls below the floor is about one in
    80,000, so of 3,000 pairs none may be missed, and bands and estimates must have the odds stated."""
    rng = np.random.default_rng(8)
    bands, values = [], []
    for _ in range(3000):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (minhash.minima(x) for x in (both[:350], both[50:]))
        bands.append(int((minhash.band_keys(a) == minhash.band_keys(b)).sum()))
        values.append(float(minhash.estimates(*(np.frombuffer(minhash.packed(x), np.uint8) for x in (a, b)))))
    assert min(bands) > 0 and min(values) >= minhash.FLOOR
    assert abs(np.mean(bands) - minhash.BANDS * 0.75**minhash.ROWS) < 0.3
    assert abs(np.mean(values) - 0.75) < 0.005 and abs(np.std(values) - 0.0277) < 0.004  # the floor lies 4.3 of these below


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(25)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([c + rng.normal(size=(k, 24)) * s for c, k, s in zip(centres, rng.integers(1, 25, 60), rng.uniform(0.0, 0.3, 60))]).astype(np.float32)
    x = np.concatenate([x, x[:10], rng.normal(size=(300, 24)).astype(np.float32)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [None, *[1.0] * 23]), (9006, [float("inf"), *[1.0] * 23]), (9007, [1.0, 2.0]), (None, [1.0] * 24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.link_vectors(frame).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= vectors.COSINE) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i].n_links for i in range(len(u)))
    assert found <= close.sum() and found >= 0.97 * close.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9008)) and got[None].component_id is None and got[9007].n_links == 0
    if found == close.sum():
        label = np.arange(len(u))
        for _ in range(len(u)):
            new = np.array([min(label[i], *label[close[i]]) if close[i].any() else label[i] for i in range(len(u))])
            if (new == label).all():
                break
            label = new
        assert [got[i].component_id for i in range(len(u))] == label.tolist()


@pytest.mark.parametrize("shard_bytes", [16 << 20, 90_000])
def test_vectors_of_a_hot_group_in_many_lists(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(vectors, "LIST_SIZE", 16)
    monkeypatch.setattr(vectors, "SHARD_BYTES", shard_bytes, raising=False)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=64) + rng.normal(size=(1000, 64)) * 0.17
    tight = rng.normal(size=64) + rng.normal(size=(200, 64)) * 0.001
    x = np.concatenate([hot, tight, rng.normal(size=(1800, 64)), hot[:20]])[rng.permutation(3020)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= vectors.COSINE) & ~np.eye(len(u), dtype=bool)
    assert close.sum() > 500_000
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(len(u))] == close.sum(1).tolist()
    low = np.arange(len(u))
    while True:
        new = np.array([min(low[i], low[c].min(initial=len(u))) for i, c in enumerate(close)])
        if (new == low).all():
            break
        low = new
    assert [got[i].component_id for i in range(len(u))] == low.tolist()


def test_vectors_of_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, [2.0, -1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.01]), (7, [1e200, 1e200, 0.0]), (8, [1e200, 1.001e200, 0.0]), (9, [5e-324, 0.0]),
        (10, [1.0] * 4), (11, [-0.0, 1.0]), (12, [0.0, 7.0]), (12, [0.0, 7.0]), (None, [1.0, 2.0]), (13, [float("nan"), 1.0]), (14, None), (15, [0.0, 0.0]), (16, [3.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "vec_id long, embedding array<double>, id int, key string, home int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.link_vectors(frame).collect()]
    want = {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (1, 9), 10: (0, 10), 11: (2, 11), 12: (2, 11), 13: (0, 13), 14: (0, 14), 15: (0, 15), 16: (1, 9), None: (0, None)}
    assert len(got) == len(rows) and all((n, c) == want[i] and kept == (i is None or i == c) for i, n, c, kept in got)


def test_vectors_of_nothing(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vectors.link_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().n_links == 0


PAGE = (
    "<html><head><title>t</title><script>var a='</p>';</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href='/'>menu</a></nav>"
    "<!-- ad --><div class=\"ad box\">buy</div>%s<aside>side</aside><div id='comments'><p>reader</p></div><footer>foot</footer></body></html>"
)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>T &amp; U</h1><p>a <b>b\n c</b><br>d<p>e<form>f</form></article>", "T & U\na b c d\ne"),
        ("<main><section><p>x</p><ul><li>1<li>2</ul></section><div class='share-bar'>no</div></main>", "x\n1\n2"),
        ("<div class='post-content'><p>y</p><table><tr><td>1<td>2</table></div>", "y\n1\n2"),
        ("<article></article>", ""),
    ],
)
def test_main_text(body, text):
    assert wrappers.main_text(PAGE % body, None) == text


def test_a_mark_is_judged_as_a_whole():
    page = "<article><h1>T</h1><div class='related-work'><p>Body text</p></div><p class='notice'>kept</p><section id='alert-systems'><p>too</p></section><div class='share-bar'>no</div></article>"
    assert wrappers.main_text(page, None) == "T\nBody text\nkept\ntoo"


def misleading(n):
    """Pages of one template without article or main: the text is in a part marked as comments,
    the menu and a long notice in one marked as the post."""
    out = []
    for i in range(n):
        words = " ".join(f"w{i}x{k}" for k in range(30 + 7 * i))
        page = (
            f"<html><body><div class='post content'><ul><li><a href='/'>menu of links</a><li><a href='/{i}'>other page {i}</a></ul><p>{'The same notice on all pages of the host. ' * 20}</p></div>"
            f"<div class='sidebar comments' id='n{i}'><h2>Title {i}</h2><p>{words}</p>{'<p>one more %d</p>' % i * (i % 3)}<div class='x'><p>Read the rules before you write to us.</p></div>"
            f"<ul><li>item {i}</li></ul></div><div class='end'><p>{'House, street and town. ' * 9}</p></div></body></html>"
        )
        out.append((page, "\n".join([f"Title {i}", words, *[f"one more {i}"] * (i % 3), f"item {i}"])))
    return out


def test_wrappers_tell_template_from_text(spark, monkeypatch):
    pages = misleading(9)
    wrapper = wrappers.infer([p for p, _ in pages])
    assert "(<p>#text</p>)+" in wrappers.as_expression(wrapper) and wrappers.as_expression(wrappers.load(wrappers.dump(wrapper))) == wrappers.as_expression(wrapper)
    for page, text in pages:
        assert wrappers.main_text(page, wrapper) == text
        assert wrappers.main_text(page, None) != text  # a page alone can't tell
    rows = [(i, f"http://one.example/{i}", p) for i, (p, _) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for salts in (1, 64):
        monkeypatch.setattr(wrappers, "SALTS", salts)
        assert {r.page_id: r.text for r in wrappers.extract(frame).collect()} == {i: t for i, (_, t) in enumerate(pages)}


def test_layouts_of_a_host_share_a_wrapper():
    other = [f"<html><body><table class='t'><tr><td>The paper's name and its motto</td></tr></table><section class='story'><h1>Story {i}</h1><p>{'s%d ' % i * 40}</p></section></body></html>" for i in range(4)]
    pages = misleading(5)
    wrapper = wrappers.infer([p for p, _ in pages] + other)
    assert [wrappers.main_text(p, wrapper) for p, _ in pages] == [t for _, t in pages]
    assert [wrappers.main_text(p, wrapper) for p in other] == [f"Story {i}\n{' '.join(['s%d' % i] * 40)}" for i in range(4)]


def test_copies_of_a_page_keep_their_text():
    page = "<html><body><div class='a'><p>one text</p><div><p>in a part of its own</p></div></div></body></html>"
    assert wrappers.main_text(page, wrappers.infer([page] * 5)) == "one text\nin a part of its own"


def test_marks_of_their_own_do_not_make_wrappers_grow(monkeypatch):
    monkeypatch.setattr(wrappers, "WIDEST", 20)
    letters = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(300)]
    pages = [f"<html><body><div class='menu-{w}'><p>Same menu</p></div><div class='text-{w}'><p>{w} text {'of it ' * 30}</p></div></body></html>" for w in letters]
    wrapper = wrappers.infer(pages)
    assert len(wrappers.dump(wrapper)) < 10_000
    for w, page in zip(letters, pages):
        assert f"{w} text" in wrappers.main_text(page, wrapper)


def test_aligned_parts_keep_every_part():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([wrappers.Part(rng.choice("abcd"), "", False, 1, 1, 1, 1, 1, []) for _ in range(rng.randrange(9))] for _ in range(2))
        both = wrappers.align(a, b)
        assert sum(p.pages for p in both) == len(a) + len(b)
        for side in (a, b):  # the wrapper's parts have each side as a subsequence
            rest = iter(p.tag for p in both)
            assert all(p.tag in rest for p in side)


def test_common_sequences_are_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                best[x + 1][y + 1] = best[x][y] + 1 if a[x] == b[y] else max(best[x][y + 1], best[x + 1][y])
        found = wrappers.common(a, b)
        assert all(a[x] == b[y] for x, y in found) and len(found) == best[-1][-1]
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert len(wrappers.common(list(range(4000)), list(range(1, 4001)))) == 3999


@pytest.mark.parametrize("n", [2, 30])
@pytest.mark.parametrize("holder", ["article", "div"])
def test_comments_of_any_length_go(n, holder):
    """Inside the article or beside it, by themselves and with the host's wrapper."""
    pages, want = [], []
    for i in range(6):
        said = "".join(f"<p>Reader {k} of page {i} says that it is so.</p>" for k in range(n))
        pages.append(f"<html><body><{holder} class='post'><h1>T{i}</h1><p>Text of page {i} is here.</p><p>And {i} more.</p><div class='comments'>{said}</div></{holder}></body></html>")
        want.append(f"T{i}\nText of page {i} is here.\nAnd {i} more.")
    wrapper = wrappers.infer(pages)
    for w in (wrapper, None):
        assert [wrappers.main_text(p, w) for p in pages] == want


def test_comments_larger_than_the_text_are_not_entered():
    pages = [f"<body><div class='story'><h1>T{i}</h1><p>Words {i} of it.</p></div><section id='comments'>{'<p>say %d</p>' % i * 40}</section></body>" for i in range(5)]
    wrapper = wrappers.infer(pages)
    for w in (wrapper, None):
        assert [wrappers.main_text(p, w) for p in pages] == [f"T{i}\nWords {i} of it." for i in range(5)]


def test_what_is_all_marked_stays():
    assert wrappers.main_text("<article><div class='alert'><p>all there is</p></div></article>", None) == "all there is"


def test_repeated_pages_lose_nothing(spark):
    """Copies of a page are one page: what they have in common is no template."""
    odd = "<html><body><article><h1>T</h1><p>Intro.</p><ul><li>one</li><li>two</li></ul><table><tr><td>c</td></tr></table><p>End.</p></article></body></html>"
    others = [f"<html><body><article><h1>T{i}</h1><p>Other text {i}.</p></article></body></html>" for i in range(4)]
    for copies in (1, 2, 3, 9):
        assert wrappers.main_text(odd, wrappers.infer([odd] * copies + others)) == "T\nIntro.\none\ntwo\nc\nEnd."
    rows = [(0, "http://h/0", odd)] * 7 + [(i + 1, f"http://h/{i}", p) for i, p in enumerate(others)]
    for parts in (1, 6):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r.text for r in wrappers.extract(frame).collect() if not r.page_id} == {"T\nIntro.\none\ntwo\nc\nEnd."}


@pytest.mark.parametrize("which", range(5))
def test_repeating_any_row_changes_no_text(which):
    pages = [p for p, _ in misleading(5)]
    once = wrappers.infer(pages)
    again = wrappers.infer(pages + [pages[which]] * 3)
    assert [wrappers.main_text(p, again) for p in pages] == [wrappers.main_text(p, once) for p in pages]


def test_formulas_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so, <object>or so</object>.</p></article>"
    assert wrappers.main_text(page, None) == "Let x=2 be so, or so."


def test_only_the_wrapper_tells_a_template_without_marks():
    """Without article, main or words that mark, the notice of all pages goes by the wrapper alone."""
    pages = [f"<body><div class='a'><section class='b'><p>The same words on all pages.</p></section><p>Own words of page {i}, and of no other.</p><p>Some more, {i}.</p></div></body>" for i in range(5)]
    wrapper = wrappers.infer(pages)
    want = [f"Own words of page {i}, and of no other.\nSome more, {i}." for i in range(5)]
    assert [wrappers.main_text(p, wrapper) for p in pages] == want
    assert all("same words" in wrappers.main_text(p, None) for p in pages)


def test_page_query(spark, sf_dir):
    import html
    import re

    import pyarrow.parquet as pq

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()}
    for r in wrappers.op6_main_text(spark, sf_dir).collect():
        body = re.search("<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", body.replace("<br>", " "))
        want = "\n".join(b for b in (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in blocks) if b)
        assert (r.text, r.n_chars) == (want, len(want))


def test_odd_pages(spark, monkeypatch):
    rows = [(1, None, None, 5), (2, "no url", "", 5), (3, "http://h/", "plain", 5), (3, "http://h/", "plain", 5), (4, "http://h/", "<div>" * 3000 + "deep", 5), (5, "http://h/", "<p>" + "x " * 200_000, 5), (None, "http://h/", "a<b", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [(r.page_id, r.n_chars) for r in wrappers.extract(frame).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 0), (2, 0), (3, 5), (3, 5), (4, 4), (5, 399_999)]
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    assert sorted(map(str, got)) == sorted(str((r.page_id, r.n_chars)) for r in wrappers.extract(frame).collect())
    assert wrappers.extract(frame.limit(0)).count() == 0


