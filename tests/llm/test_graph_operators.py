"""SimHash, top-k, HTML, chat formatting and the pipeline against plain versions and on odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import html, quotes, registry, simhash, topk

SF = "/root/testdata/sf0.01"


# --- SimHash ---


def _fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius=4):
    """ids -> smallest reachable id, comparing all pairs of distinct fingerprints."""
    ids = {}
    for d, f in prints:
        ids.setdefault(f, []).append(d)
    values = list(ids)
    label = {f: min(ids[f]) for f in values}
    changed = True
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: label[f] for d, f in prints}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    texts = [None, "", "One", "one two THREE", "a b c d", "a\tb\nc  d e É Ü", "x " * 500, " ".join(f"w{i}" for i in range(40_000))]
    for text in texts:
        assert simhash.fingerprint(text) == _fingerprint(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert {r.component_id for r in got if r.doc_id < 2} == {0}


def test_many_hashes_are_those_of_the_library(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(simhash, "SPAN", 5_000)
    for size, most in ((0, 1), (5, 30), (400, 3_000), (20_000, 5_000)):
        data = rng.randbytes(size)
        starts = sorted(rng.randrange(size + 1) for _ in range(most))
        lengths = [min(rng.randrange(rng.choice([4, 40, 300])), size - a) for a in starts]
        got = simhash.xxh64_many(data, np.array(starts, np.int64), np.array(lengths, np.int64))
        assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(starts, lengths, strict=True)]
    assert simhash.xxh64_many(b"", np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_components_match_all_pairs(spark):
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    prints, number = [], iter(r.sample(range(100_000), 3000))
    for c in centres:
        f = c
        for _ in range(r.randint(1, 25)):
            for _ in range(r.randint(0, 5)):
                f ^= 1 << r.randrange(64)
            for _ in range(r.randint(1, 3)):
                prints.append((next(number), f))
            if r.random() < 0.5:
                f = c
    prints += [(next(number), r.getrandbits(64)) for _ in range(300)]
    df = spark.createDataFrame([(d, _signed(f)) for d, f in prints], "doc_id long, fp long")
    want = _components(prints)
    got = {x.doc_id: x.component_id for x in simhash.components(df).collect()}
    assert got == want
    assert simhash.NARROW.levels(10**6) == 3 and simhash.NARROW.levels(10**9) > 3


def test_shards_over_the_bound_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash.NARROW, "levels", lambda n: 1)
    r = random.Random(8)
    prints = []
    for i in range(120):
        f = r.getrandbits(64)
        for k in range(r.randint(1, 6)):
            prints.append((10 * i + k, f))
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
    df = spark.createDataFrame([(d, _signed(f)) for d, f in prints], "doc_id long, fp long")
    dealt = simhash._dealt(simhash._shards(df.withColumnRenamed("doc_id", "rep"), simhash.NARROW, 1)).groupBy("shard", "i", "j").count().agg(F.max("count"), F.max("j")).first()
    assert dealt[0] <= 4 * 60 and dealt[1] > 1
    assert {x.doc_id: x.component_id for x in simhash.components(df).collect()} == _components(prints)


def _similar(texts):
    """ids -> smallest reachable id under a Jaccard similarity of 0.8 or more of the sets of five-word shingles, comparing
    all pairs with a shingle in common; texts without words are alike."""
    sets, at = [], {}
    for i, (_, t) in enumerate(texts):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
        for shingle in sets[-1] or {()}:
            at.setdefault(shingle, []).append(i)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in enumerate(sets):
        common = {}
        for shingle in own or {()}:
            for j in at[shingle]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if not own and not sets[j] or 10 * n >= 8 * (len(own) + len(sets[j]) - n):
                label[root(j)] = root(i)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(root(i), []).append(d)
    return {d: min(own) for own in groups.values() for d in own}


@pytest.mark.parametrize("leaf", [1 << 14, 64])
def test_dense_groups_keep_all_links(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    r = random.Random(1)
    words = [sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(500)] + [r.getrandbits(64) for _ in range(60)]
    whole = np.array(words, np.uint64)[:, None]
    block = (whole[:, 0] & np.uint64((1 << 21) - 1)).astype(np.uint32)
    label = simhash.tree_links(block, np.arange(560), np.arange(560), whole, 4)
    near = [(i, j) for i in range(560) for j in range(i) if (words[i] ^ words[j]).bit_count() <= 4 and ((words[i] ^ words[j]) & ((1 << 21) - 1)).bit_count() <= 1]
    want = simhash.forest(560, np.array([a for a, _ in near]), np.array([b for _, b in near]))
    assert label.tolist() == want.tolist()


def test_near_duplicates_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = _components([(d, _fingerprint(t)) for d, t in texts])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
    alike = _similar(texts)
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == alike
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(alike.values()))


def test_copies_from_a_similarity_of_eight_tenths(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    docs, pairs = [], []
    for _ in range(150):
        base = [word() for _ in range(r.choice([60, 150, 400]))]
        copy = list(base)
        while _jaccard(base, copy) > 0.83:
            changed = list(copy)
            changed[r.randrange(len(copy))] = word()
            if _jaccard(base, changed) < 0.8:
                break
            copy = changed
        pairs.append((len(docs), len(docs) + 1))
        docs += [" ".join(base), " ".join(copy)]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.95 * len(pairs)
    assert all(got[a] == a for a, _ in pairs)  # texts that have nothing in common stay apart


def _jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [1024, 3])
def test_only_links_of_eight_tenths_make_components(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GROUP_DOCS", most, raising=False)
    r = random.Random(5)
    docs = []
    for _ in range(40):
        base = [f"w{r.getrandbits(40)}" for _ in range(100)]
        for n in (0, 1, 2, 3, 5, 6, 7, 8):  # each changed word costs five shingles of 96
            docs.append([f"x{r.getrandbits(40)}" if i < 10 * n and i % 10 == 5 else w for i, w in enumerate(base)])
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(8 * (i // 8), i):
            if _jaccard(docs[i], docs[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert 40 < len(set(label)) < len(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(docs))] == label


def test_simhash_on_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "alone in here it is"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("rep", F.lit(1)).withColumn("_gone", F.lit(2))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (None, None), (3, 3), (4, 3)}
    assert sorted((r.doc_id or 0 for r in simhash.keep(docs).collect())) == [0, 0, 1, 1, 3]
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.keep(docs.where("false")).count() == 0


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)], "a long, b long")
    got = {r.node: r.component for r in simhash.stars(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1001, 1200))


# --- top-k ---


def _brute_topk(rows, k):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16_384, 60])
def test_topk_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(8)]) for i in range(300)]
    hot = [0.5] * 8
    rows += [(i, hot) for i in range(300, 420)]  # one very common vector: ties by id
    rows += [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (560, [float("inf")] + [0.0] * 7), (None, hot), (580, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0))
    vectors = topk.scaled(df, "vec_id", "embedding")
    got = topk.search(vectors, vectors.where("id % 20 = 0"))
    assert sorted((x.query, x["rank"], x.id, x.score) for x in got.collect()) == _brute_topk(rows, topk.K)


def test_topk_skips_shards_and_answers_each_query_row(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 6)) * 3
    rows = [(i, [float(x) for x in centres[i % 8] + 0.05 * r.normal(size=6)]) for i in range(800)] + [(20, [1.0, 0.0])]
    rows += [rows[0], rows[40]]  # repeated rows
    vectors = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    asked = []
    visits = topk._visits
    monkeypatch.setattr(topk, "_visits", lambda *a: asked.append(visits(*a)) or asked[-1])
    got = topk.search(vectors, vectors.where("id % 20 = 0")).collect()
    n = vectors.where("id % 20 = 0").count()
    assert len(got) == n * topk.K and sum(x.count() for x in asked) < 0.65 * 8 * n and asked[-1].count() == 0
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    for i in {x.query for x in got}:
        want = []
        for v in [w for j, w in good if j == i]:
            want += [(n + 1, j, -s) for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != i)[: topk.K])]
        assert sorted((x["rank"], x.id, x.score) for x in got if x.query == i) == sorted(want)


def test_topk_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    vectors = topk.scaled(df, "vec_id", "embedding")
    assert [(r.id, r.score) for r in topk.search(vectors, vectors.where("id = 0")).orderBy("rank").collect()] == [(1, 2048), (2, -4096)]
    none = vectors.where("false")
    assert topk.search(none, none).count() == 0 and topk.search(none, vectors).count() == 0


def test_pruning_skips_leaves():
    r = np.random.default_rng(0)
    points = np.concatenate([r.normal(size=(2000, 6)) + 40 * r.normal(size=6) for _ in range(8)]).round()
    tree = topk.BallTree(np.arange(len(points)), points)
    seen = []
    tree.vectors = _Counting(tree.vectors, seen)
    tree.search(np.array([-1]), points[:1], np.array([-np.inf]), 5)
    assert len(seen) < len(tree.leaves) / 2


class _Counting:
    def __init__(self, data, seen):
        self.data, self.seen = data, seen

    def __getitem__(self, at):
        self.seen.append(at)
        return self.data[at]


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="top"><h1>Site name</h1></header><div id="main-menu"><a href=#>One</a> <a href=#>Two</a></div>
<div class="content"><h2>The   title</h2><div>Intro text, long enough to be content. Yes.</div><p>First &lt;b&gt; paragraph, of the text.<p>Second &amp; so on,
 <a href="x>y">with a link</a> in it; <b>fine<br>text</b>.</p><ul><li>item one</li><li>item two</ul><table><tr><td>cell a<td>cell b</table>
<div class="share-buttons">Share me</div><p>Short.</p><p hidden>Not shown at all, hidden text.</p></div>
<aside>Side text, more. Text text text text.</aside><div class="comments"><p>I think this is great, really. What a text this is!</p></div>
<form><p>Your name, please.</p></form><div class="cookie-notice">We use cookies.</div><!-- a > comment --><footer>(c) 2020, all rights reserved.</footer></body></html>"""


def test_main_text():
    want = ["The title", "Intro text, long enough to be content. Yes.", "First <b> paragraph, of the text.", "Second & so on, with a link in it; fine text.", "item one", "item two", "cell a", "cell b", "Short."]
    assert html.main_text(PAGE) == "\n\n".join(want)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("  ", ""), ("plain text only, no tags.", "plain text only, no tags."), ("<p>a<!-- never closed", "a"), ("<p>One, two.</p><script>x='</p>'", "One, two."),
    ("<article><h1>T</h1><p>Text &am", "T\n\nText &am"), ("<nav><a>x</a></nav>", ""), ("<p>Hello, world. It is 3 < 4 &copy;</p>", "Hello, world. It is 3 < 4 ©"), ("<article><p>A b c.</p><foot", "A b c."),
])
def test_small_pages(page, text):
    assert html.main_text(page) == text


def test_selected_text_outside_the_largest_element_stays():
    long, more = "<p>Some text of the page, rather long. </p>" * 8, "<p>Other text of it, rather long too.</p>" * 2
    want = html.main_text(long).split("\n\n") + html.main_text(more).split("\n\n")
    assert len(want) == 10
    for page in (f"<div class=post><div>{long}</div><div>{more}</div></div>", f"<main><article>{long}</article><article>{more}</article></main>", f"<article>{long}</article><article>{more}</article>"):
        assert html.main_text(f"<body><nav>Menu, of the site.</nav>{page}<footer>End, of the page.</footer></body>").split("\n\n") == want
    titled = f"<body><div class=top><h1>A title, of this page</h1></div><div class=post>{long}</div></body>"
    assert html.main_text(titled).split("\n\n") == ["A title, of this page", *want[:8]]


@pytest.mark.parametrize(("page", "text"), [
    ("<p><a href=x>All of this article's text is one link, yes.</a></p>", "All of this article's text is one link, yes."),
    ('<article><p>One, two three. Four five six, seven.</p><p class="related-work">Other work, as it is.</p><p class="related-posts">Gone, of course.</p></article>', "One, two three. Four five six, seven.\n\nOther work, as it is."),
    ("<article><p>One sentence with <span class=ad>Buy <b>now</b>!</span> an advert in it, yes.</p></article>", "One sentence with an advert in it, yes."),
    ("<article><p>A text, with <button>Share</button> a button. </p><article class=comment><p>Nice, really.</p></article></article>", "A text, with a button."),
    ("<p class='it's'>Some text, here.</p>", "Some text, here."),
])
def test_what_is_boilerplate(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(("page", "length"), [
    ("<div>" * 100_000 + "Deep text, very deep.", 21), ("<script " * 1_250_000, 0), ("<div>x, y. " * 30_000, 30_000 * 7 - 2), ('<a title="x ' * 100_000, None), ("<!--" * 500_000, 0), ("<script>" * 300_000, 0),
    ("<span class=ad>" * 50_000, 0), ("<ul><li>a" * 30_000, 30_000 * 3 - 2), ("<div>" * 50_000 + "</p>" * 50_000, 0), ("<a =\"<a ='" * 100_000, None),
])
def test_pages_are_read_in_linear_time(page, length):
    import time

    start = time.process_time()
    text = html.main_text(page)
    assert time.process_time() - start < 10 and (length is None or len(text) == length)


def test_articles_without_article_elements(spark):
    for row in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        want = html.main_text(row.html)
        for start, end in (("<div class=post>", "</div>"), ("", "")):
            assert html.main_text(row.html.replace("<article>", start).replace("</article>", end)) == want


def test_articles_of_the_test_pages(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url


def test_html_on_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>Some text, here.</p>"), (2, "u", "<div>" * 2000 + "Deep text, very deep."), (3, "u", "<p>" + "long text, really. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(5))
    got = html.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 16, 21, 50_000 * 19 - 1] and html.extract(df.where("false")).count() == 0


# --- chat formatting ---


def _chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "Where can I find the old reports?\n\nAlso, who keeps them now?"),
        (1, 1, "assistant", "They are on the second floor."),
        (1, 2, "user", "Alice wrote:\n> Where can I find the old reports?\nI asked the same thing."),
        (1, 3, "user", "> They are on the second floor.\nThanks!\n>> nested words of nobody here\nBye."),
        (1, 4, "assistant", "> > WHERE can I find   the old reports?\n> I asked the same thing.\nTwo levels."),
        (2, 7, "user", "> They are on the second floor.\nFrom elsewhere."),
        (2, 9, "user", None),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(_chat(spark, rows)).collect()}
    assert got[1, 2].text == "I asked the same thing." and (got[1, 2].reply_to_conv, got[1, 2].reply_to_turn) == (1, 0)
    assert got[1, 3].text == "Thanks!\nBye." and got[1, 3].reply_to_turn == 1 and got[1, 3].n_links == 1
    assert got[1, 4].reply_to_turn == 2 and got[1, 4].n_links == 2  # the shallower quote decides
    assert (got[2, 7].reply_to_conv, got[2, 7].reply_to_turn) == (1, 1)
    assert got[1, 0].reply_to_turn is None and got[1, 1].reply_to_turn == 0 and got[2, 9].reply_to_turn == 7
    assert [got[1, i].position for i in range(5)] == [0, 1, 2, 3, 4] and (got[2, 7].thread, got[2, 7].position) == (1, 5) and (got[2, 9].thread, got[2, 9].position) == (1, 6) and got[2, 9].text == ""


def test_short_and_partial_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Sounds good."), (1, 1, "assistant", "Filler of some length."), (1, 2, "user", "> Sounds good.\nOk"),
        (2, 0, "user", "今天很好。我们走吧。"), (2, 1, "assistant", "Another filler."), (2, 2, "user", "> 我们走吧。\nOk"),
        (3, 0, "user", "The first sentence is here. The second one (too).\nA third goes on\nover lines. Last one."), (3, 1, "assistant", "And one more."),
        (3, 2, "user", "> The second one (too).\nOk"), (3, 3, "user", "> A third goes on over lines.\nOk"), (3, 4, "user", "> The first sentence is here. The second one (too).\n> A third goes on\nOk"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(_chat(spark, rows)).collect()}
    for key in ((1, 2), (2, 2), (3, 2), (3, 3), (3, 4)):
        assert (got[key].reply_to_conv, got[key].reply_to_turn, got[key].n_links) == (key[0], 0, 1)


def test_an_original_elsewhere_counts_if_the_first_is_later_in_the_own_conversation(spark):
    same = "exactly these words in both places"
    rows = [(1, 6, "user", f"> {same}\nOk"), (1, 8, "user", same), (2, 5, "user", same), (3, 1, "user", f"> {same}\nToo early")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(_chat(spark, rows)).collect()}
    assert (got[1, 6].reply_to_conv, got[1, 6].reply_to_turn, got[1, 6].n_links, got[1, 6].thread, got[1, 6].position) == (2, 5, 1, 2, 1)
    assert (got[3, 1].n_links, got[3, 1].reply_to_conv, got[3, 1].thread) == (0, None, 3)  # replies are to earlier messages only


def _plain_chat(rows):
    """(conv_id, turn) -> thread, position, reply_to, links found by comparing every passage with every run of every message."""
    import re

    normal = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    said, asks, clean = {}, {}, {}
    for c, t, _, text in rows:
        own = [x for x in text.split("\n") if not x.startswith(">")]
        clean[c, t] = "\n".join(own)
        runs = {normal("\n".join(own))}
        for paragraph in "\n".join(own).split("\n\n"):
            for parts in (paragraph.split("\n"), re.split(r"(?<=[.!?])\s+", paragraph)):
                runs |= {normal(" ".join(parts[i:j])) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}
        said[c, t] = runs - {""}
        passages, last = [], 0
        for line in text.split("\n"):
            level = len(line) - len(line.lstrip(">"))
            if level and level == last:
                passages[-1][1].append(line.lstrip(">"))
            elif level:
                passages.append((level, [line.lstrip(">")]))
            last = level
        asks[c, t] = {(n, normal(" ".join(x))) for n, x in passages}
    out = {}
    for c, t in sorted(asks, key=lambda k: (k[1], k[0])):
        found = []
        for level, q in asks[c, t]:
            own = [(c, u) for d, u in said if d == c and u < t and q in said[d, u]]
            others = [(u, d) for d, u in said if d != c and q in said[d, u]]
            if own:
                found.append((level, 0, -max(u for _, u in own), c))
            elif others and min(others)[0] < t:
                found.append((level, 1, -min(others)[0], min(others)[1]))
        before = [u for d, u in asks if d == c and u < t]
        to = (min(found)[3], -min(found)[2]) if found else (c, max(before)) if before else None
        out[c, t] = [out[to][0] if to else c, None, to, len(found)]
    for k, v in out.items():
        v[1] = sum(1 for j, w in out.items() if w[0] == v[0] and j[1] < k[1])
    return out, clean


def test_conversations_match_plain_linking(spark, monkeypatch):
    monkeypatch.setattr(quotes, "RANGE", 4)
    r = random.Random(12)
    sentences = [" ".join(r.choice("red blue green old new big small".split()) for _ in range(r.randint(1, 4))) + r.choice([".", "!", "?"]) for _ in range(25)]
    rows, texts = [], []
    for c in range(1, 9):
        for t in sorted(r.sample(range(30), 12)):
            own = r.choice(["\n", " ", "\n\n"]).join(r.choice(sentences) for _ in range(r.randint(1, 4)))
            lines = own.split("\n")
            if texts and r.random() < 0.6:
                old = r.choice(texts).replace("\n\n", "\n").split("\n")
                at = r.randrange(len(old))
                lines = [r.choice([">", ">>"]) + x for x in old[at : at + r.randint(1, 2)]] + lines
            texts.append(own)
            rows.append((c, t, "user", "\n".join(lines)))
    want, clean = _plain_chat(rows)
    got = {(x.conv_id, x.turn): x for x in quotes.conversations(_chat(spark, rows)).collect()}
    assert sum(v[3] > 0 and v[2][0] != k[0] for k, v in want.items()) > 5 and sum(v[3] > 0 and v[2][0] == k[0] for k, v in want.items()) > 3
    for k, (thread, position, to, n) in want.items():
        x = got[k]
        assert ((x.reply_to_conv, x.reply_to_turn) if x.reply_to_turn is not None else None, x.n_links, x.thread, x.position) == (to, n, thread, position), k
        assert x.text == clean[k].strip()
        assert to is None or got[to].position < x.position and got[to].thread == x.thread
    made = quotes.threads(_chat(spark, rows), 5).collect()
    assert sum(len(x.messages) for x in made) == len(rows) and all(m.position // 5 == x.part for x in made for m in x.messages)


def test_long_paragraphs_and_very_long_chats(spark):
    lines = [f"line number {i} of it" for i in range(20_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join("> " + x for x in lines[5000:9000]) + "\nyes"), (1, 2, "user", "> line number 77 of it\nno"), (None, 4, "user", "one thing"), (None, 9, "user", "> one thing\nOk")]
    got = {(x.conv_id, x.turn): x for x in quotes.conversations(_chat(spark, rows)).collect()}
    assert [(got[k].reply_to_turn, got[k].n_links) for k in ((1, 1), (1, 2), (None, 9))] == [(0, 1), (0, 1), (4, 1)]


def test_an_original_is_the_latest_before(spark):
    same = "the very same answer every time"
    rows = [(1, t, "user", same if t % 400 == 0 else f"note {t}") for t in range(0, 3000, 10)] + [(1, 2995, "user", f"> {same}\nok"), (1, 401, "user", f"> {same}\nearly")]
    got = {r.turn: r for r in quotes.conversations(_chat(spark, rows)).collect()}
    assert got[2995].reply_to_turn == 2800 and got[401].reply_to_turn == 400


def test_places_are_counted_over_ranges(spark):
    r = random.Random(2)
    rows = [(c, r.randrange(10_000), "user", f"text {i}") for i, c in enumerate([1] * 700 + [2] * 20 + [3])]
    got = quotes.conversations(_chat(spark, rows)).collect()
    for c in (1, 2, 3):
        own = sorted((x.turn, x.position) for x in got if x.conv_id == c)
        turns = [t for t, _ in own]
        assert all(p == turns.index(t) for t, p in own) and len(own) == sum(1 for x in rows if x[0] == c)


def test_chat_on_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "a"), (1, 3, None, ""), (1, 3, "user", "twice here"), (1, 3, "user", "twice here"), (1, 4, "user", ">>>\n>\n> \nx"), (None, 2, "user", "> quoted text of nobody")]
    df = _chat(spark, rows).withColumn("n", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("quotes", F.lit(0)).withColumn("level", F.lit(0))
    got = quotes.conversations(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.turn == 4} == {"x"}
    assert quotes.conversations(df.where("false")).count() == 0
    assert len(quotes.conversations(spark.read.parquet(f"{SF}/conversations.parquet")).collect()) == spark.read.parquet(f"{SF}/conversations.parquet").count()


# --- pipeline ---


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as c
    from tests_llm_plain import brute_suffix, check_packed, plain_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    ruled = c.quality_rules(spark, docs, SF).cache()
    assert ruled.columns == docs.columns and {r.doc_id for r in ruled.collect()} == {d for d, t in before.items() if plain_rules(t)}
    judged = c.quality_classifier(spark, ruled, SF).cache()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id: r.text for r in judged.collect()}
    clean = [d for d in left.keys() | {r.doc_id for r in ruled.collect()} if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
    assert judged.columns == docs.columns and sum(d in left for d in clean) / len(clean) > 0.97
    toxic = [r.doc_id for r in ruled.collect() if r.doc_id in labels and labels[r.doc_id].toxic == 1]
    assert sum(d in left for d in toxic) / len(toxic) < 0.35  # forty toxic labels teach few words
    unique = c.near_duplicates(spark, judged, SF).cache()
    groups = _similar(list(left.items()))
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == set(groups.values())
    cut = c.repeated_passages(spark, unique, SF).cache()
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == brute_suffix([(r.doc_id, r.text) for r in unique.collect()])
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    check_packed(c.packed(spark, cut, SF).collect(), [(r.doc_id, r.text) for r in cut.collect()])


def test_pipeline_runs_whole(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "repeated_passages", "packing"]
    made = c.run(spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(made.columns)


def test_registry_names():
    names = list(registry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(registry.oracle_sql()) <= set(names)
