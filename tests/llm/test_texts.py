"""Text operators against plain versions, held-out labels and odd inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, langid, mainhtml, quality, substring
from shelfmark.llm.ngrams import ngram_ids, pattern_ids


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, score string")


ODD = [(900, None), (901, ""), (902, " \n"), (903, "x"), (None, "no id here"), (904, "word " * 30_000), (904, "word " * 30_000)]


def plain_removal(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def random_rows(seed, n, words=25, length=120):
    rng = np.random.default_rng(seed)
    shared = [" ".join(rng.choice(list("abcdefgh"), 30)) for _ in range(5)]
    rows = []
    for k in range(n):
        t = [*rng.choice([f"w{j}" for j in range(words)], rng.integers(1, length))]
        if rng.random() < 0.6:
            t.insert(int(rng.integers(len(t) + 1)), shared[rng.integers(5)])
        rows.append((int(k * 3 % n), " ".join(t)))
    return rows + [(n + 1, rows[3][1]), (n + 2, rows[3][1] + " tail"), (5, "another text with the same id " * 4)]


@pytest.mark.parametrize("window", [3, 13])
def test_passages_go_where_an_earlier_document_has_them(spark, window, monkeypatch):
    monkeypatch.setattr(substring, "BATCH", 2000)
    rows = random_rows(7, 90) + ODD + [(-4, "early words of a negative id " * 4), (2, "early words of a negative id " * 3)] + [(None, "no id " * 30)] * 20
    got = substring.without_copies(docs(spark, rows).repartition(5), window).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got), key=key) == sorted(plain_removal(rows, window), key=key)
    assert all(sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"] for r in got)


@pytest.mark.parametrize("bits", [4, 9])
def test_windows_with_one_hash_lose_nothing(spark, monkeypatch, bits):
    real = substring.window_hashes
    monkeypatch.setattr(substring, "window_hashes", lambda words, window: (real(words, window) >> np.uint64(64 - bits)) * np.uint64(0x0001000100010001))
    rows = random_rows(3, 40)
    spread, stream = substring._scan(3, 7, 5), substring._stream(3)
    import pyarrow as pa

    # the steps of without_copies by hand, as tasks of Spark would not see the patch
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    asked = sorted((r for b in spread(iter([batch.slice(0, 20), batch.slice(20)])) for r in b.to_pylist()), key=lambda r: (r["kind"], r["bucket"]))
    answers = pa.Table.from_batches(list(substring._answer(5)(iter([pa.RecordBatch.from_pylist(asked, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())]))]))))
    left = pa.table({"doc_id": batch.column(0), "row": pa.array(range(len(rows)), pa.int64()), "text": batch.column(1)})
    parts = [substring._passages(3, 3)((b,), left.filter(pa.array([i % 5 == b for i, _ in rows])), answers.filter(pa.array([x == b for x in answers.column("bucket").to_pylist()]))) for b in range(5)]
    passages = pa.concat_tables(parts)
    marked: dict = {}
    lost = []
    for k in range(3):
        for r in stream(passages.filter(pa.array([x == k for x in passages.column("shard").to_pylist()]))).to_pylist():
            gone = marked.setdefault((r["doc"], r["row"]), set())
            for a, b in zip(r["firsts"], r["ends"]):
                gone |= set(range(a, b))
            lost += [(r["doc"], r["row"], w["first"], w["words"]) for w in r["lost"]]
    owner: dict = {}
    for doc, _, _, w in lost:
        owner[w] = min(doc, owner.get(w, doc))
    for doc, row, first, w in lost:
        if owner[w] < doc:
            marked.setdefault((doc, row), set()).update(range(first, first + 3))
    assert lost and [len(marked.get((i, k), ())) for k, (i, _) in enumerate(rows)] == [r[2] for r in plain_removal(rows, 3)]


def test_automaton_knows_the_smallest_document():
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [(int(d), [b"abc"[k : k + 1] for k in rng.integers(0, 3, rng.integers(1, 25))]) for d in rng.permutation(9)[:4]]
        a = substring.Automaton()
        for d, w in texts:
            a.add(d, w)
        a.finish()
        probe = [b"abcd"[k : k + 1] for k in rng.integers(0, 4, 30)]
        for window in (1, 2, 4):
            want = [i for i in range(window - 1, 30) if any(d < 5 and probe[i - window + 1 : i + 1] == w[k : k + window] for d, w in texts for k in range(len(w) - window + 1))]
            assert a.covered(5, probe, window) == want


def test_window_hashes_tell_windows_apart():
    w = [b"ab", b"c", b"a", b"bc", b"ab", b"c", b"a", b"bc"]
    h = substring.window_hashes(w, 2)
    assert h[0] == h[4] and h[2] == h[6] and len(set(h.tolist())) == 4


def test_no_documents(spark):
    none = docs(spark, [])
    assert substring.without_copies(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([(1, "a test item of some words")], "item_id long, text string")).count() == 0
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards box a very jolly penguin at dawn"


def test_leaks_are_found_whole_and_edited(spark):
    rng = np.random.default_rng(1)
    noise = lambda n: " ".join(rng.choice([f"n{k}" for k in range(3000)], n))
    edited = ITEM.replace("brown", "red").replace("seven wizards", "eight old wizards").replace("very ", "")
    rows = [(1, f"{noise(200)} {ITEM} {noise(100)}"), (2, f"{noise(50)} {edited.upper()}!"), (3, noise(300)), (4, "the quick brown fox " + noise(40)), (5, ITEM), *ODD]
    tests = spark.createDataFrame([(70, ITEM), (71, noise(30)), (72, None), (73, "two worlds"), (74, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, rows), tests).collect()}
    assert set(got) == {(1, 70), (2, 70), (5, 70)}
    assert got[1, 70]["score"] == got[5, 70]["score"] == 1.0 and 0.5 <= got[2, 70]["score"] < 1
    assert (got[1, 70]["first_word"], got[1, 70]["end_word"]) == (200, 219)
    left = [r["doc_id"] for r in decontaminate.clean(docs(spark, rows), tests).collect()]
    assert sorted(x for x in left if x) == [3, 4, 900, 901, 902, 903, 904, 904] and None in left


def test_an_item_in_many_documents_is_still_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 300)  # several chunks
    rows = [(k, f"x{k} y{k} {ITEM} z{k}") for k in range(60)] + [(100 + k, f"only the quick words u{k} v{k}") for k in range(60)]
    tests = spark.createDataFrame([(k, ITEM if k == 0 else " ".join(f"q{k}_{j}" for j in range(20))) for k in range(12)], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, rows), tests).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60)) and {r["item_id"] for r in got} == {0}


def test_short_items_are_found_as_they_are(spark):
    rows = [(1, "so Two, words here"), (2, "words two"), (3, "two"), (4, "two words two words")]
    tests = spark.createDataFrame([(8, "two words"), (9, "Here!"), (10, "?"), (8, "two words")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["first_word"], r["end_word"]) for r in decontaminate.leaks(docs(spark, rows), tests).distinct().collect())
    assert got == [(1, 8, 1.0, 1, 3), (1, 9, 1.0, 3, 4), (4, 8, 1.0, 0, 2)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs(spark, rows), none).count() == 0 and decontaminate.clean(docs(spark, rows), none).count() == 4


def test_leaks_equal_every_document_against_every_item(spark):
    rng = np.random.default_rng(9)
    words = [f"v{k}" for k in range(400)]
    items = [[*rng.choice(words, int(rng.integers(5, 40)))] for _ in range(12)]
    rows = []
    for k in range(90):
        item = items[int(rng.integers(12))]
        part = [w for w in item[: int(len(item) * rng.uniform(0.3, 1.0)) + 1] if rng.random() > 0.08]
        rows.append((k, " ".join([*rng.choice(words, int(rng.integers(0, 60))), *part, *rng.choice(words, int(rng.integers(0, 60)))])))
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs(spark, rows), tests).collect()}
    want = {(k, j): s for k, t in rows for j, x in enumerate(items) if (s := slow_alignment(x, t.split()) / (2 * len(x))) >= 0.5}
    seeded = {(k, j) for k, j in want if {tuple(items[j][i : i + 3]) for i in range(len(items[j]) - 2)} & {tuple(t[i : i + 3]) for t in [rows[k][1].split()] for i in range(len(t) - 2)}}
    assert set(got) <= set(want) and seeded <= set(got) and len(want) > 30  # a copy without three words in a row in common has no seed
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_items_quoted_in_part_by_very_many_are_found(spark):
    item = [f"i{k}" for k in range(40)]
    rows = [(k, f"x{k} y{k} " + " ".join(item[:21]) + f" z{k}") for k in range(30)]  # 0.525 of a full match, no seed in 20 documents or fewer
    rows += [(100 + k, f"x{k} " + " ".join(item[:9]) + f" z{k} " * 40) for k in range(30)]  # below the limit
    tests = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.leaks(docs(spark, rows), tests).collect()}
    assert got == {k: 0.525 for k in range(30)}
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), tests).collect()} == set(range(100, 130))


def slow_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISS
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_equal_the_plain_recurrence():
    rng = np.random.default_rng(2)
    lengths, width = rng.integers(1, 12, 40), 25
    items, windows = np.full((40, 12), -1), np.full((40, width), -2)
    for k, n in enumerate(lengths):
        items[k, :n] = rng.integers(0, 4, n)
        m = rng.integers(1, width + 1)
        windows[k, :m] = rng.integers(0, 4, m)
    score, _ = decontaminate.align(items, lengths, windows)
    assert score.tolist() == [slow_alignment(items[k, :n].tolist(), [w for w in windows[k].tolist() if w != -2]) for k, n in enumerate(lengths)]


def test_ngrams_are_distinct_and_whole():
    for text in ("", "a", "abcabc", "é" * 50, "long " * 4000):
        want = {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
        assert len(ngram_ids(text, (1, 2, 3), 18)) == len(want)
    assert pattern_ids("a b c d").tolist() == [0] and len(pattern_ids("x x x x y")) == 2 and len(pattern_ids("a b")) == 0


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    good, bad = [f"good{k}" for k in range(300)], [f"BAD{k}!!" for k in range(300)]
    rows = []
    for k in range(n):
        words = rng.choice(good if k % 3 else bad, rng.integers(3, 60))
        rows.append((k, " ".join(words)))
    return rows


def test_quality_is_learned_and_scores_everything(spark):
    rows = labelled(300)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)] + [(5, 1, 0), (None, 1, 0), (7, None, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + ODD)
    model = quality.fit(df, labels, F.col("doc_id") % 4 != 1)
    got = quality.score(df, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and (r["doc_id"] % 4 == 1 or r["doc_id"] >= 200)]
    assert np.mean(right) > 0.97
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] >= 0.5}


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_quality_without_both_classes(spark, labels, score):
    df = docs(spark, labelled(5))
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    assert all(abs(r["score"] - score) < 1e-6 for r in quality.score(df, model, ["doc_id", "text"]).collect())


def test_languages(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["alba", "arena", "casa", "mar"], "bb": ["brot", "stück", "schule", "wurst"], "cc": ["école", "frère", "où", "reçu"]}
    rows = [(k, " ".join(rng.choice(words[l], rng.integers(2, 30))), l) for k, l in enumerate(rng.choice(list(words), 240).tolist())]
    odd = [(500, None, "aa"), (501, "", "aa"), (502, "123 !?", "bb"), (503, "casa", None), (None, "brot", "bb"), (504, "école " * 20_000, "cc")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df, F.col("doc_id") % 4 != 2)).collect()}
    assert np.mean([got[k]["lang_pred"] == l for k, _, l in rows if k % 4 == 2]) > 0.97
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (500, 501, 502)] == [("und", 0.0)] * 3
    assert (got[503]["lang_pred"], got[504]["lang_pred"], got[None]["lang_pred"]) == ("aa", "cc", "bb")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}


def test_collapsed_products_equal_the_kernel():
    texts, langs = ["una casa blanca", "la casa del mar", "das ist ein haus", "ein kleines haus"], ["es", "es", "de", "de"]
    rows = [langid.presence(t) for t in texts]
    model = langid.train(rows, langs)
    sizes = np.array([len(r) for r in rows], float)
    kernel = np.array([[len(np.intersect1d(a, b)) for b in rows] for a in rows]) / np.sqrt(np.outer(sizes, sizes))
    y = np.where(np.array(langs)[:, None] == np.array(model.langs)[None, :], 1.0, -1.0)
    marks = [2, 3, 0, 1]  # landmarks by language
    own = kernel[:, marks]
    alpha = np.linalg.lstsq(own.T @ own + 1e-3 * 4 * own[marks] + 1e-8 * np.eye(4), own.T @ y, rcond=None)[0]
    direct = own @ alpha
    through = np.array([model.product[r].sum(0) / np.sqrt(len(r)) for r in rows])
    assert np.allclose(direct, through, atol=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header>Site <a href=/>Home</a></header>
<nav><ul><li><a href=a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="page-{n}"><div class="sidebar">Side text that is here</div>
<div class="content item{n}"><h1>Title {n}</h1><p>First &amp; <b>wor</b>d {n}&nbsp;x.<br>line<p>Second   para of some length here <a href=x>link</a>.<script>if (a < b) x("</p>")</script>
<form><input value="a>b">Send</form><div class="post-comments"><p>A reader says something quite long about this page, longer than the text</p></div></div></div><footer>Foot</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, host string")


def test_main_text_of_templates(spark):
    rows = [(k, f"http://Host.example/{k}", PAGE.format(n=k)) for k in range(6)]
    rows += [(10, "http://host.example/x", "<p>Bare &lt;page&gt; text"), (11, None, "<article>Ar<i>tic</i>le</article><aside>no</aside>"), (12, "u", None), (13, "u", ""), (14, "http://host.example/y", "<nav>only menu</nav>"), (None, "http://h/", "plain"), (15, "http://h/", "<div class=ad>buy<article>Real text</article></div>after</html>"), (15, "http://h/", "<div class=ad>buy<article>Real text</article></div>after</html>")]
    got = {}
    for r in mainhtml.main_texts(pages(spark, rows)).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]] = r["text"]
    for k in range(6):
        assert got[k] == f"Title {k} First & word {k} x. line Second para of some length here link."
    assert (got[10], got[11], got[12], got[13], got[14], got[None], got[15]) == ("Bare <page> text", "Article", "", "", "", "plain", "Real text")


@pytest.mark.parametrize(("attributes", "bad"), [
    ('class="content with-sidebar"', False), ('class="main-sidebar"', True), ('class="page-header"', True), ('class="content sidebar-left"', False), ('id="comments"', True), ('class="comment-list item3"', True), ('class="ad"', True), ('class="gradient read"', False), ('role="banner"', True),
    ('style="display: none"', True), ("hidden", True), ('class="header"', True), ('class="has-sidebar"', False), ('class="cookie_banner"', True), ('class="story-body"', False), ('aria-hidden="true"', True), ('data-hidden="x"', False),
])
def test_what_is_not_the_article(attributes, bad):
    page = mainhtml.Page(f"<div {attributes}>x</div>")
    page.settle()
    assert page.bad[1] is bad


@pytest.mark.parametrize(("html", "text"), [
    ("<article><p title='it's fine'>One <b>two</b>.</p></article>", "One two."),
    ("<article><p><a href=don't>One</a></p><p>it's two</p></article>", "One it's two"),
    ("<!--><article>Text</article>", "Text"),
    ("<!---><article>Text</article><!-- <b>no</b> -->", "Text"),
    ("<article>Before <section id=\"comments-on-kant\"><p>Kant wrote</p></section><div class=\"related-work\">Others did</div><table class='menu-prices'><tr><td>Soup<td>3</table></article>", "Before Kant wrote Others did Soup 3"),
    ("<article>Text</article><div class='related-foos'><a href=a>One</a> <a href=b>Two</a></div>", "Text"),
    ("<body><p title=\"open>Text", "Text"),
    ("<article>a < b &lt; c <3</article>", "a < b < c <3"),
    ("<article>a<iframe src=x>b</article>", "ab"),
    ("<article>a<SCRIPT>'</b>'</Script >b</article>", "ab"),
    ("<article>a<textarea>x</textarea><button>y</button><noscript>z</noscript>b</article>", "ab"),
    ("<article a=1 a=2 / class = x>t</article >u", "t"),
    ("x <a", "x"), ("", ""), ("<", "<"), ("</", ""), ("<!", ""), ("<p/>t", "t"),
])
def test_markup_as_it_comes(html, text):
    assert mainhtml.extract(html, [])[0].replace("  ", " ") == text


@pytest.mark.parametrize("part", ["<a \"", "<a x=\"", "<a x='>", "<!--", "<iframe>", "</", "<b ", "<div>", "<p><b>", "<textarea", "</div", "<title>", "<i>", "</x>", "<table><tr><td>"])
def test_time_grows_with_the_page_alone(part):
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        mainhtml.extract("<article>Text</article>" + part * n, [])
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_host_settles_what_one_page_leaves_in_doubt(spark):
    row = "<body><div class=main><p>{}</p><div class='menu-of-day'>{}</div></div>"
    rows = [(k, "http://h/a", row.format("text of the page " * 20, "a dish and another dish and then some more of what there is " * 2)) for k in range(5)] + [(9, "http://h/b", row.format("text " * 50, "soup"))]
    got = {r["page_id"]: r["text"] for r in mainhtml.main_texts(pages(spark, rows)).collect()}
    assert got[9].endswith("soup") and "dish" in got[0]
    assert mainhtml.extract(rows[-1][2], [])[0].endswith("text")


def test_headings_before_the_body_of_a_post_stay(spark):
    row = "<body><div class=post><h1>Heading {}</h1><div class=body><p>{}</p></div></div><div class=foot>x</div>"
    rows = [(k, "http://h/a", row.format(k, "words of the page " * 200)) for k in range(3)] + [(9, "http://h/b", row.format(9, "short"))]
    got = {r["page_id"]: r["text"] for r in mainhtml.main_texts(pages(spark, rows)).collect()}
    assert all(got[k].startswith(f"Heading {k} ") for k in (0, 1, 2, 9))


def test_no_pages(spark):
    assert mainhtml.main_texts(pages(spark, [])).count() == 0
    assert [r["text"] for r in mainhtml.main_texts(pages(spark, [(1, None, "<p>" + "long " * 400_000)])).collect()] == [("long " * 400_000).strip()]


def test_hosts_agree_on_a_path(spark):
    # one page has more text in a box of quotes than in its article; its host's other pages decide
    normal = "<body><div class=main><p>{}</p></div><div class=quotes><p>short</p></div>"
    odd = "<body><div class=main><p>The article.</p></div><div class=quotes><p>{}</p></div>".format("quote " * 40)
    rows = [(k, "http://h/a", normal.format("text of the page " * 20)) for k in range(5)] + [(9, "http://h/b", odd)]
    paths = {r["host"]: r["paths"] for r in mainhtml.host_paths(pages(spark, rows)).collect()}
    assert paths["h"][0] == ">body>div.main"
    got = {r["page_id"]: r for r in mainhtml.main_texts(pages(spark, rows)).collect()}
    assert got[0]["path"] == ">body>div.main" and "quote" not in got[9]["text"] and got[9]["text"] == "The article."


def test_digest_of_kept_words(spark):
    got = substring.without_copies(docs(spark, [(1, "a b"), (2, None)])).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in got} == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
