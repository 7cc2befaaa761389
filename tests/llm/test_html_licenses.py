import re

import pytest

from cubeloom.llm import html, licenses
from cubeloom.llm._common import read

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{a:b}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div><!-- x -->
<article><h1>Head &amp; tail</h1><p>One
 two<p>Three &lt;b&gt; <b>four</b>five<br>six<ul><li>a<li>b</ul><div class="ad">Buy</div><form><input>mail</form></article>
<aside>side</aside><section id="comments"><article class="comment"><p>first!</article></section><footer>&copy; me</footer></body></html>"""


def test_article_without_the_rest():
    assert html.main_text(PAGE, {}, 0.25) == "Head & tail\n\nOne two\n\nThree <b> fourfive six\n\na\n\nb"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "a < b", "<p>x", "<script>", "<!--", "<!-- x", "</p></p>", "<p a='>'>x</p>", '<p a=">x'])
def test_broken_pages_do_not_fail(page):
    html.main_text(page, {}, 0.25)
    html.page_features(page)


def test_pages_equal_a_plain_reading(spark, small):
    from html import unescape

    def plain(page):
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(b for b in blocks if b)

    pages = read(spark, small, "pages")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    for most in (200_000, 0):  # the tree sent to all executors, and joined
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_texts(pages, most_broadcast=most).collect()}
        assert got == {k: (v, len(v)) for k, v in want.items()}


def test_tree_removes_what_a_site_repeats(spark):
    def page(i):
        return f"<body><div class='top'><p>Same on all pages</p></div><div class='main'><p>Own text {i} of this page</p><p>and more {i * i}</p></div></body>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(99, None, page(99)), (100, "http://one.example/", page(100))]
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 of this page\n\nand more 9"
    assert got[99].startswith("Same on all pages") and got[100].startswith("Same on all pages")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_texts(empty).count() == 0


def site(spark, page, n=20):
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(n)]
    return {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_tree_decides_within_articles(spark):
    def page(i):
        return f"<body><article><h1>Head {i}</h1><p>Own <b>bold</b> text {i}</p><p>and more {i * i}</p><div class='x1'><p>Donate to <a>us</a> now</p></div></article></body>"

    assert site(spark, page)[3] == "Head 3\n\nOwn bold text 3\n\nand more 9"
    assert site(spark, page, 2)[1].endswith("Donate to us now")  # two pages tell too little
    assert site(spark, lambda i: page(5))[3].startswith("Head 5\n\nOwn bold text 5")  # copies of one page


def test_minor_article_is_not_the_page(spark):
    def page(i):
        body = "".join(f"<p>Sentence {k} of page {i} says {i * k + k}</p>" for k in range(8))
        return f"<body><div class='top'><p>Same on all pages</p></div><div class='content'>{body}</div><article class='teaser'><p>Teaser {i}</p></article></body>"

    got = site(spark, page)[3]
    assert "Sentence 7 of page 3 says 28" in got and "Same on all" not in got and "Teaser 3" in got


# ---- licences


def brute(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    more = set()
    for line in low.split("\n"):
        block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, texts in licenses.TEMPLATES.items():
            for t in texts:
                tokens = set(t.split())
                if len(tokens & block) >= 0.85 * len(tokens):
                    more.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


ODD = ["", None, "CC BY\ncc-by cc  by, CC\nBY", "General Public\nLicense All rights  RESERVED all rights", "É CC BY É", "released under the MIT license. now", "the software is provided as is without warranty of any kind", "x" * 100_000 + " cc by"]


def test_scan_equals_brute_force(spark, small):
    docs = read(spark, small, "documents").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:7] for r in licenses.scan(docs).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    assert licenses.scan(docs.limit(0)).count() == 0


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """ * Redistribution and use in source and binary
 * forms, with or without modification, are permitted
 * provided that the following conditions
 * are met:"""


def test_templates_over_line_feeds(spark):
    apart = MIT.replace("\nof this", "\n\nof this")
    rows = [(0, MIT), (1, BSD), (2, MIT.replace("\n", "\r\n")), (3, apart), (4, "released under\n" + "other words " * 40 + "\nthe mit license"), (5, "Released under\nthe MIT license")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("mit", 1.0), 3: ("", 0.0), 4: ("", 0.0), 5: ("mit", 1.0)}


def test_only_whole_names_tell_a_purpose(spark):
    def page(i):
        return (
            f"<body><article><h1>Head {i}</h1><div class='related-work'><p>Body text {i}</p></div><p class='ad-hoc'>An aim {i}</p>"
            f"<blockquote class='notice-board'>Quoted {i}</blockquote><div class='ad-box'>Buy {i}</div><div class='comments list'>He said {i}</div><p class='sidebar_left'>Side {i}</p></article></body>"
        )

    for n in (1, 20):
        assert site(spark, page, n)[0] == "Head 0\n\nBody text 0\n\nAn aim 0\n\nQuoted 0"


def test_an_empty_tree_changes_articles(spark):
    """The entropies decide blocks of pages that mark their articles."""
    def page(i):
        return f"<body><article><h1>Head {i}</h1><p>Own text {i}</p><div class='x1'><p>Donate to us now</p></div><div class='x2'><p>Follow us</p></div></article></body>"

    tree = {r["path"] & 0xFFFFFFFFFFFFFFFF: (r["node_importance"], r["content_importance"], r["pages"]) for r in html.style_tree(spark.createDataFrame([(f"http://a.example/{i}", page(i)) for i in range(20)], "url string, html string")).collect()}
    for i in range(20):
        assert html.main_text(page(i), tree, 0.25) == f"Head {i}\n\nOwn text {i}"
        assert html.main_text(page(i), {}, 0.25) == f"Head {i}\n\nOwn text {i}\n\nDonate to us now\n\nFollow us"


def test_pages_with_odd_columns(spark):
    rows = [(1, None, "<p>one</p>", 1, "x"), (1, None, "<p>one</p>", 1, "x"), (None, "http://a.example/", None, 2, "y"), (3, "nowhere", "", 3, None), (4, "http://a.example/", "<p>" + "long " * 50_000 + "</p>", 4, "z")]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host long, text string")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 3), ("1", 3), ("3", 0), ("4", 249_999), ("None", 0)]


def test_licences_with_odd_columns(spark):
    rows = [(1, "Licensed CC BY", 5, "x"), (1, "Licensed CC BY", 5, "x"), (None, None, 6, "y"), (2, "", 7, None), (3, "all rights reserved " * 20_000, 8, "z")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, score long, labels string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["base_labels"]) for r in got) == [("1", 3, 1, "cc-by"), ("1", 3, 1, "cc-by"), ("2", 0, 0, ""), ("3", 60_000, 20_000, "reserved"), ("None", 0, 0, "")]
