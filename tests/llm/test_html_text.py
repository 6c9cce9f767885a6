import html
import math
import random
import re
import time

from pyspark.sql import functions as F

from rangeloom.llm.html_text import MARKS, Tree, content_roots, extract, left_out, main_text, marked


def test_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        return "\n\n".join(b for b in blocks if b)

    want = {r.page_id: article(r.html) for r in pages.select("page_id", "html").collect()}
    got = main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_what_is_no_article_goes():
    page = """<!DOCTYPE html><html><head><title>t</title><script>if (a < b) { document.write("<p>no</p>") }</script></head>
    <body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><div id="cookie-notice">We use cookies</div>
    <div class="page"><div class="content"><h2>Title &amp; more</h2><p>First   para with <a href=x>a link</a>, long enough to count.</p><!-- <p>hidden</p> -->
    <p>Second&nbsp;para<br>line two &lt;tag&gt; &#233; &copy; that goes on.<ul><li>one<li>two</ul><p>Third.</p><div class="advert">Buy!</div></div>
    <aside>side</aside></div><section id="comments"><p>Great post! I love it so much that I write a long comment here.</p></section>
    <form><p>Sign up</p></form><footer>foot</footer></body></html>"""
    assert extract(page) == "Title & more\n\nFirst para with a link, long enough to count.\n\nSecond para line two <tag> é © that goes on.\n\none\n\ntwo\n\nThird."


def test_odd_pages():
    assert extract(None) == extract("") == extract("<div><script>x</script></div>") == extract("<!-- only") == ""
    assert extract("just text <b>x") == "just text x" and extract("<p>a<p>b") == "a\n\nb"
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert extract("<head><title>t</title><p>no body tag") == "no body tag"
    assert extract("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    extract("<" * 50_000)
    extract("<a b='" * 5000)
    assert len(extract("<article>" + "<p>word</p>" * 50_000 + "</article>")) == 50_000 * 6 - 2


def test_an_article_that_is_only_a_card_gives_way():
    body = "".join(f"<div><p>{f'sentence {i} of the text ' * 5}</p></div>" for i in range(30))
    card = f"<article><p>{'about the author of all this ' * 10}</p></article>"
    for page in (f"<body><div><section>{body}</section></div>{card}</body>", f"<body>{card}<div><section>{body}</section></div></body>"):
        got = extract(page)
        assert all(f"sentence {i} of" in got for i in range(30)) and "author" not in got


def test_attributes_are_read_by_name():
    text = "a sentence with many plain words in it. " * 5
    for attributes in ('href="/travel/hidden-gems.html"', 'title="a hidden valley"', 'href="/list?id=menu"', "href=/list?id=menu", "title='role=banner class=ad'", "data-hidden=no"):
        assert "linked words" in extract(f"<article><p>{text}<a {attributes}>linked words</a></p></article>"), attributes
    for attributes in ("hidden", 'class="menu"', "title=x id=menu", "ROLE='navigation'", 'style="display:none"', 'class="x"hidden'):
        assert "linked words" not in extract(f"<article><p>{text}</p><div {attributes}>linked words</div></article>"), attributes


def test_a_wrapper_of_the_page_stays():
    inner = "".join(f"<p>{f'sentence {i} of the text ' * 5}</p>" for i in range(5))
    for start, end in (("<form id=aspnetForm>", "</form>"), ("<div class=has-sidebar>", "</div>"), ("<div class=no-comments>", "</div>"), ("<div class='elementor-widget-theme-post-content'>", "</div>"), ("<div role=dialog>", "</div>")):
        for page in (f"<body>{start}{inner}{end}</body>", f"<body><article>{start}{inner}{end}</article></body>", f"<body>{start}<div class=comments><p>a comment</p></div><div class=text>{inner}</div>{end}</body>"):
            got = extract(page)
            assert all(f"sentence {i} of" in got for i in range(5)) and "comment" not in got, page
    assert extract(f"<body><div>{inner}</div><form><p>Sign up here</p></form><div class=no-comments>none yet</div></body>").count("\n\n") == 4


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in main_text(df).collect())
    assert got == [(0, "v", "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, "", "", 0)]
    assert main_text(df.limit(0)).collect() == []


def test_class_names_are_read_by_their_head():
    for name in ("cookie-notice", "ad-container", "siteFooter", "post-comments", "comment-body", "sidebar-left", "newsletter_box", "share-buttons", "ad", "ad-2", "related-posts-list related"):
        assert any(marked(x, MARKS) for x in name.split()), name
    for name in ("notice-board", "share-price", "comment-free", "has-sidebar", "no-comments", "elementor-widget-theme-post-content", "main-content", "badge", "header-text", "post", "article-body", "download"):
        assert not marked(name, MARKS), name
    board, price, lead = "the board tells of every thing that was noticed. " * 19, "the price of a share rose again today", "a lead that is free of any comment"
    page = f"<body><main><p>Intro.</p><div class='notice-board'><p>{board}</p></div><p class='comment-free'>{lead}</p><p>It is said that <span class='share-price'>{price}</span>.</p><div class='ad-box'>Buy!</div></main></body>"
    got = extract(page)
    assert board.strip() in got and price in got and lead in got and "Buy" not in got


def test_several_articles():
    text = "".join(f"<p>{f'sentence {i} of the text ' * 5}</p>" for i in range(9))
    page = f"<body><main><article>{text}</article><article class='comment'><p>{'a reader says so ' * 9}</p></article><article><p>teaser</p></article></main></body>"
    assert extract(page).count("sentence") == 45 and "reader" not in extract(page) and "teaser" not in extract(page)


def test_dense_sections_beside_the_best_are_taken():
    sections = ["".join(f"<p>{f'section {k} sentence {i} of it ' * 4}</p>" for i in range(n)) for k, n in enumerate((3, 12, 2, 4))]
    links = "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(40))
    got = extract(f"<body><div><ul>{links}</ul></div><div>{''.join(f'<div>{x}</div>' for x in sections)}</div><div><a href=x>more</a> <a href=y>and more</a></div></body>")
    assert [k for k in range(4) if f"section {k} sentence" in got] == [0, 1, 2, 3] and "link" not in got and "more" not in got


def plain_tree(rng, depth=0):
    """(tag, children): children are texts or elements."""
    tag = rng.choice(["div", "section", "div", "p"] if depth < 4 else ["p"])
    inner = []
    for _ in range(rng.randint(1, 4)):
        if tag == "p":
            words = " ".join(rng.choice(["word", "longer", "a", "text"]) for _ in range(rng.randint(1, 40)))
            inner.append(("a", [words]) if rng.random() < 0.3 else words + " ")
        else:
            inner.append(plain_tree(rng, depth + 1))
    return tag, inner


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"


def texts(node):
    if isinstance(node, str):
        return node
    return "".join(map(texts, node[1])) if node[0] in ("p", "a") else "\n\n".join(filter(None, (" ".join(texts(x).split()) for x in node[1]))) if all(x[0] == "p" for x in node[1]) else "\n\n".join(map(texts, node[1]))


def test_the_greatest_density_sum_is_selected():
    """Densities and their sums written out by recursion; the most dense subtree's texts are in the result."""
    rng = random.Random(6)

    def counts(node, link=False):
        if isinstance(node, str):
            n = len("".join(node.split()))
            return n, 0, n if link else 0, 0
        parts = [counts(x, link or node[0] == "a") for x in node[1]]
        own = [x for x in node[1] if not isinstance(x, str)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts) + len(own), sum(p[2] for p in parts), sum(p[3] for p in parts) + sum(x[0] == "a" for x in own)

    def density(node, all_chars, all_links):
        c, t, lc, lt = counts(node, node[0] == "a")
        if not c:
            return 0.0
        t, lc, lt = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c / max(1, c - counts(node, node[0] == "a")[2]) * lc + all_links / max(1, all_chars) * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)))

    def every(node):
        yield node
        for x in node[1]:
            if not isinstance(x, str):
                yield from every(x)

    for _ in range(150):
        tree = ("body", [plain_tree(rng) for _ in range(4)])
        page = written(tree)
        c, _, lc, _ = counts(tree)
        blocks = [x for x in every(tree) if x[0] != "a"]
        sums = [sum(density(y, c, lc) for y in x[1] if not isinstance(y, str)) for x in blocks]
        best = blocks[max(range(len(blocks)), key=lambda i: (sums[i], density(blocks[i], c, lc), -i))]
        parsed = Tree(page)
        roots = content_roots(parsed, left_out(parsed))
        assert sum(sums) == 0 or all(" ".join(x.split()) in extract(page) for y in every(best) if y[0] == "p" for x in ["".join(map(texts, y[1]))]), page
        assert len(roots) >= 1


def test_pages_of_any_shape_are_quick():
    pages = {
        "<a": "<a" * 500_000, "name": "<" + "b" * 1_000_000, "div": "<div>" * 100_000, "li": "<ul>" + "<div>" * 20_000 + "<li>x</li>" * 50_000, "quotes": "<b '>'" * 100_000, "values": "<b a='>'" * 100_000,
        "ends": "<div>" * 50_000 + "</span>" * 50_000, "scope": "<span><table>" + "<div>" * 50_000 + "</span>" * 50_000, "p": "<p><table>" + "<div>" * 80_000, "spaces": "<p " + " " * 500_000 + "a" * 500_000 + ">x",
        "signs": "<" * 1_000_000, "cells": "<table><tr>" + "<div>" * 30_000 + "<td>x" * 30_000, "head": "<head>" + "<span>" * 50_000 + "<p>x",
    }
    for name, page in pages.items():
        began = time.perf_counter()
        extract(page)
        assert time.perf_counter() - began < 30, name
