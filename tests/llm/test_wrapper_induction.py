"""Wrapper induction: tree matching against brute force, texts of known pages, what the alignment is worth."""

import collections
import random
import re
from functools import lru_cache

from erlink.llm import html_extract


def test_wrapper_induction(spark):
    page = """<html><head><title>T{i}</title></head><body><div class="top"><ul><li><a href=/>Home</a><li>News</ul></div>
    <div class="wrap"><h1>Title {i}</h1><p>Para {i} &amp; more.</p><p>Second <i>part</i> {i}.</p><div class="x9">Follow our channel</div></div><div>Copyright Corp</div></body></html>"""
    rows = [(i, "http://one.example/a", page.replace("{i}", str(i)), "extra") for i in range(9)]
    rows += [(20, "http://two.example/", "<nav>Menu</nav><article><h1>H</h1><p>a&amp;b <b>c</b>d<br>e<div class=comments>no</div></article><footer>F</footer>", ""), (21, None, None, ""), (22, "x", "", ""), (23, "y", "<div>" * 5000 + "deep", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, block string")).collect()}
    assert [got[i].text for i in range(9)] == [f"Title {i} Para {i} & more. Second part {i}." for i in range(9)]
    assert (got[20].text, got[20].n_chars) == ("H a&b cd e", 10)
    assert [got[i].text for i in (21, 22, 23)] == ["", "", "deep"]


def test_long_lists_align_exactly(monkeypatch):
    rng = random.Random(5)
    tree = lambda n: html_extract.parse("".join(rng.choice(["<p>a</p>", "<p>b</p>", "<h2>a</h2>", "<div><p>a</p><i>b</i></div>", "<div><p>b</p></div>", "<hr>"]) for _ in range(n)))
    for _ in range(60):
        a, b = tree(rng.randrange(1, 40)), tree(rng.randrange(1, 40))
        found = []
        for full, cells in ((4096, 1 << 20), (0, 1 << 20), (0, 1)):
            monkeypatch.setattr(html_extract, "TABLE", full)
            monkeypatch.setattr(html_extract, "CELLS", cells)
            pairs = []
            found.append(html_extract.match_trees(a, b, pairs))
            top = [(p, q) for p, q in reversed(pairs) if p in a.nodes]
            assert all(p.label == q.label for p, q in pairs[1:]) and [a.nodes.index(p) for p, _ in top] == sorted(a.nodes.index(p) for p, _ in top)
            assert [b.nodes.index(q) for _, q in top] == sorted(b.nodes.index(q) for _, q in top)
        assert len(set(found)) == 1, found
    monkeypatch.undo()
    page = lambda i: "<main>" + "".join(f"<p>x{i} {k}</p>" for k in range(70 + i)) + "<h2>Same</h2>" + "".join(f"<p>y{i} {k}</p>" for k in range(80 + i)) + "</main>"
    assert not any("Same" in t for t in html_extract.extract_block([page(i) for i in range(9)]))


def test_template_does_not_depend_on_the_first_page():
    page = lambda i: f"<html><body><div>Menu</div><div class=x><p>Para {i}.</p></div><ul><li>Notice</li></ul><section>Foot</section></body></html>"
    pages, want = [page(i) for i in range(12)], [f"Para {i}." for i in range(12)]
    for first in ("", "<html><body><table><tr><td>404</td></tr></table></body></html>", page(99).replace("<ul><li>Notice</li></ul>", ""), page(99).replace("Menu", "Other")):
        assert html_extract.extract_block([first, *pages])[1:] == want


def test_all_articles_and_the_rest_of_main_are_kept():
    page = lambda i: f"<article><p>First {i} is longer.</p></article><div>Between</div><article><p>Second {i}.</p></article>"
    whole = lambda i: f"<p>Out</p><main><p>Lead {i}.</p><p>Share this</p><article><p>Body {i} is by far the longest of them.</p></article><p>More {i}.</p></main><article>Last {i}</article>"
    assert html_extract.extract_block([page(1)]) == ["First 1 is longer. Second 1."]
    assert html_extract.extract_block([page(i) for i in range(9)]) == [f"First {i} is longer. Second {i}." for i in range(9)]
    assert html_extract.extract_block([whole(i) for i in range(9)]) == [f"Lead {i}. Body {i} is by far the longest of them. More {i}. Last {i}" for i in range(9)]


def brute_weight(a, b):
    """The greatest weight of a matching of two trees with matching roots, over all order-preserving assignments."""

    def lists(x, y):
        @lru_cache(maxsize=None)
        def best(i, j):
            if i == len(x) or j == len(y):
                return 0
            taken = brute_weight(x[i], y[j]) + best(i + 1, j + 1) if x[i].label == y[j].label else 0
            return max(taken, best(i + 1, j), best(i, j + 1))

        return best(0, 0)

    return 2 + (a.key == b.key) + lists(a.nodes, b.nodes)


def test_tree_matching_equals_brute_force(monkeypatch):
    rng = random.Random(8)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else rng.choice("ab")
        tag = rng.choice(["div", "div class=x", "ul", "section"])
        return f"<{tag}>{kids}</{tag.split()[0]}>"

    for table in (4096, 0):
        monkeypatch.setattr(html_extract, "TABLE", table)
        for _ in range(150):
            a, b = (html_extract.parse("".join(tree(3) for _ in range(rng.randint(1, 4)))) for _ in range(2))
            pairs = []
            assert html_extract.match_trees(a, b, pairs) == brute_weight(a, b) == sum(2 + (p.key == q.key) for p, q in pairs)
            assert len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)


def test_class_names_count_whole():
    keeps = "has-sidebar social-share-on no-ads content-sidebar post article comments-open noticeable header1 entry-header"
    assert not [x for x in keeps.split() if html_extract.marks(x)]
    assert all(map(html_extract.marks, "sidebar site-footer ad-1 ad_slot post-comments cookie-notice share-buttons comment-list related-posts newsletter-signup skip-link".split()))
    assert html_extract.extract_block(['<div class="layout has-sidebar"><p>Real main text here.</p></div>']) == ["Real main text here."]
    assert html_extract.extract_block(['<article class="post social-share-on"><p>Kept.</p></article>']) == ["Kept."]
    assert html_extract.extract_block(['<div class="sidebar">Short.</div><div class="promo"><p>This class name is that of most of the text of the page.</p></div>']) == ["This class name is that of most of the text of the page."]


def test_what_alignment_is_worth():
    """Pages of the tables with a notice and rights added, and without a telling tag or class: the article comes back from what varies."""
    import pyarrow.parquet as pq

    hosts = collections.defaultdict(list)
    for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        hosts[(x["url"] or "").split("/")[2]].append(x["html"] or "")
    n = aligned = alone = 0
    for pages in hosts.values():
        if len(pages) < 4:
            continue
        true = html_extract.extract_block(pages)
        bare = [re.sub(r"<(/?)(article|nav|footer)", r"<\1div", p).replace(' class="ad"', "") for p in pages]
        bare = [re.sub("(<body[^>]*>)", r"\1<div>This site uses small files to remember what you like. Read on to agree.</div>", p) + "<div>All rights are with the owners of this host and its writers.</div>" for p in bare]
        n += len(pages)
        aligned += sum(map(str.__eq__, html_extract.extract_block(bare), true))
        alone += sum(map(str.__eq__, html_extract.extract_block(bare, align=False), true))
    assert n > 150 and aligned >= 0.98 * n and alone <= 0.9 * n, (n, aligned, alone)


def test_pages_of_numbered_classes_share_slots():
    page = lambda i: f"<body><div class='post-{i}'><p>Text {i} of its own.</p><div>Same words on all pages</div></div></body>"
    assert html_extract.extract_block([page(i) for i in range(8)]) == [f"Text {i} of its own." for i in range(8)]


def test_long_and_deep_pages(spark):
    deep, flat = "<div>" * 20_000 + "deep", "<main>" + "".join(f"<p>p{k}" for k in range(30_000)) + "</main>"
    rows = [(1, "http://a.b/", deep, "x"), (1, "http://a.b/", deep, "x"), (2, "http://a.b/", flat, "y"), (2, "http://a.b/", None, "z")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "deep"), (1, "deep"), (2, ""), (2, " ".join(f"p{k}" for k in range(30_000)))]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_few_pages_that_agree_are_no_template():
    page = "<body><div><p>One text that two pages of a host share.</p><p>{}</p></div></body>"
    assert html_extract.extract_block([page.format("a"), page.format("b")]) == ["One text that two pages of a host share. a", "One text that two pages of a host share. b"]
