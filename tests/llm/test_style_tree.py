import html
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brisa.llm import style_tree
from brisa.llm.queries import QUERIES
from tests.llm.conftest import CLASHING, prose

SCHEMA = "page_id bigint, url string, html string"

CASES = [
    ("<p>a &amp; b<br>c<p>d&lt;p&gt;", ["a & b c", "d<p>"]),
    ("<article><h1>T</h1><p><b>x<br><p>y</b> z</p></article><p>outside</p>", ["T", "x", "y z"]),
    ("<main><p>in</p></main><div>out</div>", ["in"]),
    ("<main>a<article>b</article>c</main>", ["b"]),
    ("<div class='ad'>buy</div><div class=\"text has-sidebar\">t</div><nav><ul><li>m</ul></nav>u<footer>f", ["t", "u"]),
    ("<script>var t='<p>';</script>a<style>p{}</style>b<!-- c --><!-- d", ["ab"]),
    ("<title>t</title><head><meta charset=x><p>a", ["a"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><th>e</table>", ["a", "b", "c", "d", "e"]),
    ("<div>a<span class=share>no</span>b</div>", ["a", "b"]),
    ("<div>a<i>b</i> <span>c</span>\n  d</div>", ["ab c d"]),
    ("<article><header><h1>own</h1></header><section class='comments'><article>reader</article></section></article><header>site</header>", ["own"]),
    ("<div style='display: none'>x</div><div hidden>y</div><p aria-hidden=true>z</p><p>w", ["w"]),
    ("<form><input value='>'>x</form><p title='a>b' class=\"c>d\">y</p><p x=\"unclosed>z</p>", ["y", "z"]),
    ("a < b &am &amp c &copy; &#233;&#x41;", ["a < b &am & c © éA"]),
    ("<div class='menu'><main><p>kept</p></main>m</div>", ["kept"]),
    ("</p></div>a</b><p>b</body>c</html>d", ["a", "b", "c", "d"]),
    ("<div>" * 5000 + "deep<p>er", ["deep", "er"]),
    ("<dl><dt>a<dd>b<dt>c</dl><h2>d<h3>e</h3>", ["a", "b", "c", "d", "e"]),
    ("<svg><text>x</text></svg><select><option>o</select><textarea><p>t</textarea>a", ["a"]),
    ("", []), ("<p>", []), ("  \n", []), ("<", ["<"]), ("<p", []), ("a<!", ["a"]),
]


@pytest.mark.parametrize("page, want", CASES)
def test_blocks_that_names_leave(page, want):
    assert [b["text"] for b in style_tree.parsed(page)[1]] == want


def site(number, unlabelled="<div><ul><li>Home</li><li>About us</li></ul></div>"):
    """Pages whose menus, shares and notes no name gives away, with a shared passage on some."""
    pages = []
    for i in range(number):
        own = "".join(f"<p>{prose(1000 * number + 10 * i + j, 12)}</p>" for j in range(2 + i % 4))
        some = f"<p>{prose(7, 20)}</p>" if i % 3 == 0 else ""
        page = f"<html><body>{unlabelled}<div class='text'>{own}{some}<p>Read {i} more stories like this</p></div><div class='end'><p>All rights kept {i}</p></div>"
        pages.append(page)
    return pages


@pytest.fixture(scope="module")
def rows():
    rows = [(i, f"http://Big.example.org:80/{i}", p) for i, p in enumerate(site(30))]
    rows += [(100 + i, f"https://u@small.example.org/{i}", p) for i, p in enumerate(site(4))]
    rows += [(200 + i, f"//five.example.net/{i}", p) for i, p in enumerate(site(6, "<div><ul><li>Start</li></ul></div>"))]
    # Copies of one page are one page to the statistics.
    copy = f"<body><div class='text'><p>{prose(5, 40)}</p><p>{prose(6, 20)}</p></div>"
    rows += [(300 + i, f"http://copies.example.org/{i}", copy) for i in range(20)]
    rows += [(400, None, site(1)[0]), (400, None, site(1)[0]), (None, "no host", "<p>x"), (401, "http://big.example.org/", None), (402, "http://big.example.org/", "")]
    rows += [(403, "http://long.example.org/", "<p>" + "x y " * 300_000)]
    return rows


@pytest.fixture(scope="module")
def pages(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return frame.select("*", *[F.lit("other").alias(c) for c in [*CLASHING, "host", "longest", "blocks", "nodes", "part", "k", "m"]])


def brute(rows):
    """Texts by the definitions: entropies over every site's pages, counted by their longest block."""
    sites = defaultdict(list)
    for row in rows:
        host = re.match(style_tree.HOST, row[1] or "")
        sites[host.group(1).lower() if host else ""].append(style_tree.parsed(row[2] or ""))
    cut = {}
    for host, held in sites.items():
        distinct = {longest for longest, blocks, _ in held if blocks}
        m, cut[host] = len(distinct), set()
        if not host or m < style_tree.LEAST:
            continue
        items, styles, below = defaultdict(set), defaultdict(set), defaultdict(set)
        links = defaultdict(list)
        for longest, blocks, nodes in held:
            for b in blocks:
                items[b["item"]].add(longest)
                links[b["item"]].append(b["links"])
                for node in b["path"]:
                    below[node].add(b["item"])
            for n in nodes:
                styles[n["node"], n["style"]].add(longest)
        worth = {i: 1 - math.log(len(s)) / math.log(m) for i, s in items.items()}
        cut[host] |= {i for i, w in worth.items() if w < style_tree.THRESHOLD and len(items[i]) > 1}
        for node, held_items in below.items():
            total = sum(len(items[i]) for i in held_items)
            content = sum(len(items[i]) * worth[i] * (1 - sum(links[i]) / len(links[i])) for i in held_items) / total
            counts = [len(s) for (n, _), s in styles.items() if n == node]
            whole = sum(counts)
            shown = -sum(c / whole * math.log(c / whole) for c in counts) / math.log(whole) if whole > 1 else 1
            if style_tree.ATTENUATION * content + (1 - style_tree.ATTENUATION) * shown < style_tree.THRESHOLD:
                cut[host].add(node)
    out = []
    for page_id, url, page in rows:
        host = re.match(style_tree.HOST, url or "")
        gone = cut[host.group(1).lower() if host else ""]
        blocks = style_tree.parsed(page or "")[1]
        text = "\n\n".join(b["text"] for b in blocks if b["item"] not in gone and gone.isdisjoint(b["path"]))
        out.append((page_id, url, text, len(text)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_equals_brute_force(pages, rows, limit, monkeypatch):
    monkeypatch.setattr(style_tree, "BROADCAST", limit)
    found = style_tree.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(rows)


def test_what_a_site_repeats_goes_and_the_rest_stays(pages):
    texts = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    for i in range(30):
        own = [prose(30_000 + 10 * i + j, 12) for j in range(2 + i % 4)]
        assert texts[i] == "\n\n".join(own + ([prose(7, 20)] if i % 3 == 0 else []))
    assert "About us" in texts[100]
    assert texts[200].startswith(prose(6000, 12)) and "Start" not in texts[200]
    assert all(texts[300 + i] == f"{prose(5, 40)}\n\n{prose(6, 20)}" for i in range(20))
    assert texts[401] == "" and texts[402] == "" and len(texts[403]) == 4 * 300_000 - 1


def test_empty_table(pages):
    assert style_tree.extract(pages.where("false")).count() == 0


def test_query_on_a_given_table(spark):
    """The article of every page by its known frame: heading and paragraphs, each a block."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as base:
        rows = base.execute(f"SELECT page_id, url, html FROM '{folder}/pages.parquet'").fetchall()
    want = []
    for page_id, url, page in rows:
        article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        parts = [html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))) for p in re.split("</?(?:p|h1)>", article)]
        text = "\n\n".join(" ".join(p.split()) for p in parts if p.strip())
        want.append((page_id, url, text, len(text)))
    found = QUERIES["op11_html_extraction"](spark, folder).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(tuple(r) for r in found) == sorted(want)
