"""Articles out of pages of many make-ups, and the wrappers' laws."""

import itertools
import json
import random
import time

import pytest

from caselattice.llm import html_text as ht

WORDS = "the river ran under an old stone bridge where children had played for years before new houses came".split()
SCHEMA = "page_id long, url string, html string, text string, host long"


def prose(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def links(rng, n=5):
    return "".join(f'<li><a href="/{i}">{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>' for i in range(n))


def article(rng):
    return [prose(rng, 6)] + [prose(rng) for _ in range(rng.randint(1, 5))]


def classic(rng, parts):
    body = "".join(f"<p>{p}</p>\n" for p in parts[1:])
    return f"""<!DOCTYPE html><html><head><title>x</title><script>if (a < b) document.write("<p>no</p>")</script><style>p {{}}</style></head>
    <body><header><h1>Site of {rng.choice(WORDS)}</h1></header><nav><ul>{links(rng)}</ul></nav><div id="cookie-notice">We use cookies. {prose(rng, 8)}</div>
    <article><h1>{parts[0]}</h1>{body}</article><aside><h3>Popular</h3><ul>{links(rng)}</ul></aside>
    <section class="comments"><h2>3 Comments</h2><article class="comment"><p>{prose(rng, 30)}</p></article><article class="comment"><p>{prose(rng, 80)}</p></article></section>
    <form><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; {prose(rng, 9)}</footer></body></html>"""


def no_marks(rng, parts):
    """No semantic element and no class that says anything."""
    body = "".join(f"<p>{p}" for p in parts[1:])
    return f"""<body><table><tr><td><ul>{links(rng)}</ul></td><td><h2>{parts[0]}</h2>{body}</td><td><ul>{links(rng, 8)}</ul></td></tr></table><div>Made with care in a small town.</div>"""


def named(rng, parts):
    body = "".join(f"<p>{p}</p><div class='ad-slot'>{prose(rng, 12)}</div>" for p in parts[1:])
    return f"""<body class="has-sidebar"><div class="topBar">{prose(rng, 5)}</div><div class="wrap"><div class="entry-content"><h1>{parts[0]}</h1>{body}</div>
    <div class="side sidebar">{prose(rng, 30)}</div><div role="complementary">{prose(rng, 30)}</div><div style="display: none">{prose(rng, 20)}</div></div><div class=newsletter>{prose(rng)}</div></body>"""


def form_around(rng, parts):
    body = "".join(f"<p>{p}</p>" for p in parts[1:])
    return f"""<body><form id=aspnet><div role=navigation>{links(rng)}</div><main><div class=breadcrumbs><a>a</a></div><h1>{parts[0]}</h1><article><header><p>By somebody</p></header>{body}
    <footer><a>tag</a></footer></article><div><h3>Related articles</h3><p>{prose(rng)}</p></div></main></form>"""


def run(spark, rows):
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], SCHEMA).repartition(3)
    return {r["page_id"]: r for r in ht.main_text(df).collect()}


@pytest.mark.parametrize("make", [classic, no_marks, named, form_around])
def test_makes(spark, make):
    """Thirty pages of a host and one page alone give their article and nothing else."""
    rng = random.Random(4)
    want = {i: article(rng) for i in range(31)}
    found = run(spark, [(i, f"http://{'alone' if i == 30 else 'many'}.org/{i}", make(rng, parts)) for i, parts in want.items()])
    assert {i: r["text"] for i, r in found.items()} == {i: "\n".join(p) for i, p in want.items()}
    assert all(r["n_chars"] == len(r["text"]) and "html" not in r for r in found.values())


def test_copies_are_kept(spark):
    """A host whose articles are all the same, or share passages, keeps them."""
    rng = random.Random(6)
    parts = article(rng)
    for make in (classic, no_marks):
        found = run(spark, [(i, "http://copies.org/", make(rng, parts)) for i in range(12)])
        assert {r["text"] for r in found.values()} == {"\n".join(parts)}


def test_text_of_a_block(spark):
    """References, also broken ones, white space, inline elements, unclosed and crossed tags, comments that never end, stray brackets."""
    pages = [
        "<article><p>a&amp;b &lt;i&gt; &eacute;&#233;&#xE9; &copy &nbsp; x\n\t y<br>z</p><p>1 < 2 <b>bold<i>er</b> te</i>xt<p><b>open<br><p>next</article>after",
        "<ARTICLE><P CLASS='>'>one</P><!-- <p>no</p> --><p title=it's>two</p><!-- never <p>ends</article>",
        "<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table><dl><dt>g<dd>h</dl></article>",
        "<article><script>'<p>x</p>'</SCRIPT >ok<textarea><p>no</textarea> go<style>never ends <p>no",
        "just words",
    ]
    found = run(spark, [(i, f"http://{i}.org", h) for i, h in enumerate(pages)])
    assert [found[i]["text"] for i in range(5)] == [
        "a&b <i> ééé © x y z\n1 < 2 bolder text\nopen\nnext", "one\ntwo", "a\nb\nc\nd\ne\nf\ng\nh", "ok go", "just words",
    ]


def test_nulls_empty_long_repeats(spark):
    """Null and empty html and urls, a page of 3 MB, repeated rows, 20,000 levels, no pages."""
    long = "word " * 600_000
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    rows = [(1, None, None), (2, "x", ""), (3, None, "<p>a</p>"), (4, "http://l.org", f"<article>{long}</article>"), (5, "http://d.org", deep), (6, "http://r.org", "<p>b"), (6, "http://r.org", "<p>b")]
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], SCHEMA)
    found = ht.main_text(df).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in found) == [(1, 0), (2, 0), (3, 1), (4, 2_999_999), (5, 9), (6, 1), (6, 1)]
    assert ht.main_text(df.where("false")).collect() == []


def test_pages_without_the_hosts_article(spark):
    """On a host with articles, a page without one gives what isn't left out."""
    rng = random.Random(8)
    rows = [(i, "http://mixed.org/", classic(rng, article(rng))) for i in range(10)]
    rows.append((10, "http://mixed.org/about", f"<body><nav><ul>{links(rng)}</ul></nav><div><p>About us</p></div><footer>x</footer>"))
    rows.append((11, "http://mixed.org/empty", f"<body><nav><ul>{links(rng)}</ul></nav><footer>x</footer>"))
    found = run(spark, rows)
    assert (found[10]["text"], found[11]["text"]) == ("About us", "")


def shapes(w):
    return json.dumps([w.items, w.n, w.words, w.links, w.n_links, w.low, w.high, sorted(s for g in w.order for s in g[1]), {s: shapes(w.kids[s]) for s in sorted(w.kids)}])


def accepts(w, e):
    """Whether the wrapper's expression fits an element: children only of its kind, in its order or inside one of its groups."""
    at = {s: i for i, g in enumerate(w.order) for s in g[1]}
    last, seen = -1, set()
    for kid in e.kids:
        s = ht.SLOT if isinstance(kid, tuple) else kid.sig
        if s not in at or at[s] < last or (at[s] == last and not w.order[last][0]):
            return False
        last = at[s]
        seen.add(s)
        if s != ht.SLOT and not accepts(w.kids[s], kid):
            return False
    return all(s in seen for g in w.order if len(g[1]) == 1 for s in g[1] if w.kids[s].n == w.items)


def test_wrappers_fit_all_their_pages():
    """Aligned in any order and grouping: the same sums and the same verdicts, and every page fits the expression."""
    rng = random.Random(9)
    tags = ["<p>x</p>", "<h2>y</h2>", "<ul><li>1<li>2</ul>", "<div class=a><p>z</p></div>", "<div class=b>w<p>u</div>", "<blockquote>q</blockquote>", "text"]
    pages = [ht.parse("<article>" + "".join(rng.choice(tags) for _ in range(rng.randint(0, 6))) + "</article>") for _ in range(60)]
    found = []
    for seed in range(8):
        order = random.Random(seed).sample(pages, len(pages))
        cuts = sorted(random.Random(seed).sample(range(1, 60), seed))
        parts = []
        for a, b in itertools.pairwise([0, *cuts, 60]):
            w = ht.of_page(order[a])
            for e in order[a + 1:b]:
                ht.aligned(w, ht.of_page(e))
            parts.append(ht.Wrapper.unpacked(json.loads(json.dumps(w.packed()))))
        for part in parts[1:]:
            ht.aligned(parts[0], part)
        assert all(accepts(parts[0], e) for e in pages)
        found.append((shapes(parts[0]), ht.verdicts(parts[0])))
    assert all(f == found[0] for f in found)


def test_optional_and_repeated():
    w = ht.of_page(ht.parse("<div class=a>x</div><p>1<p>2"))
    ht.aligned(w, ht.of_page(ht.parse("<p>1")))
    assert ht.expression(w) == "<html>(<div.a>#</div>)? (<p>#</p>)+</html>"
    ht.aligned(w, ht.of_page(ht.parse("<p>1<div class=a>x</div><p>2")))
    assert ht.expression(w) == "<html>((<div.a>#</div>)? (<p>#</p>)?)+</html>"


@pytest.mark.parametrize("text", ["<a x='", '<a x="', "<a ", "<!--", "<!", "</", "<script", "<p x=\"'", "&#", "<div><p>", "</div>", "<li>", "<a href=x>", "<h1>", "<td>"])
def test_time_in_proportion(text):
    """Half a megabyte of anything broken is read in seconds."""
    began = time.thread_time()
    for tail in ("", ">", '">'):
        ht.of_page(ht.parse(text * (300_000 // len(text)) + tail))
    assert time.thread_time() - began < 15
