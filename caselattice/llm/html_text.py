"""Main text of web pages by wrappers: for each host a union-free regular expression over its pages' elements is inferred.

A page is read as elements and text slots. A wrapper says which children an element has, in which order, which are optional, which are
repeated, and what its text slots hold on average. A page's own wrapper is the simplest one: where its children come again, the
span between becomes a repeated group. Two wrappers are aligned child by child: equal ones are aligned further down, one
that the other side hasn't got becomes optional, and two that come in the other order become a repeated group of what lies between. No
unions are needed. Sums and extremes of slots go along, so the order in which pages are taken makes no difference to them.

Every page takes part. Tasks align their pages host by host before anything is shuffled, wrappers of one host meet a few at a time
in rounds, and the pages then meet their host's verdicts: the slots that hold the article. A hot host is one small wrapper a
task.

The article is what semantic elements mark, or else the element that most of the host's running words lie in. Menus, headers, footers,
sidebars, notices, adverts, forms and comments are left out, by their elements, their names, and by being lists of links.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, met, written
from .quality_rules import pieces
from .url_filters import url_parts

#: Elements that a line of text doesn't run through, and among them those without an end.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
EMPTY = {"hr"}
#: Elements whose content is no markup, and elements that never hold the article.
RAW = set("script style textarea title noscript iframe noembed noframes template svg object canvas audio video".split())
NEVER = set("nav footer aside menu dialog select button head search option optgroup".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"meta", "link", "base", "title", "script", "style", "noscript", "template"}
#: An element of the key ends open ones of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
} | {h: (HEADINGS, BLOCKS - HEADINGS) for h in HEADINGS}
#: Words in classes and ids of what is not the article, of what is, and roles.
JUNK_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsors sponsored promo promos promotion promoted banner banners"
    " sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay"
    " comment comments commentlist commentary reply replies respond responses disqus discussion feedback"
    " share sharing social follow related recommended recommendations recirculation trending popular outbrain taboola"
    " newsletter subscribe subscription signup login signin register search searchbox form widget widgets pager pagination paging skip copyright".split()
)
MAIN_WORDS = set("article articlebody post entry story content".split())
JUNK_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
JUNK_HEADING = re.compile(
    r"(?i)(\d+\s+)?((reader |user |your )?comments?|leave a (comment|reply)|join the (discussion|conversation)|responses?|replies|kommentare?|leserkommentare|commentaires?|comentarios?"
    r"|related( (articles?|posts?|stories|links))?|you may also like|more from .{1,40}|advertisement|anzeige|publicité|publicidad|share this)(\s*\(\d+\))?\s*:?"
)
#: Levels of elements; what lies deeper belongs to the element at this level.
DEEPEST = 150
#: Tags without an end after which quotes in tags don't count any more.
MOST_BROKEN = 8

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): ``text`` between tags, ``open`` and ``close`` with the element's name. Comments and raw elements are passed over."""
    at, last, broken, n = 0, html.rfind(">"), 0, len(html)
    start = 0
    while True:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            break
        nxt = html[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if lt > start:
                yield "text", html[start:lt], ""
            if html.startswith("<!--", lt):
                end = lt + 5 if html.startswith("<!-->", lt) else html.find("-->", lt + 4) + 3
                if end == 2:  # it never ends
                    return
            else:
                end = html.find(">", lt) + 1
            at = start = end
            continue
        m = _TAG.match(html, lt) if broken < MOST_BROKEN else None
        if m is None:
            plain = _BARE.match(html, lt)
            broken += plain is not None
            m = plain
        if m is None:  # no tag
            at = lt + 1
            continue
        if lt > start:
            yield "text", html[start:lt], ""
        name = m[2].lower()
        at = start = m.end()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            end = _RAW_END[name].search(html, at) if not (m[3].endswith("/") and name in ("svg", "object")) else m
            at = start = end.end() if end else n
        else:
            yield "open", name, m[3]
    if start < n:
        yield "text", html[start:], ""


class Element:
    """name, mark (``!`` left out, ``^`` article, ``*`` main, ``~`` named like one, ``=`` header of an article), kids: elements and (text, words, words in links, links)."""

    __slots__ = ("name", "names", "label", "junk", "main", "kids", "article", "sig")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.kids, self.names, self.label = name, [], set(), ""
        self.junk, self.main, self.article = name in NEVER, "", False
        role = ""
        if attributes and not attributes.isspace():
            for key, *values in _ATTR.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key in ("class", "id"):
                    self.names |= {w.lower() for w in _NAME.findall(value)}
                    if not self.label:
                        self.label = re.sub(r"[^a-z_-]", "", value.split()[0].lower()) if value.split() and not re.search(r"\d[a-zA-Z]", value.split()[0]) else ""
                elif key == "role":
                    role = value.lower()
                elif key == "itemprop" and value.lower() == "articlebody":
                    self.main = "^"
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.junk = True
        if role in JUNK_ROLES:
            self.junk = True
        if name == "article" or role == "article":
            self.main = "^"
        elif name == "main" or role == "main":
            self.main = "*"
        elif not self.main and self.names & MAIN_WORDS and name in ("div", "section", "td"):
            self.main = "~"

    def settle(self, in_article: bool) -> None:
        """Set sig, once the children are known. in_article: whether an article is around."""
        named = bool(self.names & JUNK_WORDS) and self.name not in ("html", "body", "main")
        holds = any(isinstance(k, Element) and k.article for k in self.kids)
        first = next((k for k in self.kids if isinstance(k, Element)), None)
        if first is not None and first.name in HEADINGS - {"h1"} and self.name not in ("html", "body", "main", "article") and len(first.kids) == 1:
            text = first.kids[0]
            named |= isinstance(text, tuple) and bool(JUNK_HEADING.fullmatch(text[0]))
        mark = self.main
        if self.junk or ((named or self.name == "form") and not holds):
            mark = "!"
        if self.name == "header" or "header" in self.names and mark == "!" and not self.junk:
            mark = "=" if in_article else "!"
        self.article = mark != "!" and (holds or self.main in ("^", "*") or self.name == "h1" and not in_article)
        shape = ""
        if not self.label and self.name in ("div", "section", "td"):
            shape = "/" + next(("#" if isinstance(k, tuple) else k.name for k in self.kids), "")
        self.sig = f"{self.name}{'.' + self.label if self.label else ''}{shape}{mark}"


def parse(html: str) -> Element:
    """The page's elements. Missing and crossed end tags are mended as HTML says; inline elements are part of their block's text."""
    root = Element("html")
    stack, over = [root], {}
    said: list[str] = []
    words = links = n_links = 0
    in_link = False

    def flush() -> None:
        nonlocal words, links, n_links, in_link
        if said:
            text = " ".join("".join(said).split())
            if text:
                stack[-1].kids.append((text, text.count(" ") + 1, links, n_links))
            said.clear()
        links = n_links = 0
        in_link = False

    def pop(to: int) -> None:
        flush()
        while len(stack) > to:
            done = stack.pop()
            done.settle(any(e.main == "^" for e in stack))

    for kind, value, attributes in tokens(html):
        if kind == "text":
            if "&" in value:
                value = entities.unescape(value)
            if len(stack) > 1 and stack[-1].name == "head" and value.strip():
                pop(len(stack) - 1)
            said.append(value)
            if in_link:
                links += len(value.split())
        elif kind == "open":
            if stack[-1].name == "head" and value not in IN_HEAD and value not in ("head", "html"):
                pop(len(stack) - 1)
            if value not in BLOCKS:
                if value == "a":
                    in_link, n_links = True, n_links + 1
                elif value in ("br", "img", "wbr"):
                    said.append(" " if value != "wbr" else "")
                continue
            if value == "html" or value == "body" and len(stack) > 1:
                flush()
                continue
            flush()
            if stack[-1].name == "p":
                pop(len(stack) - 1)
            if value in ENDS:
                ended, bound = ENDS[value]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in ended:
                        pop(i)
                        break
                    if stack[i].name in bound:
                        break
            if value in EMPTY:
                continue
            if len(stack) >= DEEPEST:
                over[value] = over.get(value, 0) + 1
                continue
            new = Element(value, attributes)
            stack[-1].kids.append(new)
            stack.append(new)
        elif value in BLOCKS:
            flush()
            if value in ("html", "body"):
                continue
            if over.get(value):
                over[value] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == value:
                    pop(i)
                    break
        elif value == "a":
            in_link = False
    pop(0)
    return root


class Wrapper:
    """items and n: how often it occurs, and in how many of its parent's occurrences. words, links (words in links), n_links, low, high: its text's, if a slot.

    order: children's signatures as segments [repeated, [signatures]]; a segment of several is a group whose members come in any order.
    """

    __slots__ = ("items", "n", "words", "links", "n_links", "low", "high", "order", "kids")

    def __init__(self, items=0, n=0, words=0, links=0, n_links=0, low=None, high=None, order=None, kids=None):
        self.items, self.n, self.words, self.links, self.n_links, self.low, self.high = items, n, words, links, n_links, low, high
        self.order, self.kids = order or [], kids or {}

    def packed(self) -> list:
        return [self.items, self.n, self.words, self.links, self.n_links, self.low, self.high, self.order, {s: k.packed() for s, k in self.kids.items()}]

    @classmethod
    def unpacked(cls, x: list) -> Wrapper:
        return cls(*x[:8], {s: cls.unpacked(k) for s, k in x[8].items()})


SLOT = "#"


def of_page(e: Element) -> Wrapper:
    """The wrapper of one element's occurrence."""
    w, order, at = Wrapper(1, 1), [], {}
    for kid in e.kids:
        if isinstance(kid, tuple):
            h = zlib.crc32(kid[0].encode("utf-8", "surrogatepass"))
            sig, own = SLOT, Wrapper(1, 1, kid[1], kid[2], kid[3], h, h)
        else:
            sig, own = kid.sig, of_page(kid)
        if sig in w.kids:
            aligned(w.kids[sig], own)
            w.kids[sig].n = 1
            k = at[sig]
            if k < len(order) - 1:  # it comes again after others: what lies between is a repeated group
                for segment in order[k + 1:]:
                    order[k][1] += segment[1]
                    for s in segment[1]:
                        at[s] = k
                del order[k + 1:]
            order[k][0] = True
        else:
            w.kids[sig] = own
            at[sig] = len(order)
            order.append([False, [sig]])
    w.order = order
    return w


def aligned_order(a: list, b: list) -> list:
    """Two sequences of segments as one that both fit: equal members meet, members of one side are optional, crossing ones form a group."""
    at_a, at_b = {s: i for i, g in enumerate(a) for s in g[1]}, {s: i for i, g in enumerate(b) for s in g[1]}
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and not any(at_b.get(s, -1) >= j for s in a[i][1]):
            out.append(a[i])
            i += 1
            continue
        if j < len(b) and not any(at_a.get(s, -1) >= i for s in b[j][1]):
            out.append(b[j])
            j += 1
            continue
        # both have a partner on the other side: take all up to where the spans close
        to_a, to_b = i + 1, j + 1
        while True:
            far_b = max([to_b, *(at_b[s] + 1 for g in a[i:to_a] for s in g[1] if s in at_b)])
            far_a = max([to_a, *(at_a[s] + 1 for g in b[j:far_b] for s in g[1] if s in at_a)])
            if (far_a, far_b) == (to_a, to_b):
                break
            to_a, to_b = far_a, far_b
        members = list(dict.fromkeys([s for g in a[i:to_a] for s in g[1]] + [s for g in b[j:to_b] for s in g[1]]))
        simple = to_a == i + 1 and to_b == j + 1 and len(members) == 1
        out.append([a[i][0] or b[j][0] if simple else True, members])
        i, j = to_a, to_b
    return out


def aligned(a: Wrapper, b: Wrapper) -> Wrapper:
    """a, after it was aligned with b."""
    a.items, a.n, a.words, a.links, a.n_links = a.items + b.items, a.n + b.n, a.words + b.words, a.links + b.links, a.n_links + b.n_links
    if b.low is not None:
        a.low, a.high = (b.low, b.high) if a.low is None else (min(a.low, b.low), max(a.high, b.high))
    if a.order != b.order:
        a.order = aligned_order(a.order, b.order)
    for sig, kid in b.kids.items():
        if sig in a.kids:
            aligned(a.kids[sig], kid)
        else:
            a.kids[sig] = kid
    return a


def expression(w: Wrapper, sig: str = "html") -> str:
    """The wrapper as a regular expression: ``#`` text, ``(...)+`` repeated, ``(...)?`` optional."""
    if sig == SLOT:
        return SLOT
    inner = []
    for repeated, members in w.order:
        group = len(members) > 1
        shown = []
        for s in members:
            kid = expression(w.kids[s], s)
            shown.append(f"({kid})?" if w.kids[s].n < w.items or group else kid)
        inner.append(f"({' '.join(shown)})+" if repeated else " ".join(shown))
    return f"<{sig}>{' '.join(inner)}</{re.match('[a-z0-9]+', sig)[0]}>"


def verdicts(root: Wrapper) -> dict[str, int]:
    """For the paths of slots: 1 for the article's, 2 for others that may stand in on pages without any of these. Slots left out aren't there."""
    slots: list[tuple[tuple, Wrapper]] = []

    def walk(path: tuple, w: Wrapper) -> int:
        """Running words below, outside of what is left out and of lists of links."""
        sums[path] = 0
        for sig, kid in w.kids.items():
            here = (*path, sig)
            if sig == SLOT:
                slots.append((here, kid))
                sums[path] += kid.words - kid.links
            elif not sig.endswith("!"):
                if sig.endswith("="):
                    headings(here, kid)
                elif not linked(sig, kid):
                    sums[path] += walk(here, kid)
        return sums[path]

    def headings(path: tuple, w: Wrapper) -> None:
        for sig, kid in w.kids.items():
            if sig == SLOT and path[-1][:2] in HEADINGS:
                slots.append(((*path, sig), kid))
            elif sig != SLOT and not sig.endswith("!"):
                headings((*path, sig), kid)

    def linked(sig: str, w: Wrapper) -> bool:
        """Whether an element is a list of links, over all its occurrences."""
        if not re.match(r"(ul|ol|dl|div|section|table|td|p)\b", sig):
            return False
        words, links, n_links = total(w)
        return words > 0 and links >= 0.8 * words and n_links >= 2 * w.items

    def total(w: Wrapper) -> tuple[int, int, int]:
        out = [w.words, w.links, w.n_links]
        for kid in w.kids.values():
            out = [x + y for x, y in zip(out, total(kid))]
        return tuple(out)

    sums: dict[tuple, int] = {}
    every = walk((), root)

    def outermost(mark: str) -> list[tuple]:
        marked = [p for p in sums if p and p[-1].endswith(mark)]
        return [p for p in marked if not any(p[:k] in marked for k in range(1, len(p)))]

    chosen: list[tuple] = []
    for mark, least in (("^", 0.3), ("*", 0.3), ("~", 0.5)):
        found = outermost(mark)
        if found and sum(sums[p] for p in found) >= least * every:
            chosen = found
            break
    marked = bool(chosen)
    if not chosen:  # down to where the words part
        here: tuple = ()
        while True:
            kids = [p for p in sums if len(p) == len(here) + 1 and p[:-1] == here and re.match(r"(html|body|div|section|table|tbody|tr|td|center|form|details|fieldset)\b", p[-1])]
            best = max(kids, key=lambda p: (sums[p], p), default=None)
            if best is None or sums[best] < 0.6 * sums[here] or not sums[best]:
                break
            here = best
        chosen = [here]
    inside = lambda path: any(path[:len(p)] == p for p in chosen)
    titled = any(inside(p) and p[-2].startswith("h1") for p, _ in slots if len(p) > 1)
    varied = any(inside(p) and w.low != w.high for p, w in slots)
    out = {}
    for path, w in slots:
        main = inside(path)
        loose = len(path) > 1 and not re.match(r"(p|h[1-6]|li|td|blockquote|pre|dd|dt)\b", path[-2])
        if main and loose and not marked and varied and w.low == w.high and w.items >= 3 and w.words < 30 * w.items:
            continue  # the host's own words
        if not main and not titled and len(path) > 1 and path[-2].startswith("h1") and any(s.endswith("*") for s in path):
            main = True
        out["/".join(path)] = 1 if main else 2
    return out


def extracted(root: Element, kept: dict[str, int]) -> str:
    """The blocks of the kept slots of a page, one a line."""
    found: dict[int, list[str]] = {1: [], 2: []}

    def walk(path: str, e: Element) -> None:
        for kid in e.kids:
            if isinstance(kid, tuple):
                tier = kept.get(path + SLOT)
                if tier:
                    found[tier].append(kid[0])
            else:
                walk(f"{path}{kid.sig}/", kid)

    walk("", root)
    return "\n".join(found[1] or found[2])


#: Hosts, and elements of their wrappers, that a task holds before it hands them on; wrappers of a host that meet in one task.
MOST_HOSTS, MOST_ELEMENTS, FAN_IN = 512, 100_000, 32


def wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of all pages: host not null, null html is an empty page. The wrapper is JSON, see expression() and verdicts().

    A wrapper grows with the distinct names of elements and first classes of its host, not with its pages.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = sorted(held.items())
            return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in rows], pa.string()), "wrapper": pa.array([json.dumps(w.packed()) for _, w in rows], pa.string())})

        for whole in batches:
            for b in pieces(whole, "html"):
                for host, html in zip(b["host"].to_pylist(), b["html"].to_pylist()):
                    own = of_page(parse(html or ""))
                    if host in held:
                        aligned(held[host], own)
                    else:
                        held[host] = own
                    size += 1
                if len(held) > MOST_HOSTS or size > MOST_ELEMENTS:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [Wrapper.unpacked(json.loads(x)) for x in sorted(rows["wrapper"])]
        for part in parts[1:]:
            aligned(parts[0], part)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(parts[0].packed())]})

    here = written(pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(fold, "host string, wrapper string"), "wrappers")
    most = here.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        parts = -(-most // FAN_IN)
        dealt = here.withColumn("part", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(parts)))
        here = written(dealt.groupBy("host", "part").applyInPandas(meet, "host string, wrapper string"), "wrappers")
        most = parts if parts > 1 else 1
    return here


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the html, with text (empty if none) and n_chars (its code points).

    Null urls and those without :// share the host "". Null and empty html give an empty text; html of any length is
    read whole, each page longer than 2 MB by itself. Repeated rows are each a page. An empty table gives an empty result. Columns named
    like the added ones are replaced.
    """
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    host, verdict = (next(n for n in (f"{name}{'_' * k}" for k in range(len(rest) + 1)) if n not in (*rest, html_col)) for name in ("host", "verdict"))
    rows = pages.select(*rest, html_col, url_parts(F.col(url_col))[0].alias(host))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "verdict": [json.dumps(verdicts(Wrapper.unpacked(json.loads(x)))) for x in b["wrapper"]]})

    found = written(wrappers(rows, host, html_col).mapInPandas(judge, "host string, verdict string"), "verdicts")
    both = met(rows, found.select(F.col("host").alias(host), F.col("verdict").alias(verdict)), host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for whole in batches:
            for b in pieces(whole, html_col):
                texts = []
                for html, said in zip(b[html_col].to_pylist(), b[verdict].to_pylist()):
                    if said not in known:
                        if len(known) >= MOST_HOSTS:
                            known.clear()
                        known[said] = json.loads(said)
                    texts.append(extracted(parse(html or ""), known[said]).encode("utf-8", "replace").decode())
                yield pa.RecordBatch.from_arrays([*[b[c] for c in rest], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    schema = rows.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return both.mapInArrow(run, schema)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(documents(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op13_html_text": op13_html_text}
ORACLE: dict[str, str] = {}
