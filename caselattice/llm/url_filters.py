"""URL filters: host rules first, then a path-template tree learned per host.

The tree grows one path segment at a time, to the last, over the distinct paths with the sums of their pages. Below each
node (host, template so far) a segment stays literal where it is common among the node's pages, has many labelled pages,
or has labels that differ from the node's; all others are variable and become one wildcard. Literal siblings whose labelled
shares of bad pages don't differ significantly are merged into one branch. Each leaf template is then judged by its
labelled purity, smoothed towards the corpus: a template whose smoothed share of good pages is too low is rejected. Pages
meet their path's template once, at the end.

In a template ``*`` is a wildcard, ``a|b`` a merged branch and ``a|+9`` one of ten segments; these characters in a path's own
segments have a backslash before them, so no literal looks like a wildcard or a branch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, WORD, documents, dropped, met, written

#: (host suffix, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


#: A branch of more segments is named by its first one and the number of the others.
MOST_NAMED = 100


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. A null url, or one without ://, has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null where none fits. rules: a configured list, bound into the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for suffix, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _apart(bad: Column, labelled: Column, other_bad: Column, other_labelled: Column) -> Column:
    """By how many deviations the first share of bad pages lies over the second, each smoothed by one page."""
    pooled = (bad + other_bad + 1) / (labelled + other_labelled + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / (labelled + 1) + 1 / (other_labelled + 1)))
    return ((bad + 0.5) / (labelled + 1) - (other_bad + 0.5) / (other_labelled + 1)) / spread


def _literals(level: DataFrame, min_share: float, min_count: int, support: int, z: float, min_labelled: int) -> DataFrame:
    """level's rows that stay literal, with ``known`` (enough labels to be compared).

    Of segments with min_count pages those stay that have min_share of their node's, and of the known ones also those
    with ``support`` pages or with a share of bad pages that differs from the rest of the node by z deviations.
    """
    known = F.col("labelled") >= min_labelled
    total = level.groupBy("host", "template").agg(F.sum("n").alias("total"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    differs = F.abs(_apart(F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled"))) > z
    stays = (F.col("n") >= min_share * F.col("total")) | (known & ((F.col("n") >= support) | differs))
    found = level.where((F.col("n") >= min_count) & (F.col("seg") != "")).join(total, ["host", "template"]).where(stays)
    return found.withColumn("known", known).drop("total", "all_labelled", "all_bad")


def _branches(literals: DataFrame, z: float) -> DataFrame:
    """(host, template, seg, branch) for literal segments. Siblings that aren't known are like none: each is a branch of its own.

    Known siblings are taken in order of their share of bad pages. One opens a new branch if it differs by z deviations
    from all that the open branch holds so far, or from its first sibling. Equal counts share a branch, so a node's fold
    goes over its distinct counts only; it keeps the first counts of each branch.
    """
    known = literals.where("known").withColumn("key", F.struct(((F.col("bad") + 0.5) / (F.col("labelled") + 1)).alias("p"), "labelled", "bad"))
    classes = known.groupBy("host", "template", "key").agg(F.count("*").alias("times"))
    ordered = classes.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("key", "times"))).alias("classes"))

    def put(open_: Column, c: Column) -> Column:
        key, first = c["key"], F.element_at(open_["firsts"], -1)
        opens = (_apart(key["bad"], key["labelled"], open_["bad"], open_["labelled"]) > z) | (_apart(key["bad"], key["labelled"], first["bad"], first["labelled"]) > z)
        bad, labelled = key["bad"] * c["times"], key["labelled"] * c["times"]
        return F.when(opens, F.struct(F.concat(open_["firsts"], F.array(key)).alias("firsts"), bad.alias("bad"), labelled.alias("labelled"))).otherwise(
            F.struct(open_["firsts"].alias("firsts"), (open_["bad"] + bad).alias("bad"), (open_["labelled"] + labelled).alias("labelled"))
        )

    first = F.get("classes", F.lit(0))
    start = F.struct(F.array(first["key"]).alias("firsts"), (first["key"]["bad"] * first["times"]).alias("bad"), (first["key"]["labelled"] * first["times"]).alias("labelled"))
    others = F.slice("classes", F.lit(2), F.size("classes"))
    firsts = ordered.select("host", "template", F.aggregate(others, start, put)["firsts"].alias("firsts"))
    grouped = known.join(firsts, ["host", "template"]).withColumn("g", F.size(F.filter("firsts", lambda f: f <= F.col("key"))))
    alone = literals.where(~F.col("known")).select("host", "template", "seg", F.col("seg").alias("branch"))
    return _named(grouped).unionByName(alone)


def _named(grouped: DataFrame) -> DataFrame:
    """grouped (host, template, g, seg) with ``branch``: the segments of a g, or the first and the number of others if there are many.

    A g may hold any number of segments, so only its first MOST_NAMED come together: the smallest by a bounded aggregate.
    """
    group = ["host", "template", "g"]
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("seg"))  # a group limit: each task sends MOST_NAMED of a g on
    firsts = grouped.select(*group, "seg").withColumn("nth", nth).where(F.col("nth") <= MOST_NAMED).groupBy(*group).agg(F.array_sort(F.collect_list("seg")).alias("segs"))
    names = grouped.groupBy(*group).agg(F.count("*").alias("of")).join(firsts, group)
    branch = F.when(F.col("of") <= MOST_NAMED, F.array_join("segs", "|")).otherwise(F.concat(F.get("segs", F.lit(0)), F.lit("|+"), F.col("of") - 1))
    return grouped.join(names.select(*group, branch.alias("branch")), group).select("host", "template", "seg", "branch")


def _plain(path: Column) -> Column:
    """A path whose own backslashes, stars, bars and pluses are told from those of templates."""
    return F.regexp_replace(path, r"([\\*|+])", r"\\$1")


def templates(
    paths: DataFrame, min_share: float = 0.01, min_count: int = 20, z: float = 3.0, support: int = 1000, min_labelled: int = 10
) -> DataFrame:
    """(host, path, template, n, labelled, bad) of every path. paths: (host, path, n, labelled, bad), each path of a host once, with the sums of its pages.

    Below nodes of fewer than min_count pages all segments are wildcards, so their paths are finished at once, whatever their
    depth; the others go on, level by level, to their last segment. Hosts may be hot: nodes are summed before they are
    shuffled, and paths meet the nodes and branches that go on by a broadcast of counted size, or a merge whose large keys
    Spark splits. Empty segments stay empty; an empty path is the template "". Null counts aren't allowed.
    """
    cols = ["host", "path", "template", "n", "labelled", "bad"]
    here = paths.withColumns({"segs": F.split(_plain(F.col("path")), "/", -1), "template": F.lit("")})
    here, done, d = written(here, "paths"), [], 0
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    star = lambda s: F.when(s == "", F.lit("/")).otherwise(F.lit("/*"))
    while True:
        d += 1
        seg = F.get("segs", F.lit(d))
        done.append(here.where("segs is null" if d > 1 else seg.isNull()).select(*cols))
        open_ = here.where(seg.isNotNull()).withColumn("seg", seg)
        level = written(open_.groupBy("host", "template", "seg").agg(*sums), "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)
        large = level.groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("host", "template")
        large = written(large.withColumn("large", F.lit(True)), "nodes")
        inside = met(level, large.drop("large"), ["host", "template"])
        branches = written(_branches(_literals(inside, min_share, min_count, support, z, min_labelled), z), "branches")
        joined = met(met(open_, large, ["host", "template"], "left"), branches, ["host", "template", "seg"], "left")
        rest = F.array_join(F.transform(F.slice("segs", F.lit(d + 1), F.size("segs")), star), "")
        deeper = F.when(F.col("branch").isNotNull(), F.concat(F.lit("/"), F.col("branch"))).otherwise(star(F.col("seg")))
        template = F.concat("template", F.when(F.col("large"), deeper).otherwise(rest))
        # without segments: finished, at its end or below a small node
        segs = F.when(F.col("large") & (F.size("segs") > d + 1), F.col("segs"))
        here = written(joined.select("host", "path", template.alias("template"), "n", "labelled", "bad", segs.alias("segs")), "paths")
        dropped(level, large, branches)


def judged(pages: DataFrame, threshold: float = 0.5, weight: float = 10.0, **tree) -> DataFrame:
    """pages (host, path, labelled 0/1, bad 0/1 and others) with ``template``, ``purity`` (smoothed share of good among labelled pages of the
    template) and ``method`` (allow or block).

    pages should be a written table: it is read for the paths' sums and for the join. Repeated rows count each. Very long paths
    are taken whole. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    pages = pages.drop("template", "purity", "method")
    sums = pages.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    found = written(templates(sums, **tree), "templates")
    per = found.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"))
    all_ = found.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()
    prior = 1 - (all_["b"] or 0) / all_["n"] if all_["n"] else 1.0
    purity = (F.col("t_labelled") - F.col("t_bad") + weight * prior) / (F.col("t_labelled") + weight)
    per = written(per.select("host", "template", purity.alias("purity"), F.when(purity < threshold, "block").otherwise("allow").alias("method")), "judged")
    tree_of = met(found.select("host", "path", "template"), per, ["host", "template"])
    return pages.join(tree_of.hint("merge"), ["host", "path"])


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, **settings) -> DataFrame:
    """pages (id, url, bad 0/1 or null) as (id, host, path, rule, verdict, template, purity)."""
    host, path = url_parts(F.col("url"))
    base = pages.select("id", host.alias("host"), path.alias("path"), F.col("bad").isNotNull().cast("long").alias("labelled"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    out = judged(written(base, "pages"), **settings).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    return out.select("id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", "method").alias("verdict"), "template", "purity")


def url_filter(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", **settings
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every page.

    labels: (id, bad 0/1), at most a few rows an id; ids that no page has are ignored, and several labels of one id
    count as bad if any is. Null and malformed urls have an empty host and path and share one template. Null ids have
    no label. Repeated rows are judged alike and each returned. An empty table gives an empty result.
    """
    marks = labels.toDF("id", "bad").where(F.col("id").isNotNull() & F.col("bad").isNotNull()).groupBy("id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).join(marks, "id", "left")
    return filtered(base, rules, **settings).withColumnRenamed("id", id_col)


#: What the commonest character references stand for.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def body_text(html: Column) -> Column:
    """The words of a page's article, or of its body if it has none, without title, scripts, styles, comments and tags, one space between them."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<h1\b.*?</h1\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<head\b.*?</head\s*>", " ")
    inside = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*)", 1)
    inside = F.regexp_replace(F.when(inside == "", bare).otherwise(inside), r"(?is)</article\s*>.*|<[^>]*>", " ")
    for said, meant in REFERENCES.items():
        inside = F.replace(inside, F.lit(said), F.lit(meant))
    return spaced(inside)


def spaced(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D\u00A0]+", " "), F.lit(" "))


def content_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (id, url, html) as (id, url, bad): what is known of a page by its text, never by its url.

    A page is bad if people labelled a document of the same words as toxic or of quality 0, or if its text has under 50 words or more
    than 3 symbols in 10 words; it is good if they labelled it otherwise; else there is no label. docs: (doc_id, text),
    labels: (doc_id, quality, toxic). Of several labels of one text a bad one counts. Null html gives no label; empty or endless
    html is judged like any other. Copies of a text meet as one hash, before the join. Repeated rows give a row each.
    """
    key = lambda text: F.unhex(F.sha2(text, 256))
    marks = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("known")).where("known is not null")
    keyed = docs.select("doc_id", key(spaced(F.col("text"))).alias("key"))  # hashes travel to the labels, not texts
    known = keyed.join(marks, "doc_id").groupBy("key").agg(F.max("known").alias("known"))
    # words and symbols are counted on what is left of the whole page, in one pass with the key
    text = body_text(F.col("html"))
    words, symbols = F.regexp_count("text", F.lit(WORD)), F.regexp_count("text", F.lit(r"[#*$%&|]"))
    read = written(pages.select("id", "url", text.alias("text")).select("id", "url", key(F.col("text")).alias("key"), ((words < 50) | (10 * symbols > 3 * words)).alias("poor")), "read")
    out = met(read, written(known, "known"), "key", "left")
    return out.select("id", "url", F.when(F.col("poor"), 1).otherwise(F.col("known")).alias("bad"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, labelled by their texts."""
    pages, docs, labels = (documents(spark, sf_dir, name) for name in ("pages", "documents", "labels"))
    marked = content_labels(pages.select(F.col("page_id").alias("id"), "url", "html"), docs, labels)
    return filtered(marked).withColumnRenamed("id", "page_id")


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLE: dict[str, str] = {}
