"""Evidence of single sections of hot hosts."""

from caselattice.llm import url_filters


def judged(spark, rows):
    """rows (url, bad or None): (template, verdict) by url."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows) if b is not None], "id long, bad int")
    return {r.url: (r.template, r.verdict) for r in url_filters.url_filter(pages, labels, rules=[]).join(pages, "page_id").collect()}


def test_rare_bad_section_of_a_large_node(spark):
    rows = [(f"http://h.com/main/{i}", 0 if i % 3 else None) for i in range(5000)] + [(f"http://h.com/s{i}/1", 0 if i % 2 else None) for i in range(960)]
    got = judged(spark, rows + [(f"http://h.com/evil/{i}", 1 if i < 30 else None) for i in range(40)])
    assert all(got[f"http://h.com/evil/{i}"] == ("/evil/*", "block") for i in range(40))
    assert got["http://h.com/s1/1"] == ("/*/1", "allow") and got["http://h.com/main/1"] == ("/main/*", "allow")


def test_many_equal_sections(spark):
    got = judged(spark, [(f"http://h.com/s{s}/{i}", s % 2) for s in range(240) for i in range(25)])
    assert all(v == ("block" if int(u.split("/s")[1].split("/")[0]) % 2 else "allow") for u, (_, v) in got.items())
    assert {t.split("/")[1] for t, _ in got.values()} == {"s0|+119", "s1|+119"}


def test_deep_section(spark):
    deep = "http://h.com/" + "/".join("abcdefghij")
    got = judged(spark, [(f"{deep}/{s}/{i}", int(s == "evil")) for s in ("evil", "fine") for i in range(40)])
    assert all(v == ("block" if "/evil/" in u else "allow") for u, (_, v) in got.items())
    assert got[f"{deep}/evil/1"][0] == "/a/b/c/d/e/f/g/h/i/j/evil/*"


def test_small_steps_do_not_chain(spark):
    got = judged(spark, [(f"http://h.com/s{s}/{i}/x", int(i < 5 * s)) for s in range(10) for i in range(50)])
    by = {int(u.split("/s")[1].split("/")[0]): t.split("/")[1] for u, (t, _) in got.items()}
    assert all(v == "block" for u, (_, v) in got.items() if "/s9/" in u or "/s8/" in u) and all(v == "allow" for u, (_, v) in got.items() if "/s0/" in u)
    # by hand: each sibling against the pooled branch and against its first
    branches, z = [], lambda a, n, b, m: ((a + .5) / (n + 1) - (b + .5) / (m + 1)) / ((q := (a + b + 1) / (n + m + 2)) * (1 - q) * (1 / (n + 1) + 1 / (m + 1))) ** .5
    for s in range(10):
        if not branches or z(5 * s, 50, sum(5 * x for x in branches[-1]), 50 * len(branches[-1])) > 3 or z(5 * s, 50, 5 * branches[-1][0], 50) > 3:
            branches.append([])
        branches[-1].append(s)
    assert len(branches) > 2 and by == {s: "|".join(f"s{x}" for x in b) for b in branches for s in b}
