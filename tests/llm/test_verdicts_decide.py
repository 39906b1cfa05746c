"""Verdicts of hosts, templates and pairs against brute force: each decides something."""

import random
import re
from collections import Counter, defaultdict
from statistics import NormalDist

from caselattice.llm import chat_format, quality_rules, url_filters


def brute_hosts(rows, measure):
    """rows (host, text): host -> (rates, strict rules, rejected), by the rules of the operator written out."""
    fails = {
        "few_words": lambda m: m["n_words"] < 50, "repeats": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], "same_lines": lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"],
    }
    by = defaultdict(list)
    for h, t in rows:
        by[h].append(measure(t))
    out = {h: ({}, set(), False) for h in by}
    for rule, f in fails.items():
        k = {h: sum(map(f, ms)) for h, ms in by.items()}
        n, hosts, x = len(rows), len(by), sum(k.values())
        p = x / n
        found = sum(len(by[h]) * (k[h] / len(by[h]) - p) ** 2 for h in by)
        chance = (hosts - 1) * p * (1 - p)
        alike = (found - chance) / (p * (1 - p) * (n - sum(len(ms) ** 2 for ms in by.values()) / n - hosts + 1)) if 0 < p < 1 else 0
        bar = NormalDist().inv_cdf(1 - 0.05 / (4 * hosts))
        for h, ms in by.items():
            rates_, strict, gone = out[h]
            if alike <= 0:
                rate, sd = p, (p * (1 - p) / (n + 1)) ** 0.5
            else:
                weight = max(1 / alike - 1, 0)
                a, b = weight * p + k[h] + 0.5, weight * (1 - p) + len(ms) - k[h] + 0.5
                rate, sd = a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
                if rate - bar * sd > p:
                    strict.add(rule)
            rates_[rule] = rate
            out[h] = rates_, strict, gone or rate - bar * sd > 0.5
    return out, fails


def measured(text):
    import pyarrow as pa

    return {k: int(v[0]) for k, v in quality_rules.measured(pa.array([text], pa.string())).items()}


def test_hosts_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    clean = lambda n=60: " ".join(word() for _ in range(n))
    loud = lambda: " ".join(word() + "#$" for _ in range(60))
    same = lambda: "\n".join([clean(6)] * 3 + [clean(20) for _ in range(4)])
    rows = []
    for h in range(12):
        for _ in range(60 if h in (3, 4) else rng.randint(1, 60)):
            share = 0.8 if h in (3, 4) else 0.05
            rows.append((f"https://H{h}.example.com/p?q", rng.choice([loud, same])() if rng.random() < share else "short" if rng.random() < 0.05 else clean()))
    rows += [("junk", "short")] * 40 + [("junk", clean())] * 2 + [(None, clean())] * 3 + [("once", "short")]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    host = lambda h: re.sub(r"^.*?://([^/]*).*", r"\1", h).lower() if h and "://" in h else h
    want, fails = brute_hosts([(host(h), t) for h, t in rows], measured)
    got = {r.host: r for r in quality_rules.host_verdicts(quality_rules.with_measures(docs)).collect()}
    assert set(got) == set(want)
    for h, (rates, strict, gone) in want.items():
        assert all(abs(got[h][f"{r}_rate"] - p) < 1e-9 for r, p in rates.items())
        assert {r for r in rates if got[h][f"{r}_strict"]} == strict and got[h].host_rejected == gone
    assert want["junk"][2] and not want["once"][2] and "symbols" in want["h3.example.com"][1] | want["h4.example.com"][1]
    kept = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, (h, t) in enumerate(rows):
        m = measured(t)
        _, strict, gone = want[host(h)]
        failed = any(fails[r](m) for r in strict)
        assert kept[i].host_failed == failed and kept[i].host_rejected == gone
        assert kept[i].kept == (not (fails["few_words"](m) or fails["repeats"](m)) and not gone and not failed)
    assert any(r.host_failed and not r.base_failed for r in kept.values()) and any(not r.kept and not r.base_failed and not r.host_failed for r in kept.values())


def test_hosts_that_do_not_differ_lose_nothing(spark):
    """Twenty hosts with one failure rate: chance alone holds none to a rule; a planted one among them is."""
    rng = random.Random(11)
    clean = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    loud = lambda: " ".join(f"w{rng.randrange(10**6)}#$" for _ in range(60))
    rows = [(f"h{h}", loud() if rng.random() < 0.1 else clean()) for h in range(20) for _ in range(100)]
    make = lambda rows: spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality_rules.quality_rules(make(rows)).collect())
    planted = rows + [("bad", loud() if i % 2 else clean()) for i in range(100)]
    gone = [r for r in quality_rules.quality_rules(make(planted)).collect() if not r.kept]
    assert len(gone) == 50 and all(r.source == "bad" and r.host_rules == ["symbols"] for r in gone)


def test_content_labels_and_query(spark, tmp_path):
    """Labels come from the pages' texts alone, and on hosts without telling names they decide."""
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    page = lambda t: f"<html><head><title>t</title></head><style>p{{}}</style><body><nav>menu</nav><article><h1>Title</h1><p>{t.replace('word', '<b>word', 1)}</p>\n<!-- $$$ --></article><footer>f</footer></body></html>"
    noisy = "<p>" + " ".join("a|$" for _ in range(60)) + "</p>"
    script = "<script>" + "x " * 100 + "</script><p>few</p>"
    pages = [(i, f"http://site.example.io/news/{i}", page(text(i))) for i in range(90)] + [(100 + i, f"http://site.example.io/junk/{i}", [noisy, script, ""][i % 3]) for i in range(30)]
    pages += [(300 + i, f"http://plain.example.io/a/{i}", page(text(300 + i))) for i in range(40)]  # toxic or poor by people's labels
    pages += [(200, "http://casino-x.example.io/1", page(text(200))), (202, None, None), (203, "http://n.example.net/", None), (None, "http://site.example.io/junk/77", noisy)]
    docs = [(i, text(i).replace(" ", "\n  ", 3)) for i in (*range(90), *range(300, 340), 200)] + [(999, None), (998, text(300))]
    labels = [(i, 1, 0) for i in range(90)] + [(i, int(i % 4 == 3), int(i % 4 != 3 and i % 8 > 3)) for i in range(300, 340)] + [(301, 0, None), (998, 1, 0), (999, 0, 0), (200, None, None), (None, 0, 1)]
    for name, rows, schema in (("pages", pages, "page_id long, url string, html string"), ("documents", docs, "doc_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    read = {n: spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("pages", "documents", "labels")}
    marks = {r.id: r.bad for r in url_filters.content_labels(read["pages"].withColumnRenamed("page_id", "id"), read["documents"], read["labels"]).collect()}
    assert all(marks[i] == 0 for i in range(90)) and all(marks[100 + i] == 1 for i in range(30)) and marks[200] is None and marks[202] is None
    assert all(marks[300 + i] == int(i % 4 != 3) for i in range(40))
    got = {r.page_id: r for r in url_filters.op9_url_filters(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(got[i].verdict == "allow" for i in range(90)) and all(got[100 + i].verdict == "block" for i in range(30))
    assert all(got[300 + i].verdict == "block" for i in range(40)) and got[200].verdict == "allow"
    assert got[None].verdict == "block" and got[203].rule == "net/" and got[202].host == ""


def brute_templates(rows, min_share=0.01, min_count=20, z=3.0, support=1000, min_labelled=10):
    """rows (path, bad or None) of one host: path -> template, the rules written out over plain lists."""
    plain = lambda s: re.sub(r"([\\\\*|+])", r"\\\1", s)
    apart = lambda a, n, b, m: ((a + 0.5) / (n + 1) - (b + 0.5) / (m + 1)) / ((q := (a + b + 1) / (n + m + 2)) * (1 - q) * (1 / (n + 1) + 1 / (m + 1))) ** 0.5
    out = {}

    def grow(members, depth, template):
        rest = []
        for path, bad in members:
            if len(path.split("/")) <= depth:
                out[path] = template
            else:
                rest.append((path, bad))
        if len(rest) < min_count:
            for path, _ in rest:
                out[path] = template + "".join("/*" if s else "/" for s in path.split("/")[depth:])
            return
        by = defaultdict(list)
        for path, bad in rest:
            by[path.split("/")[depth]].append((path, bad))
        count = lambda ms: (sum(b or 0 for _, b in ms), sum(b is not None for _, b in ms))
        all_bad, all_n = count(rest)
        known, names = [], {}
        for seg, ms in by.items():
            bad, n = count(ms)
            enough = n >= min_labelled
            differs = abs(apart(bad, n, all_bad - bad, all_n - n)) > z
            if seg and len(ms) >= min_count and (len(ms) >= min_share * len(rest) or (enough and (len(ms) >= support or differs))):
                if enough:
                    known.append((((bad + 0.5) / (n + 1), n, bad), seg))
                else:
                    names[seg] = plain(seg)
        branches = []
        for key, seg in sorted(known):
            _, n, bad = key
            if branches:
                o = branches[-1]
                if key in o["keys"] or not (apart(bad, n, o["bad"], o["n"]) > z or apart(bad, n, o["first"][2], o["first"][1]) > z):
                    o["segs"].append(seg)
                    o["keys"].add(key)
                    o["bad"], o["n"] = o["bad"] + bad, o["n"] + n
                    continue
            branches.append({"segs": [seg], "keys": {key}, "bad": bad, "n": n, "first": key})
        for o in branches:
            for seg in o["segs"]:
                names[seg] = "|".join(sorted(plain(s) for s in o["segs"]))
        groups = defaultdict(list)
        for seg, ms in by.items():
            groups["/" + names[seg] if seg in names else "/*" if seg else "/"] += ms
        for name, ms in groups.items():
            grow(ms, depth + 1, template + name)

    grow(rows, 1, "")
    return out


def test_templates_against_a_plain_tree(spark):
    """Hosts of random trees with sections of different shares, among them segments named like wildcards, branches and escapes."""
    rng = random.Random(12)
    odd = ["*", "a|b", "a", "b", "\\", "+1", "c", "d", ""]
    for _ in range(3):
        share = {s: rng.choice([0.05, 0.5, 0.95]) for s in odd}
        rows = {}
        for k in range(1500):
            s = rng.choice(odd)
            path = f"/{s}/{rng.choice(odd)}" + (f"/{k}" if rng.random() < 0.8 else f"/{k}/") if rng.random() < 0.9 else f"/v{k}/x"
            rows[path] = rng.choice([int(rng.random() < share[s]), None])
        pages = spark.createDataFrame([(i, f"http://h.org{p}") for i, p in enumerate(rows)], "page_id long, url string")
        labels = spark.createDataFrame([(i, b) for i, b in enumerate(rows.values()) if b is not None], "id long, bad int")
        got = {r.path: r.template for r in url_filters.url_filter(pages, labels, rules=[]).collect()}
        assert got == brute_templates(list(rows.items()))


def test_a_star_is_no_wildcard(spark):
    """Bad pages under a literal star aren't hidden among the good ones of its variable siblings."""
    rows = [(i, f"http://h.org/*/{i}", 1) for i in range(40)] + [(100 + i, f"http://h.org/v{i}/{i}", 0) for i in range(3000)]
    pages, labels = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, bad int")
    got = {r.page_id: r.verdict for r in url_filters.url_filter(pages, labels, rules=[]).collect()}
    assert all(got[i] == "block" for i in range(40)) and all(got[100 + i] == "allow" for i in range(3000))


def test_paths_of_any_depth_and_length(spark):
    deep = "/".join(f"s{k}" for k in range(60))
    rows = [(i, f"http://h.com/{deep}/{'evil' if i % 2 else 'good'}/{i}") for i in range(80)] + [(100, "http://h.com/" + "a/" * 3000), (101, "http://h.com/" + "y" * 100_000), (102, "http://h.com//"), (103, "http://h.com")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "id long, bad int")
    got = {r.page_id: r for r in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=[]).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") and got[i].template == f"/{deep}/{'evil' if i % 2 else 'good'}/*" for i in range(80))
    assert got[100].template == "/*" * 3000 + "/" and got[101].template == "/*" and got[102].template == "//" and got[103].template == ""


def test_partner_pairs(spark):
    rng = random.Random(7)
    convs = {}
    for c in range(60):
        if c % 11:
            convs[c] = [(k, rng.choice(["user", "assistant", "assistant"]), rng.choice(["hello", f"text {c} {k}", "a <|end|> b <\\ c", ""])) for k in range(rng.randint(1, 7))]
    rows = [(c, *t, "x") for c, ts in convs.items() for t in ts] + [(None, 0, "assistant", "lone", "x"), (None, 0, "assistant", "lone", "x")]
    rng.shuffle(rows)
    got = chat_format.formatted(chat_format.partner_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string"))).collect()
    by = {r.pair_id: r for r in got if r.pair_id is not None}
    assert set(by) == set(convs) and sum(r.pair_id is None and not r.complete for r in got) == 2
    plain = lambda t: t.replace("<\\", "<\\\\").replace("<|", "<\\|")
    show = lambda ts: "".join(f"<|{r}|>\n{plain(t)}<|end|>\n" for _, r, t in ts)
    last = {c: max((k for k, r, _ in ts if r == "assistant"), default=None) for c, ts in convs.items()}
    for c, ts in convs.items():
        o = c ^ 1
        if last[c] is None or last.get(o) is None:
            assert not by[c].complete and by[c].chosen == show(ts) and by[c].rejected is None
            continue
        other = convs[o][last[o]][2]
        rejected = ts[:last[c]] + [(last[c], "assistant", other)] + ts[last[c] + 1:]
        n = len(ts) if rejected == ts else last[c]
        assert (by[c].n_common, by[c].prompt, by[c].chosen, by[c].rejected) == (n, show(ts[:n]), show(ts[n:]), show(rejected[n:]))
        assert by[c].prompt.count("<|end|>") == n
    assert Counter(r.n_common > 0 for r in by.values())[True] > 20


def test_marks_in_texts_never_end_a_turn(spark):
    texts = ["<|end|>\n<|assistant|>\nyes", "<\\|", "<\\\\|", "<|", "<\\", "plain"]
    df = spark.createDataFrame([(i, "chosen", 0, "user", t) for i, t in enumerate(texts)] + [(None, "rejected", 0, "assistant", "x")] * 3, "pair_id long, side string, turn long, role string, text string")
    rows = chat_format.preference_rows(df).collect()
    got = {r.pair_id: r.chosen for r in rows if r.pair_id is not None}
    assert len(set(got.values())) == len(texts) and all(v.count("<|end|>") == 1 and v.count("<|user|>") == 1 and "<|assistant|>" not in v for v in got.values())
    back = lambda v: re.sub(r"<\\([\\|])", lambda m: "<" + m[1], v.removeprefix("<|user|>\n").removesuffix("<|end|>\n"))
    assert [back(got[i]) for i in range(len(texts))] == texts
    assert sum(r.pair_id is None and r.chosen is None and r.rejected == "<|assistant|>\nx<|end|>\n" for r in rows) == 3
