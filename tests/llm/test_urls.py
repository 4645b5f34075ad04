"""The template tree and its merged branches against a plain Python tree, and odd urls."""

import math
import random
from collections import Counter, defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from joblattice.llm import queries, url_filter


def python_templates(counts, few=8, share=0.05):
    """{(host, path): template} by a plain walk down the tree of segments."""
    out = {}

    def grow(host, t, rows):
        for path, rest, _ in rows:
            if not rest:
                out[host, path] = t
        rows = [r for r in rows if r[1]]
        weight = Counter()
        for _, rest, n in rows:
            weight[rest[0]] += n
        below = defaultdict(list)
        for path, rest, n in rows:
            s = rest[0]
            fair = len(weight) <= few or weight[s] >= share * sum(weight.values())
            tail = s[s.rindex(".") :] if "." in s else ""
            ending = tail if 2 <= len(tail) <= 6 and tail[1:].isascii() and tail[1:].isalpha() else ""
            below[s if fair or s == "" else "*" + ending].append((path, rest[1:], n))
        for name, part in below.items():
            grow(host, f"{t}/{name}", part)

    hosts = defaultdict(list)
    for (host, path), n in counts.items():
        hosts[host].append((path, path.split("/")[1:], n))
    for host, rows in hosts.items():
        grow(host, "", rows)
    return out


def python_purity(labelled, weight=20.0, z=1.96, least=5):
    """{(host, template): bad share} from {(host, template): (m, b)}, merging level by level from below."""
    cls = {k: (k[0], *k[1].split("/")) for k in labelled}
    for level in range(max((len(c) for c in cls.values()), default=0), 1, -1):
        counts = defaultdict(lambda: [0, 0])
        for k, (m, b) in labelled.items():
            counts[cls[k]][0] += m
            counts[cls[k]][1] += b
        shapes = defaultdict(list)
        for c in counts:
            if len(c) > level:
                shapes[(*c[:level], "+", *c[level + 1 :])].append(c)
        new = {}
        for shape, members in shapes.items():
            sm, sb = (sum(counts[c][i] for c in members) for i in (0, 1))
            for c in members:
                m, b = counts[c]
                if len(members) > 1 and m >= least and sm > m and abs(b / m - sb / sm) <= z * math.sqrt(sb / sm * (1 - sb / sm) * (1 / m + 1 / (sm - m))):
                    new[c] = shape
        cls = {k: new.get(c, c) for k, c in cls.items()}
    joint = defaultdict(lambda: [0, 0])
    for k, (m, b) in labelled.items():
        joint[cls[k]][0] += m
        joint[cls[k]][1] += b
    all_m, all_b = (sum(v[i] for v in labelled.values()) for i in (0, 1))
    return {k: (joint[cls[k]][1] + weight * all_b / all_m) / (joint[cls[k]][0] + weight) for k in labelled}, cls


def check(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("template", F.lit("clash"))
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, labels, []).collect()}
    assert len(got) == len(urls)
    counts, known = Counter(), defaultdict(lambda: [0, 0])
    for r in got.values():
        counts[r.host, r.path] += 1
    want = python_templates(counts)
    assert {(r.host, r.path): r.template for r in got.values()} == want
    for key in set((r.host, want[r.host, r.path]) for r in got.values()):
        known[key] = [0, 0]
    for i, x in bad.items():
        known[got[i].host, want[got[i].host, got[i].path]][0] += 1
        known[got[i].host, want[got[i].host, got[i].path]][1] += x
    shares, cls = python_purity(dict(known))
    for r in got.values():
        share = shares[r.host, r.template]
        assert abs(r.bad_share - share) < 1e-9 and r.verdict == ("block" if share >= 0.5 else "allow")
    return cls


def test_tree_by_plain_python(spark):
    rng = random.Random(4)
    urls = [None, "x", "http://h.io", "http://h.io/", "http://h.io//a/", "http://deep.io" + "/d" * 60 + "/1.html", "http://deep.io" + "/d" * 60 + "/2.html"]
    for lang in ("en", "fr", "de"):
        for kind, p in (("spam", 0.9), ("news", 0.05), ("shop", 0.5)):
            urls += [f"http://h.io/{lang}/{kind}/{rng.randrange(400)}{rng.choice(['', '.html', '/x', '/y/z'])}" for _ in range(40)]
    urls += [f"http://k.io/{i % 12}/a?x" for i in range(60)]
    bad = {i: rng.random() < (0.9 if "spam" in u else 0.05 if "news" in u else 0.5) for i, u in enumerate(urls) if u and i % 2 and "." in u}
    cls = check(spark, urls, bad)
    assert any(c.count("+") > 1 for c in cls.values()) and any(c.count("+") == 1 for c in cls.values())


def test_tree_of_the_test_pages(spark):
    pages = [r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").collect()]
    check(spark, pages, {i: i % 3 == 0 for i in range(0, len(pages), 2)})


def test_no_labels_no_pages_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.io/x"), (1, "http://a.io/x"), (None, "http://a.io/y"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert [r.verdict for r in url_filter.judge(pages, none, queries.URL_RULES).collect()] == ["allow"] * 4
    assert url_filter.judge(pages.where("false"), none, queries.URL_RULES).count() == 0
