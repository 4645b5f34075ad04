"""Vacancies out of JSON and pages: against plain scans and on hand-made pages."""

import json
import random

from pyspark.sql import functions as F

from joblattice.functions import json as js
from joblattice.sources import embedded, pages


def plain_regions(text, opening, closing, least):
    """Outermost balanced regions by a scan over characters."""
    pieces, i = [], 0
    while i < len(text):
        if text[i] == '"':
            j = i + 1
            while j < len(text) and text[j] not in '"\n':
                j += 2 if text[j] == "\\" and j + 1 < len(text) and text[j + 1] != "\n" else 1
                if text[j - 1 : j] == "\\" and text[j : j + 1] == "\n":
                    break
            if j < len(text) and text[j] == '"' and "\n" not in text[i:j]:
                i = j + 1
                continue
        elif text[i] in opening + closing:
            pieces.append((i, text[i]))
        i += 1
    stack, closed = [], []
    for at, c in pieces:
        if c == opening:
            stack.append(at)
        elif stack:
            start = stack.pop()
            closed = [r for r in closed if r[0] < start] + [(start, at + 1)]
    return sorted((a, text[a:b]) for a, b in closed if b - a > least)


def test_regions_of_hostile_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices('{}[]"\\\nab ', weights=[5, 5, 2, 2, 3, 1, 1, 3, 3, 3], k=rng.randrange(0, 60))) for _ in range(400)]
    texts += ["{" * 2000, "}" * 2000, '{"a": "}{", "b": {"c": 1}} tail {', '12" pipe\n{"k": 1}', "{" * 300 + "}" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for opening, closing in ("{}", "[]"):
        got = {}
        for r in embedded.regions(rows, opening, closing, least=1).collect():
            got.setdefault(r.doc_id, []).append((r.start, r.region))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == plain_regions(t, opening, closing, 1), (t, opening)


def job(**more):
    return {"jobTitle": "Senior cook", "id": 7, **more}


def test_vacancies_of_odd_bodies(spark):
    deep = job()
    for _ in range(embedded.DEEPEST):
        deep = [deep]
    bodies = {
        1: json.dumps({"a": {"b": [job(detail={"title": "Nested one", "company": "x"})]}}),
        2: "while(1);" + json.dumps({"r": json.dumps([{"title": "Inner cook", "company": "B", "url": "/a"}])}),
        3: 'call({"open": ' + json.dumps({"jobs": [{"title": "Salvaged cook", "Agency__c": "C", "pad": "x" * 90}]}) + ", 1)",
        4: json.dumps([{"id": 1, "name": "Sydney Region"}, {"name": "Home page", "href": "/"}, {"title": "abc", "company": "short"}, {"title": "No context here", "id": 3}]),
        5: None,
        6: "",
        7: "plain text",
        8: json.dumps(deep),
        9: json.dumps([deep]),
        10: json.dumps([job(location={"label": "Perth"}), {"jobTitle": "SENIOR COOK", "Id": "7", "work-location": ["PERTH", 1], "salary": "later"}, job(location="")]),
        11: json.dumps([{"title": "Typed cook", "salary": 12.5, "remuneration": 9, "postedDate": "3 March 2020", "closes": {"text": " soon "}, "link": "/x"}]),
    }
    rows = spark.createDataFrame(list(bodies.items()), "doc_id long, text string")
    got = sorted((r.doc_id, r.title, r.agency, r.loc, r.salary, r.close, str(r.posted), r.url, r.id) for r in embedded.vacancies(rows).collect())
    cook = ("", "", "", "", "None", "", "7")
    assert got == sorted([
        (1, "Senior cook", *cook), (2, "Inner cook", "B", "", "", "", "None", "/a", ""), (3, "Salvaged cook", "C", "", "", "", "None", "", ""),
        (8, "Senior cook", *cook), (10, "Senior cook", *cook), (10, "Senior cook", "", "Perth", "", "", "None", "", "7"), (11, "Typed cook", "", "", "12.5", "soon", "2020-03-03", "/x", ""),
    ])
    assert embedded.vacancies(rows.where("false")).count() == 0


def test_typed_fields(spark):
    values = ["1", "1.50", '" 2e1 "', '""', '"x"', "true", "null", "[1]", '{"a":1}', '"NaN"', '" text "']
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", js.parsed(F.col("t")).alias("v"))
    got = {r.t: (r.n, r.s, r.k) for r in rows.select("t", js.number(F.col("v")).alias("n"), js.text(F.col("v")).alias("s"), F.size(js.record(F.col("v"))).alias("k")).collect()}
    assert {t: n for t, (n, _, _) in got.items() if n is not None} == {"1": 1.0, "1.50": 1.5, '" 2e1 "': 20.0}
    assert [got[t][1] for t in ("null", '""', '" text "', "[1]", "true")] == ["", "", "text", "[1]", "true"]
    assert [t for t in values if got[t][2]] == ['{"a":1}']
    guards = spark.createDataFrame([("while(1);[1]",), (")]}',\n[1]",), ("for (;;); [1]",), ("[1",)], "t string")
    assert [r.s for r in guards.select(js.text(js.parsed(F.col("t"))).alias("s")).collect()] == ["[1]", "[1]", "[1]", ""]
    assert spark.sql("select parse_json('[1, {\"a\": 2}, [3], null]') v").select(F.size(js.records(F.col("v")))).first()[0] == 2


def test_cards_anchors_and_labels(spark):
    far = "." * 1300
    html = {
        1: '<a href="/job/cook-12345" aria-label="Organization: Big Co for Head cook">Big Co</a><a href="/job/cook-12345">Head cook</a><p>Location - Perth | Closing date: 1 May 2020</p>',
        2: '<a class="x" href="https://b.c/job/nurse"><b>Night</b> nurse</a> Department of Health and Care | Posted: 2 April 2021',
        3: f'<a href="/job/a-1">Left out far</a>{far}Agency: Too far',
        4: '<a href="/about">About us all</a><a href="/job/x-777">abc</a>',
        5: None,
    }
    df = spark.createDataFrame(list(html.items()), "page_id long, html string")
    got = {r.page_id: (r.title, r.agency, r.loc, r.url, r.close, str(r.posted), r.id) for r in pages.job_cards(df, site="https://s").collect()}
    assert got == {
        1: ("Head cook", "Big Co", "Perth", "https://s/job/cook-12345", "1 May 2020", "None", "12345"),
        2: ("Night nurse", "Department of Health and Care", "", "https://b.c/job/nurse", "", "2021-04-02", ""),
        3: ("Left out far", "", "", "https://s/job/a-1", "", "None", ""),
    }
    assert {r.page_id: r.title for r in pages.job_anchors(df, site="https://s").collect()} == {1: "Head cook", 2: "Night nurse", 3: "Left out far"}
    assert pages.job_anchors(df).where("page_id = 1").first().loc == "Perth"


def test_strategies(spark):
    script = lambda *jobs: f'<script type="application/ld+json">{json.dumps(list(jobs))}</script>'
    card = '<a href="/job/a-1">Card number one</a><a href="/job/b-2">Card number two</a>'
    posting = {"@type": "JobPosting", "title": "Welder", "hiringOrganization": {"name": "W"}, "company": "W", "url": "/j/1", "datePosted": "2026-08-01"}
    rows = [(1, script(posting)), (2, script(posting) + card), (3, script(posting, posting | {"title": "Second welder"}) + card), (4, card), (5, '<script type="application/json">{broken</script>'), (6, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = sorted((r.page_id, r.title, r.strategy) for r in pages.extract_jobs(df).collect())
    assert got == [(1, "Welder", "embedded-json"), (2, "Card number one", "job-cards"), (2, "Card number two", "job-cards"), (3, "Second welder", "embedded-json"), (3, "Welder", "embedded-json"), (4, "Card number one", "job-cards"), (4, "Card number two", "job-cards")]


def test_levels_of_a_walk_are_not_stored(spark):
    """Finding 2: every level of every body went to disk, with all that lay under it."""
    body = '{"a": {"b": [{"jobTitle": "Welder", "location": "Perth"}]}}'
    bodies = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(body).alias("text"))
    found = embedded.vacancies(bodies, double_encoded=False)
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.title, r["loc"]) for r in found.collect()) == [(i, "Welder", "Perth") for i in range(3)]


def test_links_and_boards_sort_no_whole_pages(spark):
    """Finding 7: every piece of every page was sorted to place its links, and vacancies of pages that are not there became html."""
    import re

    from conftest import DATA
    from joblattice.plans.pages import _boards

    link = re.compile(r'<a\b[^>]*?href="[^"]*/job/[\w-]+[^"]*"[^>]*>.*?</a>', re.I | re.S)
    html = ["", "no link", '<a href="/job/a-1">x</a>', '< <a href="/job/b">y</a><a href="/about">no</a> é𝄞 <A HREF="/job/c"\n>z\n</A>tail<a href="/job/d">open', '<a href="/x"><a href="/job/e">q</a></a>' * 3]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    found = pages.job_links(df, r"/job/[\w-]+")
    want = [(i, m.start(), m.end()) for i, h in enumerate(html) for m in link.finditer(h)]
    assert sorted((r.page_id, r.start, r.stop) for r in found.collect()) == want and len(want) >= 6
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "gap" in plan(found)
    boards = plan(_boards(spark, DATA))
    assert "LeftSemi" in boards and "ShuffledHashJoin" in boards


def test_bodies_are_read_once(spark):
    """Finding 1 of round 4: every body was made, parsed and walked again for each kind of salvage and once more for texts that are JSON in parts."""
    inner = json.dumps({"title": "Inner cook", "company": "B", "pad": "x" * 90, "deep": json.loads('{"a": ' * 20 + "{}" + "}" * 20)})
    bodies = {0: json.dumps([job(location="Perth")]), 1: json.dumps({"r": "{" + inner + "] {"}), 2: "say({" + json.dumps({"jobs": [job(pad="x" * 90)]}), 3: json.dumps({"r": json.dumps([job()])}), 4: "none", 5: None}
    made = spark.sparkContext.accumulator(0)

    def told(text):
        made.add(1)
        return text

    rows = spark.createDataFrame(list(bodies.items()), "doc_id long, text string").select("doc_id", F.udf(told)("text").alias("text"))
    got = sorted((r.doc_id, r.title, r.agency, r["loc"]) for r in embedded.vacancies(rows).collect())
    assert got == [(0, "Senior cook", "", "Perth"), (1, "Inner cook", "B", ""), (2, "Senior cook", "", ""), (3, "Senior cook", "", "")]
    assert made.value == len(bodies)
