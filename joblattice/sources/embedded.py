"""Vacancies out of JSON of unknown shape: bodies of responses, and the JSON that pages embed.

A body is parsed as a whole, or, where it isn't JSON, its balanced regions are.  A
value is walked inside its row, level by level down to ``DEEPEST``, and no further than
what looks like a vacancy.  Texts that hold JSON themselves are parsed and walked once
more, in the same way and in the same pass: a body is read once, and nothing of it is
stored.  Everything is built-in functions over VARIANT; a row holds its body, the pieces
it is cut into, and one level of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as js
from ..functions.dates import loose_date

DEEPEST = 30
LEAST_REGION = 80
AT_ONCE = 8
# The names under which boards keep each field, most specific first, without case and marks.
TITLE = "jobtitle positiontitle roletitle advertisedtitle jobname title name".split()
ORG = "organisation organization agency agencyname departmentname department employer organisationname cluster company entity".split()
LOC = "location joblocation worklocation region suburb city locationname".split()
URL = "url joburl applicationurl link href applyurl detailurl".split()
SALARY = "salary salaryrange remuneration packagerange salarydescription".split()
CLOSE = "closingdate closedate jobclosedate closes applicationclosingdate expirydate".split()
POSTED = "posteddate postingdate jobposteddate dateposted publisheddate publicationdate advertiseddate opendate startdate createddate posted published".split()
ID = "jobid id jobreference referencenumber requisitionid vacancyid".split()
OWN_TITLE = "jobtitle positiontitle roletitle advertisedtitle jobname".split()
OWN_ID = "jobid jobreference requisitionid vacancyid referencenumber vacancynumber".split()
SHOWN = "label name value text displayvalue".split()
MIN_TITLE, MAX_TITLE = 4, 160
FIELDS = {"title": TITLE, "agency": ORG, "loc": LOC, "url": URL, "salary": SALARY, "close": CLOSE, "posted": POSTED, "id": ID, "own_title": OWN_TITLE, "own_id": OWN_ID}
KNOWN = sorted({n for names in FIELDS.values() for n in names})
CONTEXT = [*OWN_TITLE, *ORG, *LOC, *SALARY, *CLOSE, *OWN_ID]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; unlike an array's element it isn't copied for that."""
    return F.aggregate(F.array(), value, lambda held, _: held, use)


def _key(k: Column) -> Column:
    """A field's name without case, marks and the ending of custom fields."""
    return F.regexp_replace(F.lower(k), "__c$|[^a-z0-9]", "")


def _texts(ks: Column, vs: Column, known, value) -> Column:
    """A map of the known keys' texts that aren't empty; of values with one key the last counts."""
    texts = F.transform(ks, lambda k, i: F.when(known(k), F.struct(k.alias("k"), value(F.get(vs, i)).alias("t"))))
    last = F.filter(texts, lambda x, i: (x["t"] != "") & ~F.array_contains(F.slice(ks, i + 2, F.size(ks)), x["k"]))
    return F.map_from_entries(last)


def _first(names: list[str], of: Column) -> Column:
    """The text under the first of the names that has one, else ''."""
    return F.coalesce(*[F.try_element_at(of, F.lit(n)) for n in names], F.lit(""))


def _brackets(t: Column) -> Column:
    """Whether a value of this text can be an object or an array; a string can look the same."""
    return F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("["))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _scalar(v: Column) -> Column:
    """A scalar's trimmed text; '' for everything else."""
    return _let(_string(v), lambda t: F.when(_brackets(t), js.scalar(v)).otherwise(F.coalesce(F.trim(t), F.lit(""))))


def _shown(v: Column) -> Column:
    """The text that a field shows: its own, its label's, or its first element's."""
    known = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for n in SHOWN for x in (n, True)]), k)
    texts = lambda fields: _let(F.transform(F.map_keys(fields), _key), lambda ks: _texts(ks, F.map_values(fields), known, _scalar))
    nested = lambda fields: _let(texts(fields), lambda t: _first(SHOWN, t))
    first = lambda values: _scalar(F.get(values, F.lit(0)))
    inner = _let(js.as_object(v), lambda o: F.when(o.isNotNull(), nested(o)).otherwise(_let(js.as_array(v), lambda a: F.when(a.isNotNull(), first(a)).otherwise(js.scalar(v)))))
    return _let(_string(v), lambda t: F.when(_brackets(t), inner).otherwise(F.coalesce(F.trim(t), F.lit(""))))


def _vacancy(fields: Column) -> Column:
    """The texts of a record's known fields by their names without marks; null where it is no vacancy.

    A vacancy has a title of 4 to 160 characters under a name that only vacancies
    have, or under any title name beside an employer, a place, pay, a closing date or a vacancy's number.
    """
    context = lambda ks: F.exists(ks, lambda k: k.isin(CONTEXT))
    fits = lambda texts: _let(F.length(_first(TITLE, texts)), lambda n: n.between(MIN_TITLE, MAX_TITLE)) & context(F.map_keys(texts))
    texts = lambda ks: _texts(ks, F.map_values(fields), lambda k: k.isin(KNOWN), _shown)
    held = lambda ks: F.when(context(ks), _let(texts(ks), lambda t: F.when(fits(t), t)))
    return F.when(F.size(fields) >= 2, _let(F.transform(F.map_keys(fields), _key), held))


# ---------------------------------------------------------------------- salvage


def _running(xs: Column, both) -> Column:
    """At each place of an array what ``both`` makes of everything up to it, doubling the reach each round."""
    reaches = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda reach: reach < F.size(xs))
    return F.aggregate(reaches, xs, lambda done, reach: F.transform(done, lambda x, i: F.coalesce(both(x, F.get(done, i - reach)), x)))


def _regions(text: Column, opening: str, closing: str, least: int) -> Column:
    """array(start, region): see :func:`regions`.

    The text is cut into brackets, stretches without any, and what is balanced within ``AT_ONCE`` levels.
    Depth is a running sum over these pieces, and what lies deeper than the depth that is never left again is a region.
    """
    a, b = f"\\{opening}", f"\\{closing}"
    plain = rf'"(?:[^"\\\n]|\\[^\n])*+"|[^"{a}{b}]++|"'
    whole = rf"{a}(?:{plain})*+{b}"
    for _ in range(AT_ONCE - 1):
        whole = rf"{a}(?:{plain}|{whole})*+{b}"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:{plain})++|{whole}|[{a}{b}]"), F.lit(0))
    plus, fewer = lambda x, y: x + y, lambda x, y: F.least(x, y)

    def placed(ps: Column) -> Column:
        steps = F.transform(ps, lambda p: F.when(p == opening, 1).when(p == closing, -1).otherwise(0))
        depth = lambda sums: F.zip_with(sums, _running(sums, fewer), lambda x, low: x - F.least(F.lit(0), low))
        over = lambda deep: F.zip_with(deep, F.reverse(_let(F.reverse(deep), lambda d: _running(d, fewer))), lambda x, low: x - low)
        ends = _let(F.transform(ps, lambda p: F.length(p)), lambda n: _running(n, plus))
        return _let(_let(_let(_let(steps, lambda s: _running(s, plus)), depth), over), lambda o: _let(ends, lambda e: cut_out(ps, o, e)))

    def cut_out(ps: Column, over: Column, ends: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ps) - 1)
        at_once = lambda i: F.get(ps, i).startswith(opening) & (F.length(F.get(ps, i)) > 1)
        before = lambda i: F.coalesce(F.get(over, i - 1), F.lit(0))
        first = F.filter(places, lambda i: (before(i) == 0) & ((F.get(over, i) > 0) | at_once(i)))
        last = F.filter(places, lambda i: (F.get(over, i) == 0) & ((before(i) > 0) | at_once(i)))
        made = lambda i, j: F.struct((F.get(ends, i) - F.length(F.get(ps, i))).alias("start"), F.array_join(F.slice(ps, i + 1, j - i + 1), "").alias("region"))
        return F.filter(F.zip_with(first, last, made), lambda r: F.length(r["region"]) > least)

    return _let(pieces, lambda ps: F.when(F.size(ps) > 0, placed(ps)))


def regions(texts: DataFrame, opening: str, closing: str, least: int = LEAST_REGION) -> DataFrame:
    """(doc_id, start, region): the outermost balanced stretches between two brackets that are longer than ``least``.

    Brackets inside quoted strings don't count; a quote without its partner on its
    line is no string; brackets without a partner are passed over.  ``texts`` has doc_id and text.
    """
    return texts.select("doc_id", F.inline(_regions(F.col("text"), opening, closing, least)))


def _roots(text: Column) -> Column:
    """array(obj, v): a text's JSON: the whole, or the regions in it that are JSON, those in braces first; null without any bracket."""
    found = lambda turn, brackets: F.transform(_regions(text, *brackets, LEAST_REGION), lambda r: F.struct(F.array(F.lit(turn).cast("long"), r["start"].cast("long")).alias("obj"), F.try_parse_json(r["region"]).alias("v")))
    parts = F.filter(F.concat(*[F.coalesce(found(turn, brackets), F.array()) for turn, brackets in enumerate(("{}", "[]"))]), lambda r: r["v"].isNotNull())
    whole = lambda v: F.array(F.struct(F.array(F.lit(0).cast("long")).alias("obj"), v.alias("v")))
    return _let(js.parsed(text), lambda v: F.when(v.isNotNull(), whole(v)).when(F.contains(text, F.lit("{")) | F.contains(text, F.lit("[")), parts))


# ------------------------------------------------------------------------- walk


def walked(text: Column, double_encoded: bool) -> Column:
    """array(at, held) of one body: the vacancies in it, in no other vacancy, down to ``DEEPEST`` levels.

    ``at`` is a vacancy's path, ``held`` its texts by name; an object's fields are in alphabetical order.
    With ``double_encoded`` a text that begins like JSON is walked as well (-1 in the path).
    A row holds one level of its values at a time.
    """
    nodes, told = "array<struct<at: array<bigint>, v: variant, depth: int, inner: boolean>>", "array<struct<at: array<bigint>, held: map<string, string>>>"
    node = lambda at, v, depth, inner: F.struct(at.alias("at"), v.alias("v"), depth.alias("depth"), inner.alias("inner"))
    is_a = lambda v, kind: F.try_variant_get(v, "$", kind).isNotNull()
    deep = lambda v: is_a(v, "struct<>") | is_a(v, "array<struct<>>")  # without what is in it
    like = lambda v: _let(F.trim(_string(v)), lambda t: t.rlike(r"^[{\[]") & (F.length(t) > 2))

    def below(n: Column, values: Column) -> Column:
        """The nodes under one, whose values these are; a text has none."""
        wanted = lambda x: (deep(x) | (~n["inner"] & like(x))) if double_encoded else deep(x)
        placed = F.transform(values, lambda x, i: F.when(wanted(x), node(F.array_append(n["at"], i.cast("long")), x, n["depth"] + 1, n["inner"])))
        kids = F.when(values.isNotNull(), F.when(n["depth"] < DEEPEST, F.filter(placed, lambda k: k.isNotNull())))
        if double_encoded:
            again = lambda t: F.transform(_roots(t), lambda r: node(F.concat(n["at"], F.array(F.lit(-1).cast("long")), r["obj"]), r["v"], F.lit(0), F.lit(True)))
            kids = kids.when(~n["inner"], _let(_string(n["v"]), again))
        return F.coalesce(kids, F.array().cast(nodes))

    def judged(n: Column) -> Column:
        def split(fields: Column, held: Column) -> Column:
            here = F.when(held.isNotNull(), F.array(F.struct(n["at"].alias("at"), held.alias("held")))).otherwise(F.array().cast(told))
            front = F.when(held.isNull(), _let(F.coalesce(F.map_values(fields), js.as_array(n["v"])), lambda values: below(n, values))).otherwise(F.array().cast(nodes))
            return F.struct(front.alias("front"), here.alias("out"))

        return _let(js.as_object(n["v"]), lambda fields: _let(_vacancy(fields), lambda held: split(fields, held)))

    def level(state: Column) -> Column:
        both = lambda each: F.struct(F.flatten(each["front"]).alias("front"), F.concat(state["out"], F.flatten(each["out"])).alias("out"))
        return _let(F.transform(state["front"], judged), both)

    first = F.transform(_roots(text), lambda r: node(r["obj"], r["v"], F.lit(0), F.lit(False)))
    begin = F.struct(F.coalesce(first.cast(nodes), F.array().cast(nodes)).alias("front"), F.array().cast(told).alias("out"))
    # Each turn copies its state, so the turns without a level left come in few groups.
    turns = lambda n, begin, turn: F.aggregate(F.array(*[F.lit(0)] * n), begin, lambda state, _: F.when(F.size(state["front"]) == 0, state).otherwise(turn(state)))
    return turns((2 if double_encoded else 1) * (DEEPEST // 16 + 1), begin, lambda state: turns(4, state, lambda state: turns(4, state, level)))["out"]


def vacancies(bodies: DataFrame, double_encoded: bool = True) -> DataFrame:
    """The vacancies in JSON bodies (doc_id, text): doc_id and the texts of title, agency, loc, url, salary, close, posted (a day) and id.

    ``doc_id`` is unique, or ``part`` tells the bodies of one apart.  A text in a body that holds JSON itself is read
    too, one level deep.  Of a doc_id's vacancies of one title and place, in any casing, and one number the first stays.
    Null texts and texts without JSON give none.
    """
    part = F.col("part") if "part" in bodies.columns else F.lit(0)
    found = bodies.select("doc_id", part.cast("long").alias("part"), F.inline(walked(F.col("text"), double_encoded)))
    read = found.select("doc_id", "part", "at", *[_first(names, F.col("held")).alias(f) for f, names in FIELDS.items() if not f.startswith("own_")])
    nth = F.row_number().over(Window.partitionBy("doc_id", F.lower("title"), "id", F.lower("loc")).orderBy("part", "at"))
    kept = read.withColumn("nth", nth).where("nth = 1")
    return kept.select("doc_id", "title", "agency", "loc", "url", "salary", "close", loose_date(F.col("posted")).alias("posted"), "id")
