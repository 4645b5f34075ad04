"""Text functions as columns: keys, titles, names, skills, places; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one blank, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def job_key(source: Column, title: Column, company: Column, place: Column) -> Column:
    """The advertisement's identity: source and three normalised parts of 120 characters, 400 in all."""
    part = lambda c: F.substring(norm(c), 1, 120)
    return F.substring(F.concat_ws("|", source, part(title), part(company), part(place)), 1, 400)


# The character references that page text is stripped of.
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def strip_html(c: Column) -> Column:
    """Text of a scrap of markup: scripts and styles out, tags as blanks, common references decoded."""
    text = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def skill_title(c: Column) -> Column:
    """A title as the skill matcher reads it: lower case, & spelt out, padded with blanks."""
    spelt = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spelt, r"[ \t\n\r]+", " ")), F.lit(" "))


def _quoted(term: str) -> str:
    return "".join("\\" + x if not x.isalnum() and x != " " else x for x in term)


def matched_skills(title: Column, taxonomy: list[dict], context: Column | None = None) -> Column:
    """Skills of a title, in taxonomy order; null where none matches.

    A taxonomy entry has skill and terms, and may have except (phrases that
    suppress the skill) and gated (terms that count only if the title, or the
    context, matches the entry's evidence).  Terms that begin with a letter or
    digit match at a word's start only.
    """
    padded = skill_title(title)
    around = F.concat(padded, skill_title(context)) if context is not None else padded
    found = []
    for entry in taxonomy:
        pattern = lambda terms: "|".join(("(?<![a-z0-9])" if t[0].isalnum() else "") + _quoted(t.lower()) for t in terms)
        hit = padded.rlike(pattern(entry["terms"])) if entry["terms"] else F.lit(False)
        if entry.get("gated"):
            hit = hit | (padded.rlike(pattern(entry["gated"])) & around.rlike(pattern(entry["evidence"])))
        for phrase in entry.get("except", ()):
            hit = hit & ~padded.contains(phrase.lower())
        found.append(F.when(hit, F.lit(entry["skill"])))
    return non_empty(F.array_compact(F.array(*found)))


def contained_skills(title: Column, taxonomy: list[dict]) -> Column:
    """The batch matcher: plain containment, no word starts, no gates, & left as it is."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "))
    found = []
    for entry in taxonomy:
        hit = F.lit(False)
        for term in entry["terms"]:
            hit = hit | text.contains(term.lower())
        for phrase in entry.get("except", ()):
            hit = hit & ~text.contains(phrase.lower())
        found.append(F.when(hit, F.lit(entry["skill"])))
    return non_empty(F.array_compact(F.array(*found)))


def non_empty(c: Column) -> Column:
    """An array, null instead of an empty one."""
    return F.when(F.size(c) > 0, c)


def stored_skills(c: Column, aliases: dict[str, str], canonical: list[str]) -> Column:
    """Skills of a stored JSON array: aliases resolved, unknown ones dropped, each once; garbage gives none."""
    raw = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    known = F.array(*[F.lit(s) for s in canonical]).cast("array<string>")
    renamed = raw
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        renamed = F.transform(raw, lambda s: F.coalesce(F.try_element_at(table, s), s))
    return F.array_distinct(F.filter(renamed, lambda s: F.array_contains(known, s)))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(norm(c), " "), lambda t: t != "")


def same_company(a: Column, b: Column) -> Column:
    """The shorter name's words begin the longer one; names without words match nothing."""
    x, y = _tokens(a), _tokens(b)
    n = F.least(F.size(x), F.size(y))
    return (n > 0) & (F.slice(x, 1, F.greatest(n, F.lit(1))) == F.slice(y, 1, F.greatest(n, F.lit(1))))


def substring_only(needle: Column, text: Column) -> Column:
    """Contained as characters, but not as whole words."""
    n, t = norm(needle), norm(text)
    whole = F.concat(F.lit(" "), t, F.lit(" ")).contains(F.concat(F.lit(" "), n, F.lit(" ")))
    return (n != "") & t.contains(n) & ~whole


# Words of a company's legal form.
CORPORATE = (
    "group groups holdings holding ltd limited plc pty inc incorporated corp corporation company co the "
    "international global shared services service solutions operations business support centre center and of "
    "bank banking insurance philippines philippine malaysia malaysian australia australian asia pacific apac "
    "sdn bhd berhad nv sa ag llc llp"
).split()


def advertiser_matches(advertiser: Column, employer: Column, aliases: list[str] = ()) -> Column:
    """The advertiser is the employer: an alias, or one name begins the other, and a longer
    advertiser adds words of a corporate form only.  A leading "the" is dropped."""
    bare = lambda c: F.regexp_replace(norm(c), "^the ", "")
    a, e = _tokens(bare(advertiser)), _tokens(bare(employer))
    n = F.least(F.size(a), F.size(e))
    begins = (n > 0) & (F.slice(a, 1, F.greatest(n, F.lit(1))) == F.slice(e, 1, F.greatest(n, F.lit(1))))
    extra = F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))
    legal = F.forall(extra, lambda w: w.isin(CORPORATE))
    alias = bare(advertiser).isin([str(x) for x in aliases]) if aliases else F.lit(False)
    return alias | (begins & legal)


def near_miss(advertiser: Column, employer: Column) -> Column:
    """Shares its first word with the employer without matching it."""
    a, e = _tokens(advertiser), _tokens(employer)
    return (F.size(a) > 0) & (F.size(e) > 0) & (F.get(a, F.lit(0)) == F.get(e, F.lit(0))) & ~advertiser_matches(advertiser, employer)


def attribution_verdict(advertiser: Column, employer: Column) -> Column:
    """ok, loose, substr, unrelated, or no-employer."""
    return (
        F.when(norm(employer) == "", "no-employer")
        .when(advertiser_matches(advertiser, employer), "ok")
        .when(same_company(advertiser, employer), "loose")
        .when(substring_only(employer, advertiser), "substr")
        .otherwise("unrelated")
    )


def mentions(headline: Column, name: Column) -> Column:
    """A name of three characters or more stands in the headline as whole words."""
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return (F.length(F.trim(name)) >= 3) & (F.length(F.trim(spaced(name))) > 0) & spaced(headline).contains(spaced(name))


def place_to_hub(location: Column, needles: list[tuple[str, str]], home: str, home_names: list[str]) -> Column:
    """The hub of the first needle that the location holds as words; a blank location, or one that names
    the home country only, is the home hub."""
    text = F.concat(F.lit(" "), norm(location), F.lit(" "))
    hit = F.coalesce(*[F.when(text.contains(f" {n} "), F.lit(h)) for n, h in needles])
    at_home = (norm(location) == "") | norm(location).isin(home_names)
    return F.coalesce(hit, F.when(at_home, F.lit(home)))


def first_contained(text: Column, names: list[str]) -> Column:
    """The first name of a list that the text holds."""
    return F.coalesce(*[F.when(F.lower(text).contains(n.lower()), F.lit(n)) for n in names])


def hiring_area(category: Column, areas: dict[str, str | None]) -> Column:
    """The canonical area of a board's category; null for names that aren't areas."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(category), r"(?i)\s+jobs?$", "")))
    table = F.create_map(*[x for k, v in areas.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    return F.try_element_at(table, bare)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def unwrapped_url(url: Column) -> Column:
    """The target of a redirecting link (its url or q parameter), else the link itself."""
    target = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("url")), F.try_parse_url(url, F.lit("QUERY"), F.lit("q")))
    return F.when(target.rlike("^https?(:|%3A)"), F.try_url_decode(target)).otherwise(url)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]*)", 1)), r"^(www|m)\.", "")


def search_phrases(name: Column, brands: Column) -> Column:
    """The name, then its brands, each once whatever its case."""
    every = F.filter(F.concat(F.array(name), F.coalesce(brands, F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    low = F.transform(every, lambda x: F.lower(F.trim(x)))
    return F.filter(every, lambda x, i: F.array_position(low, F.lower(F.trim(x))) == i + 1)


# Words of rank in a job's title.
SENIORITY = "senior principal lead junior assistant graduate trainee".split()


def title_head(title: Column) -> Column:
    """The title before its first separator, without words of rank, normalised."""
    head = F.get(F.split(F.replace(title, F.lit("&amp;"), F.lit("&")), r"[,\-–(|/]"), F.lit(0))
    bare = F.regexp_replace(F.lower(head), r"\b(" + "|".join(SENIORITY) + r")\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]+", " "), " +", " "))


# Words that carry no meaning for matching.
STOPWORDS = (
    "a an the and or of to in for on with at by from as is are be been being this that these those it its "
    "their his her our your my we you they he she i us them then than there here into over under out up down off "
    "will would can could should may might must shall not no nor so such other others any all each both few more most "
    "some many much very also both either neither per via within without across between about above below during "
    "after before while when where which who whom whose what how why use used uses using including include includes "
    "included based provide provides provided providing perform performs performed performing work works working "
    "worked activities duty duties task tasks ensure ensures ensured ensuring determine determines identify identifies "
    "maintain maintains prepare prepares develop develops operate operates conduct conducts new various related "
    "appropriate necessary etc may due able make makes made take takes given follow follows following record records "
    "report reports process processes procedure procedures general standard standards "
    "required requires requiring order orders one two three"
).split()


def stem(w: Column) -> Column:
    """Endings -ing, -ed and -s of words that are long enough."""
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ing"), F.substring(w, F.lit(1), n - 3))
        .when((n > 4) & w.endswith("ed"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def search_tokens(text: Column) -> Column:
    """Words of three characters or more with their stems, and pairs of neighbours; stopwords break pairs."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))
    means = lambda w: ~w.isin(STOPWORDS)
    single = F.filter(words, means)
    stems = F.filter(F.transform(single, stem), lambda s: F.length(s) >= 4)
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.when(means(a) & means(b), F.concat_ws(" ", a, b)))
    return F.concat(single, F.array_except(stems, single), F.array_compact(pairs))


# What a question's wording asks for, in order of precedence.
NOT_HELD = ["applicant", "fill rate", "compet", "contested", "crowded", "how hard"]
INTENTS = [
    ("history", ["history", "historical", "over time", "long run", "long-run", "since 2", "last decade", "ten years", "5 year", "five year", "year on year", "year-on-year", "yoy", "peak", "pre-covid", "before covid", "recover"]),
    ("pay", ["salary", "salaries", "pay", "paid", "compensation", "wage", "$"]),
    ("duration", ["time to fill", "time-to-fill", "hard to fill", "hardest to fill", "longest to fill", "take longest", "takes longest", "slow to fill", "quick to fill", "how long", "days to fill", "stay open", "stay up", "linger", "sit unfilled", "unfilled", "vacancy duration", "advertis"]),
    ("skills", ["skill", "capabilit", "hiring for", "what are they hiring", "occupation"]),
    ("volume", ["hiring", "vacanc", "open role", "opening", "demand", "trend", "how many", "growth", "grow"]),
]


def intent(question: Column) -> Column:
    """What a question asks for: history, pay, duration, skills, volume or unknown."""
    low = F.lower(F.coalesce(question, F.lit("")))
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    rule = F.when(holds(NOT_HELD), "unknown")
    for name, words in INTENTS:
        rule = rule.when(holds(words), name)
    return rule.otherwise("unknown")


def longest_contained(text: Column, names: list[str]) -> Column:
    """The longest of the names that the text holds, the alphabetically first of equally long ones."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return F.coalesce(*[F.when(F.lower(text).contains(n.lower()), F.lit(n)) for n in ordered])
