"""URL filters: listed rules first, a tree of path templates for the rest; DataFrame functions only.

Rules name a host and the start of a path; the longest rule that fits a url
decides.  Other urls are judged by their template.  Per host a tree is grown
over path segments: below a node, what all its paths have in common stays as it is;
where they part, a segment stays itself if the node has few different segments or
the segment holds a fair share of the node's urls, and becomes a wildcard otherwise
(``*``, with the file ending kept).  The tree ends when no path has a segment left, so
it has as many rounds as the paths part ways, however long they are.

Merging goes from the deepest segments up: templates that differ in one segment only
are branches of one shape; a labelled branch whose share of bad labels does not
differ from the shape's, by a two-proportion test, is merged with it, shares its
counts from then on, and may be merged again further up.  A template is rejected if
its share of bad labels, smoothed by the share of all labels, reaches ``reject_at``.

Counts are made on distinct (host, path) with their numbers of urls, and only ever
aggregated; joins are on (host, path) or a node, whose largest one (urls without a
host, or a host's root) is left to the adaptive skew join.

Edge cases: a null url, or one without ``://``, has an empty host and path;
urls without labels count towards the tree but not towards purity; with no
labels at all nothing is rejected; repeated rows are judged alike; a null page_id
has no label; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict; rules are (verdict, host, path)."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        said = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, said) if found is None else found.when(fits, said)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _after(segments: str, n: Column) -> Column:
    """The array without its first n elements."""
    return F.slice(segments, n + 1, F.greatest(F.size(segments) - n, F.lit(0)))


def _shared(lo: str, hi: str) -> Column:
    """How many leading elements two arrays share; those of the least and the largest are shared by all between."""
    same = F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def path_templates(paths: DataFrame, few: int = 8, share: float = 0.05) -> DataFrame:
    """(host, path, n) with the template of each path."""
    cut = paths.select("host", "path", "n", F.split("path", "/").alias("seg"))
    rows = written(cut.select("host", "path", "n", _after("seg", F.lit(1)).alias("rest"), F.lit("").alias("t")), "paths")
    used, done = [rows], [rows.where(F.size("rest") == 0)]
    while rows.where(F.size("rest") > 0).take(1):
        open_ = rows.where(F.size("rest") > 0)
        nodes = open_.groupBy("host", "t").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")).select("host", "t", _shared("lo", "hi").alias("common"))
        ahead = open_.join(nodes, ["host", "t"])
        literal = F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("common")), lambda x: F.concat(F.lit("/"), x)), "")
        at = written(ahead.select("host", "path", "n", _after("rest", F.col("common")).alias("rest"), F.concat("t", literal).alias("t")).withColumn("s", F.get("rest", F.lit(0))), "nodes")
        segments = at.where("s IS NOT NULL").groupBy("host", "t", "s").agg(F.sum("n").alias("k"))
        totals = segments.groupBy("host", "t").agg(F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("all"))
        kept = segments.join(totals, ["host", "t"]).where((F.col("kinds") <= few) | (F.col("k") >= share * F.col("all"))).select("host", "t", "s", F.lit(True).alias("literal"))
        name = F.when(F.coalesce("literal", F.lit(False)) | (F.col("s") == ""), F.col("s")).otherwise(F.concat(F.lit("*"), F.regexp_extract("s", r"(\.[A-Za-z]{1,5})$", 1)))
        named = at.join(kept, ["host", "t", "s"], "left")
        step = named.select("host", "path", "n", _after("rest", F.lit(1)).alias("rest"), F.when(F.col("s").isNull(), F.col("t")).otherwise(F.concat("t", F.lit("/"), name)).alias("t"))
        rows = written(step, "paths")
        used += [at, rows]
        done.append(rows.where(F.size("rest") == 0))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    out = written(whole.select("host", "path", "n", F.col("t").alias("template")), "templates")
    for table in used:
        forget(table)
    return out


def _wild(level: int) -> Column:
    """The class with its segment at a level wild."""
    return F.concat(F.slice("cls", 1, level), F.array(F.lit("+")), _after("cls", F.lit(level + 1)))


def merged_branches(counts: DataFrame, z: float = 1.96, min_labels: int = 5) -> DataFrame:
    """(host, template, m, b, cls): the class each template is merged into, from the deepest level up.

    Levels at which no two templates are branches of one shape are passed over.
    """
    units = written(counts.select("host", "template", "m", "b", F.split("template", "/").alias("cls")), "units")
    shapes = units.select("host", "cls", F.explode(F.sequence(F.lit(0), F.size("cls") - 1)).alias("level")).where("level > 0")
    several = shapes.select("host", "level", F.concat(F.slice("cls", F.lit(1), F.col("level")), F.array(F.lit("+")), _after("cls", F.col("level") + 1)).alias("shape")).groupBy("host", "level", "shape").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    for level in sorted((r.level for r in several.select("level").distinct().collect()), reverse=True):  # as many as the templates are deep
        classes = units.where(F.size("cls") > level).groupBy("host", "cls").agg(F.sum("m").alias("m"), F.sum("b").alias("b")).withColumn("shape", _wild(level))
        pool = classes.groupBy("host", "shape").agg(F.sum("m").alias("sm"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("k")).where("k > 1 AND sm > 0")
        pooled = F.col("sb") / F.col("sm")
        noise = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col("m"), F.lit(0)) + 1 / F.nullif(F.col("sm") - F.col("m"), F.lit(0))))
        alike = (F.col("m") >= min_labels) & (F.abs(F.col("b") / F.nullif(F.col("m"), F.lit(0)) - pooled) <= z * noise)
        moved = classes.join(pool, ["host", "shape"]).where(alike).select("host", "cls", "shape")
        new = written(units.join(moved, ["host", "cls"], "left").select("host", "template", "m", "b", F.coalesce("shape", "cls").alias("cls")), "units")
        forget(units)
        units = new
    return units


def template_purity(templates: DataFrame, weight: float = 20.0, z: float = 1.96, min_labels: int = 5) -> DataFrame:
    """(host, template, bad_share) from rows of host, template, labelled and bad counts."""
    counts = templates.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
    units = merged_branches(counts, z, min_labels)
    joint = units.groupBy("host", "cls").agg(F.sum("m").alias("jm"), F.sum("b").alias("jb"))
    total = units.agg((F.sum("b") / F.nullif(F.sum("m"), F.lit(0))).alias("prior"))
    rows = units.join(joint, ["host", "cls"]).join(F.broadcast(total))  # one row
    return rows.select("host", "template", ((F.col("jb") + weight * F.col("prior")) / (F.col("jm") + weight)).alias("bad_share"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], reject_at: float = 0.5, **tree: float) -> DataFrame:
    """page_id, host, path, rule, verdict, template and bad_share per page.

    ``labels`` has a row (page_id, bad) per labelled page.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    marked = rows.join(labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")), "page_id", "left")
    paths = marked.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    templates = path_templates(paths, **tree)
    counted = templates.join(paths.drop("n"), ["host", "path"])
    verdicts = templates.select("host", "path", "template").join(template_purity(counted), ["host", "template"])
    said = listed(F.col("host"), F.col("path"), rules)
    out = rows.join(verdicts, ["host", "path"], "left").withColumn("said", said)
    by_template = F.when(F.col("bad_share") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("said.rule").alias("rule"), F.coalesce(F.col("said.verdict"), by_template).alias("verdict"), "template", "bad_share")
