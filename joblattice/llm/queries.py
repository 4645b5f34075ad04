"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collision_search, html_extract, infill, lattice_sampling, license_scan, near_dedup, packing, phrase_index, preference, quality, substring_dedup, token_alignment, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_groups(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_gumbel_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of each document, with the decoded round trip checked."""
    return lattice_sampling.digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), k=2)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), width=13)


def op5_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the only place that knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), length=2048, end_id=1)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents")))


def op8_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.pair_by_answer(_table(spark, sf_dir, "conversations")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends in the doc_id of its text; that document's labels are the page's."""
    pages = _table(spark, sf_dir, "pages")
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/0-9]*([?#].*)?/?([?#].*)?$', 1) AS bigint)")
    labels = _table(spark, sf_dir, "labels")
    bad = labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).where("bad IS NOT NULL")
    labelled = pages.select("page_id", number.alias("doc_id")).join(bad, "doc_id").select("page_id", "bad")
    return url_filter.judge(pages, labelled, URL_RULES)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_near_dedup, op3_gumbel_segmentation, op4_substring_dedup, op5_collision_search, op6_packing, op7_license_scan, op8_preference_chat, op9_html_extraction, op10_url_filter, op11_fill_in_middle, op12_decontamination, op13_token_alignment)}


_OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g
  FROM w, unnest(range(1, len(words) - 11)) AS r(i)
), firsts AS (
  SELECT g, min(doc_id) AS d FROM win GROUP BY g
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (
    SELECT win.doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN firsts USING (g) WHERE firsts.d < win.doc_id
  ) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(ks), 0) AS n_removed,
         list_filter(list_transform(range(1, len(words) + 1), lambda k: CASE WHEN list_contains(coalesce(ks, []), k) THEN NULL ELSE words[k] END), lambda x: x IS NOT NULL) AS left_over
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(left_over, ' ')) AS kept_sha256
FROM kept
"""


_OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 1], ' ') AS g FROM w, unnest(range(1, len(words))) AS r(i)
  UNION ALL
  SELECT doc_id, words[1] FROM w WHERE len(words) = 1
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM n
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept
FROM n JOIN reach ON reach.v = n.doc_id GROUP BY n.doc_id, n.n
"""


_OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations
), a AS (
  SELECT conv_id, max(i) FILTER (role = 'assistant') AS i FROM c GROUP BY conv_id
), t AS (
  SELECT conv_id AS pair_id, 0 AS side, role, text, i FROM c
  UNION ALL
  SELECT c.conv_id, 1, role, text, c.i FROM c JOIN a USING (conv_id) WHERE a.i IS NULL OR c.i < a.i
  UNION ALL
  SELECT a.conv_id, 1, c.role, c.text, a.i FROM a JOIN a n ON n.conv_id = xor(a.conv_id, 1) JOIN c ON c.conv_id = n.conv_id AND c.i = n.i WHERE a.i IS NOT NULL
), p AS (
  SELECT DISTINCT pair_id FROM t
), both_sides AS (
  SELECT pair_id, i, max(role) FILTER (side = 0) AS cr, max(text) FILTER (side = 0) AS ct,
         max(role) FILTER (side = 1) AS rr, max(text) FILTER (side = 1) AS rt
  FROM t GROUP BY pair_id, i
), pre AS (
  SELECT pair_id, coalesce(min(i) FILTER (cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt) - 1, max(i)) AS n
  FROM both_sides GROUP BY pair_id
), r AS (
  SELECT t.*, pre.n, '<|' || role || '|>' || chr(10) || text || chr(10) AS s FROM t JOIN pre USING (pair_id)
), o AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM r
)
SELECT p.pair_id, any_value(pre.n)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (i <= o.n AND side = 0), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (i > o.n AND side = 0), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (i > o.n AND side = 1), '') AS rejected,
  coalesce(list({'start': (before + length(role) + 5)::INT, 'length': length(text)::INT} ORDER BY i) FILTER (i > o.n AND side = 0 AND role = 'assistant'), []) AS chosen_mask,
  coalesce(list({'start': (before + length(role) + 5)::INT, 'length': length(text)::INT} ORDER BY i) FILTER (i > o.n AND side = 1 AND role = 'assistant'), []) AS rejected_mask
FROM p JOIN pre USING (pair_id) JOIN o USING (pair_id) GROUP BY p.pair_id
"""


_OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                        ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM asked
), stood AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(k)
), found AS (
  SELECT doc_id, k, n, item_id FROM stood JOIN asked USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_decontamination": _OP12_SQL, "op11_fill_in_middle": _OP11_SQL, "op2_near_dedup": _OP2_SQL, "op4_substring_dedup": _OP4_SQL, "op7_license_scan": license_scan.summary_sql(), "op8_preference_chat": _OP8_SQL}
