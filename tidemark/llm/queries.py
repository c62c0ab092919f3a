"""The numbered queries: each operator over its whole table, with production parameters, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, jaccard_join, language_id, mixing, quality, quality_rules, token_store, toxicity, url_filter
from .common import fold

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _to_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(quality.score(docs, quality.fit(docs, _to_learn(spark, sf_dir))), 0.3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return language_id.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(toxicity.score(docs, toxicity.fit(docs, _to_learn(spark, sf_dir))), 0.5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES, url_filter.listed_table(spark)).drop("listed")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: each document's size, and its source's size and target."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the quality rules: the measures and the base rules."""
    return op10_quality_rules(spark, sf_dir).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_html_extraction": op6_html_extraction,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_token_output": op9_token_output,
    "op10_quality_rules": op10_quality_rules,
    "mixing_targets": mixing_targets,
    "quality_base": quality_base,
}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_RULES = ", ".join(f"('{e}', '{e.split('/', 1)[0]}', '/{e.split('/', 1)[1]}', '{v}')" for e, v in url_filter.RULES)
_IN = lambda some: ", ".join(f"('{x}')" for x in some)

#: In DuckDB.
ORACLE: dict[str, str] = {
    "op5_url_filter": f"""WITH e(entry, e_host, e_path, verdict) AS (VALUES {_RULES}),
 d(d) AS (VALUES {_IN(url_filter.LISTED_DOMAINS)}),
 l AS (SELECT w || '.' || d AS l_host, NULL AS l_path FROM d, (VALUES {_IN(url_filter.LISTED_WORDS)}) w(w)
  UNION ALL SELECT d, '/' || s || '/' || k FROM d, (VALUES {_IN(url_filter.LISTED_SECTIONS)}) s(s), range(0, {url_filter.LISTED_LAST + 1}, {url_filter.LISTED_STEP}) r(k)),
 p AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 u AS (SELECT DISTINCT host, path FROM p),
 f AS (SELECT host, path, max(struct_pack(n := length(entry), h := length(e_host), entry := entry, verdict := verdict)) AS best FROM u JOIN e ON (host = e_host OR suffix(host, '.' || e_host)) AND prefix(path, e_path) GROUP BY ALL),
 s AS (SELECT host, path, array_to_string(string_split(host, '.')[k:], '.') AS s FROM (SELECT host, path, unnest(range(1, 1 + len(string_split(host, '.')))) AS k FROM u WHERE host <> '')),
 h AS (SELECT DISTINCT host, path FROM s JOIN l ON s = l_host AND (l_path IS NULL OR l_path = regexp_replace(path, '(/|\\.html)$', '')))
 SELECT page_id, host, path, best.entry AS rule, coalesce(best.verdict, CASE WHEN h.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f USING (host, path) LEFT JOIN h USING (host, path)""",
    "op7_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 75 * (na.n + nb.n - i)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, 1 + greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
 dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
 m AS (SELECT doc_id, item, k, n FROM dw JOIN iw USING (n, s)),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
 t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    # sources rise until they are full, those with the least size for their weight first; the level is where the sum is met
    "mixing_targets": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, (ARRAY[3.0, 1.0, 2.0])[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w FROM d GROUP BY source),
 f AS (SELECT *, coalesce(sum(2 * n) OVER below, 0) AS filled, sum(w) OVER above AS free, 1.5 * sum(n) OVER () AS goal FROM s WHERE n > 0
  WINDOW below AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), above AS (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 l AS (SELECT arg_min((goal - filled) / free, n / w) FILTER ((goal - filled) / free < 2 * n / w) AS level FROM f)
 SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(2 * n, coalesce(level * w, 2 * n)), 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l""",
    "quality_base": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 x AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM x WHERE (doc_id, s) IN (SELECT doc_id, s FROM x GROUP BY ALL HAVING count(*) > 1)) GROUP BY doc_id),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
 SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(n, 0) > 30 * n_words AS base_failed FROM m LEFT JOIN r USING (doc_id)""",
}
