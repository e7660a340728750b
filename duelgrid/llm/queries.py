"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.llm.decontaminate import find_benchmark
from duelgrid.llm.langid import fit_filters, predict_language
from duelgrid.llm.linededup import dedup_lines
from duelgrid.llm.lmscore import score_texts
from duelgrid.llm.mixing import mix_sources
from duelgrid.llm.phrases import mine_phrases
from duelgrid.llm.pipeline import run
from duelgrid.llm.repetition import repetition_quality, repetition_verdict
from duelgrid.llm.sharding import assign_shards
from duelgrid.llm.simhash import near_duplicate_components
from duelgrid.llm.spelling import count_words, spelling_variants
from duelgrid.llm.urlfilter import canonical, filter_urls, host_of, path_of
from duelgrid.llm.vectors import near_duplicate_vectors
from duelgrid.llm.weaklabel import score_quality

#: (verdict, host, path) of the URL rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Pages whose canonical URLs form the list of the URL filter: those of some sites, those with runs of symbols in the title,
#: and the half of the others whose md5 of the page_id begins with a digit below 8. Other spellings of these URLs, which no
#: rule or pattern of their own names, are found by the list alone.
SPAM_SITES, JUNK_TITLE, LISTED = r"(^|\.)(spam-farm|cheap-pills|casino-win)\.", r"<title>[^<]*[#*$%|]{3}", "8"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, its edits and place. Null and empty texts hold none. Empty tables give no rows; extra columns are not read."""
    return find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. Null texts count 8 bytes and are one group; repeated rows have slots of their own. Empty tables give no rows; extra columns are not read."""
    placed = assign_shards(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after lines shared by documents are dropped. Null and empty texts are one empty line. Empty tables give no rows; extra columns are not read."""
    kept = dedup_lines(_table(spark, sf_dir, "documents"), 10, 2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document. Null, empty and letterless texts are `und` with score 0; null langs teach nothing. Empty tables give no rows; extra columns are not read."""
    docs = _table(spark, sf_dir, "documents")
    filters = fit_filters(docs, ~held_out(4))
    return predict_language(docs, filters, [F.col("doc_id"), held_out(4).alias("held_out")])


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null texts have none; a null source is a source of its own, the last one. Empty tables give no rows; extra columns are not read."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document. Null and empty texts have no words and fail. Empty tables give no rows; extra columns are not read."""
    measured = repetition_quality(_table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & repetition_verdict())


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rules, else by the list. Null urls have an empty host and path and are allowed. Empty tables give no rows; extra columns are not read."""
    pages = _table(spark, sf_dir, "pages")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    chosen = F.coalesce(F.md5(F.col("page_id").cast("string").cast("binary")) < LISTED, F.lit(False))
    listed = host.rlike(SPAM_SITES) | F.coalesce(F.col("html"), F.lit("")).rlike(JUNK_TITLE) | chosen
    blocked = pages.where((host != "") & listed).select(canonical(host, path).alias("key"))
    return filter_urls(pages, URL_RULES, blocked)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and verdict of every document. Null texts and texts without words score 0 and are not kept. Empty tables give no rows; extra columns are not read."""
    return score_quality(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Texts without words have fingerprint zero and are linked like any other. Empty tables give no rows; extra columns are not read."""
    found = near_duplicate_components(_table(spark, sf_dir, "documents"), 3, 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of every document. Null texts are empty: their end is scored. Empty tables give no rows; extra columns are not read."""
    docs = _table(spark, sf_dir, "documents")
    scored = score_texts(docs, ~held_out(7))
    return scored.withColumn("held_out", held_out(7))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near words of every word of the documents. Null texts have no words; a null doc_id counts as an empty one. Empty tables give no rows; extra columns are not read."""
    return spelling_variants(count_words(_table(spark, sf_dir, "documents"), 6, slip_every=199), least_count=5, ratio=5)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language. Null texts are empty; a null lang is `und`. Empty tables give no rows; extra columns are not read."""
    return mine_phrases(_table(spark, sf_dir, "documents"), most_words=3, least=10, top=2000, covered_percent=50)


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Null, zero and unfinite vectors link with nothing; repeated rows are linked. Empty tables give no rows; extra columns are not read."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that the pipeline's stages keep; each stage states its handling of odd rows. Empty tables give no rows; extra columns are not read."""
    return run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_shards": op2_shards,
    "op3_line_dedup": op3_line_dedup,
    "op4_language": op4_language,
    "op5_mix": op5_mix,
    "op6_repetition": op6_repetition,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_lm_score": op10_lm_score,
    "op11_spelling": op11_spelling,
    "op12_phrases": op12_phrases,
    "op13_vectors": op13_vectors,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        long AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
        keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM long),
        shared AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        marked AS (SELECT d.doc_id, d.line, d.pos, s.k IS NOT NULL AND s.keeper <> d.doc_id AS gone FROM keyed d LEFT JOIN shared s ON d.k = s.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op7_urls": r"""
        WITH parts AS (SELECT page_id, url, html,
               translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        keyed AS (SELECT *, regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') AS k FROM parts),
        spam AS (SELECT DISTINCT k FROM keyed WHERE host <> '' AND (regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino-win)\.')
                  OR regexp_matches(coalesce(html, ''), '<title>[^<]*[#*$%|]{3}') OR coalesce(md5(page_id::VARCHAR) < '8', false))),
        rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, h, p)),
        fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                 FROM keyed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT d.page_id, d.host, d.path, f.rule,
               coalesce(f.verdict, CASE WHEN d.host <> '' AND d.k IN (SELECT k FROM spam) THEN 'block' ELSE 'allow' END) AS verdict
        FROM keyed d LEFT JOIN fits f USING (page_id)""",
    "op12_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
        lists AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
        placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
        trios AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM placed),
        one AS MATERIALIZED (SELECT lang, x, count(*) AS a FROM trios GROUP BY ALL),
        two AS MATERIALIZED (SELECT lang, x, y, count(*) AS a FROM trios WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        three AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS a FROM trios WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        words AS (SELECT lang, sum(a)::BIGINT AS n FROM one GROUP BY lang),
        cuts AS (SELECT t.lang, t.x || ' ' || t.y AS phrase, t.a, 1 AS k, p.a AS l, q.a AS r, t.x AS x, t.y AS y, NULL AS z FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
                 UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 1, p.a, q.a, t.x, t.y, t.z FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
                 UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 2, p.a, q.a, t.x, t.y, t.z FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
        scored AS (SELECT *, (a::HUGEINT * a * 1000000 // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
        best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
        longer AS (SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM three UNION ALL SELECT lang, y, z, a FROM three) GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN longer m ON b.z IS NULL AND m.lang = b.lang AND m.x = b.x AND m.y = b.y WHERE m.a IS NULL OR 100 * m.a < 50 * b.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, w.n, score FROM ranked JOIN words w USING (lang) WHERE rank <= 2000""",
    "op13_vectors": r"""
        WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
        reached AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reached r JOIN links l ON l.u = r.w),
        least AS (SELECT u, min(w) AS w FROM reached GROUP BY u),
        n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, least.w) AS component_id, vec_id = least(vec_id, least.w) AS kept
        FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN least ON least.u = vec_id""",
}
