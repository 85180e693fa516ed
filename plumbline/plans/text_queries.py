"""Document statistics, keywords, languages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import chunks, corpus
from plumbline.operators import documents as D
from plumbline.plans.registry import query
from plumbline.session import table

RATIOS = (
    "avg_word_length", "typological_diversity", "lexical_density", "avg_sentence_length", "punctuation_frequency", "capitalization_ratio", "digit_frequency",
    "whitespace_ratio", "flesch_kincaid_grade",
)
_W = r"[\p{L}\p{N}_]+"
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
# white space and line breaks as RE2 spells them
_WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BR = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def _ratio(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0 END)::FLOAT::DOUBLE"


_COUNT = lambda p: f"c - length(regexp_replace(t, '{p}', '', 'g'))"
_WORDS = f"""
w AS (SELECT doc_id, word, p, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, p) AS lo, row_number() OVER (PARTITION BY doc_id ORDER BY length(word), p) AS sh
      FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM d)),
ws AS (SELECT doc_id, sum(length(word)) AS chars, count(DISTINCT word) AS uniques, count(*) FILTER (length(word) > 3) AS content, count(*) FILTER (word IN ({_STOPS})) AS stops,
              max(word) FILTER (lo = 1) AS longest, max(word) FILTER (sh = 1) AS shortest FROM w GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS ns, sum(len(regexp_extract_all(piece, '{_W}'))) AS sw
      FROM (SELECT doc_id, unnest(string_split_regex(t, '[.!?]')) AS piece FROM d) WHERE regexp_replace(piece, '{_WS}', '', 'g') <> '' GROUP BY doc_id)"""


@query(
    "document_profile",
    f"""
WITH d AS (SELECT doc_id, t, length(t) AS c, regexp_extract_all(lower(t), '{_W}') AS words FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
{_WORDS},
j AS (SELECT d.*, len(words) AS n, ws.*, coalesce(ns, 0) AS num_sentences, coalesce(sw, 0) AS sent_words, c - length(regexp_replace(lower(t), '[aeiouy]', '', 'g')) AS syl
      FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(regexp_replace(t, '(?:{_BR})\\z', ''), '{_BR}')) END AS num_lines, n AS num_words, c AS num_characters,
  {_ratio('chars', 'n')} AS avg_word_length, coalesce(uniques, 0) AS unique_words, {_ratio('uniques', 'n')} AS typological_diversity, {_ratio('content', 'n')} AS lexical_density,
  coalesce(longest, '') AS longest_word, coalesce(shortest, '') AS shortest_word, coalesce(stops, 0) AS num_stop_words, num_sentences, {_ratio('sent_words', 'num_sentences')} AS avg_sentence_length,
  {_ratio(_COUNT('[!-/:-@\\[-`{-~]'), 'c')} AS punctuation_frequency, {_ratio(_COUNT('\\p{Lu}'), 'c')} AS capitalization_ratio, {_ratio(_COUNT('\\p{Nd}'), 'c')} AS digit_frequency,
  {_ratio(_COUNT(_WS), 'c')} AS whitespace_ratio,
  (CASE WHEN n > 0 AND num_sentences > 0 THEN 0.39::DOUBLE * n / num_sentences + 11.8::DOUBLE * syl / n - 15.59::DOUBLE ELSE 0 END)::FLOAT::DOUBLE AS flesch_kincaid_grade,
  len(string_split(t, chr(10) || chr(10))) AS num_paragraphs, octet_length(encode(t)) AS size_bytes
FROM j""",
)
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.document_profile(table(spark, sf_dir, "documents"))
    return p.withColumns({r: F.col(r).cast("float").cast("double") for r in RATIOS})


@query(
    "top_words",
    f"""SELECT doc_id, rank::INT AS rank, word, n FROM (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank
FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM documents) GROUP BY doc_id, word)) WHERE rank <= 5""",
)
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_words(table(spark, sf_dir, "documents")).select("doc_id", "rank", "word", "n")


@query(
    "stop_words",
    f"""SELECT doc_id, count(*) FILTER (word IN ({_STOPS})) AS n_stop_words, count(*) AS n_words
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM documents) GROUP BY doc_id""",
)
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stop_word_counts(table(spark, sf_dir, "documents"))


@query(
    "word_totals_by_language",
    f"""SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM documents) GROUP BY lang, word""",
)
def word_totals_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.word_counts(table(spark, sf_dir, "documents"), id_col="lang")


_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^(?:{_WS})+', ''), '(?:{_WS})+$', '')"


@query(
    "header_body_split",
    f"""
WITH p AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') AS parts FROM documents)
SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN {_STRIP('parts[1]')} END AS header,
       CASE WHEN NOT contains(text, chr(10)) THEN {_STRIP('text')} WHEN len(parts) > 1 THEN {_STRIP('parts[2]')} ELSE '' END AS body FROM p""",
)
def header_body_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, body = X.header_and_body(F.col("text"), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", header.alias("header"), body.alias("body"))


_TFIDF = f"""
WITH c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM documents) GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM c GROUP BY word), t AS (SELECT count(*) AS total FROM documents),
s AS (SELECT doc_id, word, round(n * (ln((1 + total)::DOUBLE / (1 + df)) + 1), 6) AS score FROM c JOIN df USING (word), t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s)"""


@query("tfidf_keywords", _TFIDF + " SELECT doc_id, rank::INT AS rank, word, score::FLOAT::DOUBLE AS score FROM r WHERE rank <= 3")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corpus.tfidf_keywords(table(spark, sf_dir, "documents"))
    return got.withColumn("score", F.col("score").cast("float").cast("double"))


@query("keyword_lists", _TFIDF + " SELECT doc_id, string_agg(word, ',' ORDER BY rank) AS keywords FROM r WHERE rank <= 5 GROUP BY doc_id")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keyword_lists(table(spark, sf_dir, "documents"), 5).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(
    "detect_language",
    """
WITH g AS (SELECT doc_id, lang, substr(t, i, 3) AS gram FROM (SELECT doc_id, lang, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM documents)),
m AS (SELECT lang, gram, ln(count(*) + 1) AS weight FROM g GROUP BY lang, gram),
p AS (SELECT lang, -ln(sum(greatest(length(text) - 2, 0)) + 10000.0::DOUBLE) AS unseen FROM documents GROUP BY lang),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram), l AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
s AS (SELECT doc_id, m.lang, sum(n * weight) AS s FROM c JOIN m USING (gram) GROUP BY doc_id, m.lang),
k AS (SELECT doc_id, lang, round(s + total * unseen, 6) AS score FROM s JOIN l USING (doc_id) JOIN p USING (lang))
SELECT d.doc_id, coalesce(language, 'n/a') AS language FROM documents d LEFT JOIN (SELECT doc_id, arg_max(lang, (score, lang)) AS language FROM k GROUP BY doc_id) b USING (doc_id)""",
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return corpus.detect_language(docs, corpus.train_language_model(docs), corpus.language_priors(docs))


_KEPT = r"[\s.]+"  # of these, separators are made


@query(
    "chunk_documents",
    r"SELECT doc_id, sha256(regexp_replace(text, '[\s.]+', '', 'g')) AS content_sha256, 0 AS oversize FROM documents WHERE regexp_replace(text, '[\s.]+', '', 'g') <> ''",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without overlap: together they have all of the text but separators, and none that is too long could be cut."""
    got = chunks.chunk_documents(table(spark, sf_dir, "documents"), overlap=0)
    could_be_cut = (F.char_length("chunk") > 300) & F.col("chunk").rlike(r"\. |\n")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: F.regexp_replace(c["chunk"], _KEPT, "")), "")
    by = got.groupBy("doc_id").agg(F.sha2(whole, 256).alias("content_sha256"), F.count_if(could_be_cut).cast("int").alias("oversize"), (whole != "").alias("some"))
    return by.filter("some").drop("some")


@query("chunk_offsets", r"SELECT doc_id, sha256(text) AS text_sha256, 0 AS wrong, 0 AS unlocated, 0 AS misnumbered FROM documents WHERE regexp_matches(text, '[^\s.]')")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with overlap: each one that is a part of the text is found, what stands at its place is the chunk, and they are numbered from 0."""
    docs = table(spark, sf_dir, "documents")
    placed = chunks.chunk_offsets(docs).join(docs.select("doc_id", "text"), "doc_id")
    there = F.expr("substring(text, start + 1, end - start + 1)") == F.col("chunk")
    by = placed.groupBy("doc_id").agg(
        F.max(F.sha2("text", 256)).alias("text_sha256"),
        F.count_if(F.col("start").isNotNull() & ~there).cast("int").alias("wrong"),
        F.count_if(F.col("start").isNull() & F.contains("text", "chunk")).cast("int").alias("unlocated"),
        (F.max("chunk_no") + 1 - F.count_distinct("chunk_no")).cast("int").alias("misnumbered"),
        F.max(F.regexp_replace("chunk", _KEPT, "") != "").alias("some"),
    )
    return by.filter("some").drop("some")


@query(
    "page_chunks",
    r"SELECT page_id, sha256(regexp_replace(html, '\s+', '', 'g')) AS content_sha256, 0 AS oversize FROM pages WHERE html <> ''",
)
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the size and separators that long extracted texts get; as every character can be cut off, none is too long."""
    got = chunks.chunk_documents(table(spark, sf_dir, "pages"), "page_id", "html", 1000, 0, chunks.DEFAULT_SEPARATORS)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: F.regexp_replace(c["chunk"], r"\s+", "")), "")
    return got.groupBy("page_id").agg(F.sha2(whole, 256).alias("content_sha256"), F.count_if(F.char_length("chunk") > 1000).cast("int").alias("oversize"))
