"""Queries that apply each operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, exact, hard_negatives, htmltext, jaccard, licenses, mixing, near, pii, quality, secret_scan, substring
from .common import ascii_lower, table, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query(
    "op1_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
marked AS (SELECT words.doc_id, word, p,
                  max(rep.s) OVER (PARTITION BY words.doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS hit
           FROM words LEFT JOIN rep ON rep.doc_id = words.doc_id AND rep.s = p),
done AS (SELECT doc_id, count(*) AS n_words, count(hit) AS n_removed,
                coalesce(string_agg(CASE WHEN hit IS NULL THEN word END, ' ' ORDER BY p), '') AS kept
         FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done ON d.doc_id = done.doc_id
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_order_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_pii_deobfuscation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op4_qgram_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_secret_ownership")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id",
        *map(count, secret_scan.BASE_KINDS),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
        verdict("live").alias("n_live"),
        verdict("example").alias("n_example"),
        secret_scan.judged(F.col("spans")).alias("verdicts"),
    )


@query("op6_license_notices")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("notices", lambda s: s["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("notices")).alias("labels"),
        "score",
        licenses.listed(F.filter("notices", lambda s: ~s["base"])).alias("fuzzy_notices"),
    )


@query("op7_html_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.main_text(table(spark, sf_dir, "pages"), keep=("url",))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query(
    "op8_exact_dedup",
    """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(ascii_lower(whole_text("text")), 256))
    out = exact.exact_dedup(docs, carry=("text_sha256",))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op9_temperature_mixing",
    r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('s:' || source, '') AS s, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')), 1)::BIGINT AS t FROM documents),
totals AS (SELECT s, sum(t)::BIGINT AS al, sum(t)::DOUBLE / (SELECT sum(t) FROM d)::DOUBLE AS share FROM d GROUP BY s),
b(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
                 pow((SELECT min(share) / max(share) FROM totals), (lo + hi) / 2 - 1) > 2.0 * (1 + 1e-12) AS flat
          FROM b WHERE step < 30)),
e AS (SELECT round(hi, 6) AS a FROM b WHERE step = 30),
z AS (SELECT a, sum(pow(share, a)) AS norm, max(share / pow(share, a)) AS cover, (SELECT sum(t) FROM d)::DOUBLE AS total FROM totals, e GROUP BY a),
plan AS (SELECT s, al, a, pow(share, a) / norm AS weight, round(pow(share, a) / norm * (total * cover * norm))::BIGINT AS budget,
                ceil(al / 200000.0)::BIGINT AS blocks FROM totals, z),
p AS (SELECT d.*, a, weight, budget, al, budget // al AS full_passes, budget % al AS rest,
             ('0x' || substr(md5('1:block:' || doc_id), 1, 15))::BIGINT % blocks AS block_no
      FROM d JOIN plan USING (s)),
q AS (SELECT *, sum(t) OVER (PARTITION BY s, block_no ORDER BY ('0x' || substr(md5('1:' || full_passes || ':' || doc_id), 1, 15))::BIGINT, doc_id
                             ROWS UNBOUNDED PRECEDING) AS before,
             sum(t) OVER (PARTITION BY s, block_no) AS in_block FROM p)
SELECT doc_id, CASE WHEN s <> '' THEN substr(s, 3) END AS source, t AS n_tokens, a AS exponent, round(weight, 9) AS weight, budget AS budget_tokens, block_no,
       (full_passes + CASE WHEN rest > 0 AND 2 * before - t <= 2 * floor(rest::DOUBLE * in_block::DOUBLE / al) THEN 1 ELSE 0 END)::BIGINT AS copies,
       ('0x' || substr(md5('1:0:' || s || ':' || block_no), 1, 15))::BIGINT AS block_key,
       ('0x' || substr(md5('1:0:' || doc_id), 1, 15))::BIGINT AS doc_key
FROM q
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    first = F.col("schedule")[0]
    return out.withColumns({"weight": F.round("weight", 9), "block_key": first["block_key"], "doc_key": first["doc_key"]}).drop("schedule")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs, model, score_col="score")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op11_phrase_collocations",
    r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS (SELECT lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS ph, count(*) AS a
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM p, (VALUES (1), (2), (3), (4)) v(m)) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, ph, a, string_split(ph, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
cut AS (SELECT c.lang, c.ph, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
        JOIN f x ON x.lang = c.lang AND x.ph = array_to_string(list_slice(w, 1, k), ' ')
        JOIN f y ON y.lang = c.lang AND y.ph = array_to_string(list_slice(w, k + 1, c.m), ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, s, s + j - 1), ' ') AS ph, max(a) AS longer
           FROM (SELECT *, unnest(range(1, m - j + 2)) AS s FROM c, (VALUES (2), (3)) v(j) WHERE m > j) GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.ph) AS rank, low.ph AS phrase, a, l, r, n, score
FROM low JOIN n ON n.lang = low.lang LEFT JOIN inside ON inside.lang = low.lang AND inside.ph = low.ph
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_hard_negatives",
    """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(v, F.col("vec_id") % 100 == 0)


@query(
    "op13_partenum_jaccard",
    r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
