"""Corpus jobs: TF-IDF keywords and language detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.session import written

from .documents import word_counts

#: Trigrams of the model that may be broadcast; a larger model is joined by shuffling.
BROADCAST_GRAMS = 500_000
#: A word in more documents than this, and in more than a millionth of all (document, word) pairs, has its rows joined where they are.
HOT_WORD = 10_000


def tfidf_keywords(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, word, score): the k words of highest tf * idf, equals by name; idf = ln((1 + N) / (1 + df)) + 1.

    Document frequencies are as many rows as there are words; they are joined on the word. Those of
    frequent words, a million at most, are broadcast, so no task gets all rows of one. Texts are read once.
    """
    counts = written(word_counts(docs, id_col, text_col), "word-counts")
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n_docs = docs.count()
    idf = df.select("word", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = written(idf, "word-weights")
    limit = max(HOT_WORD, counts.count() // 1_000_000)
    hot = F.broadcast(idf.filter(F.col("df") > limit).drop("df"))
    rest = counts.join(hot.select("word"), "word", "left_anti").join(idf.filter(F.col("df") <= limit).drop("df"), "word")
    scored = rest.unionByName(counts.join(hot, "word"))
    scored = scored.withColumn("score", F.round(F.col("n") * F.col("idf"), 6))
    w = W.partitionBy(id_col).orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "rank", "word", "score")


def keyword_lists(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keywords): the same as one array per document."""
    ranked = tfidf_keywords(docs, k, id_col, text_col)
    lists = ranked.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("r"))
    return lists.select(id_col, F.transform("r", lambda x: x["word"]).alias("keywords"))


def trigrams(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(*keys, gram, n): overlapping three-character pieces of the lower-cased text, counted."""
    grams = F.regexp_extract_all(F.lower(text_col), F.lit("(?s)(?=(...))"), 1)
    return docs.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))


def train_language_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, weight): log of the smoothed share of each trigram in each language, over that of an unseen one."""
    counts = trigrams(docs.filter(F.col(lang_col).isNotNull()).withColumnRenamed(lang_col, "lang"), ["lang"], text_col)
    return counts.select("lang", "gram", F.log(F.col("n") + 1).alias("weight"))


def language_priors(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, unseen): log of the smoothed share of an unseen trigram; a row per language."""
    n = F.greatest(F.char_length(text_col) - 2, F.lit(0))
    return docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg((-F.log(F.sum(n) + 10_000.0)).alias("unseen"))


def detect_language(docs: DataFrame, model: DataFrame, priors: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(id, language): the most likely language by its trigrams, ``n/a`` for a text without any.

    The model becomes a row for each trigram with a column for each language (the driver lists the languages, with their
    priors), which is broadcast if a count allows it; a document's trigrams then become sums by language where they are.
    """
    unseen = {r["lang"]: r["unseen"] for r in priors.collect()}
    langs = sorted(unseen)
    if not langs:
        return docs.select(id_col, F.lit("n/a").alias("language"))
    wide = model.groupBy("gram").agg(*(F.max(F.when(F.col("lang") == x, F.col("weight"))).alias(f"_w{i}") for i, x in enumerate(langs)))
    wide = written(wide, "language-model")
    wide = F.broadcast(wide) if wide.count() <= most_grams else wide
    grams = F.regexp_extract_all(F.lower(text_col), F.lit("(?s)(?=(...))"), 1)
    each = docs.select(F.col(id_col).alias("_id"), F.explode(grams).alias("gram")).join(wide, "gram", "left")
    sums = each.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(langs))))
    score = lambda i, x: F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.round(F.col(f"_s{i}") + F.col("_n") * F.lit(unseen[x]), 6).alias("score"), F.lit(x).alias("lang")))
    best = F.array_max(F.array_compact(F.array(*(score(i, x) for i, x in enumerate(langs)))))
    found = sums.select("_id", best["lang"].alias("language"))
    return docs.select(id_col).join(found, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("language", F.lit("n/a")).alias("language"))
