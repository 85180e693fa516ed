"""Document profiles and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as X


def document_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = X.STOP_WORDS) -> DataFrame:
    """One row per document with all text measures: one projection, nothing is shuffled.

    A null text counts as an empty one.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), t.alias("t")).withColumn("low", F.lower("t"))
    base = base.withColumns({"w": X.words(F.col("t")), "full": F.regexp_replace("t", X.SPACE + "+", "")})
    base = base.withColumns({"n": F.size("w"), "c": F.char_length("t"), "u": F.size(F.array_distinct("w")), "ns": X.sentences(F.col("full")), "len": F.transform("w", F.char_length)})
    n, c, ns, t, low, w, length = (F.col(x) for x in ("n", "c", "ns", "t", "low", "w", "len"))
    vowels = c - F.char_length(F.translate(low, "aeiouy", ""))
    return base.select(
        F.col("_id").alias(id_col),
        X.num_lines(t).cast("bigint").alias("num_lines"),
        n.cast("bigint").alias("num_words"),
        c.cast("bigint").alias("num_characters"),
        X.ratio(F.char_length(F.array_join(w, "")), n).alias("avg_word_length"),
        F.col("u").cast("bigint").alias("unique_words"),
        X.ratio(F.col("u"), n).alias("typological_diversity"),
        X.ratio(F.size(F.filter(length, lambda x: x > 3)), n).alias("lexical_density"),
        X.word_of_length(w, length, F.array_max(length)).alias("longest_word"),
        X.word_of_length(w, length, F.array_min(length)).alias("shortest_word"),
        F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("bigint").alias("num_stop_words"),
        ns.cast("bigint").alias("num_sentences"),
        # a blank sentence has no words, and no word reaches over a sentence's end
        X.ratio(F.size(F.regexp_extract_all(t, F.lit(f"({X.WORD})"), 1)), ns).alias("avg_sentence_length"),
        X.ratio(c - F.char_length(F.translate(t, X.PUNCTUATION_SIGNS, "")), c).alias("punctuation_frequency"),
        X.ratio(X.matching(t, r"\p{Lu}"), c).alias("capitalization_ratio"),
        X.ratio(X.matching(t, r"\p{Nd}"), c).alias("digit_frequency"),
        X.ratio(c - F.char_length("full"), c).alias("whitespace_ratio"),
        X.flesch_kincaid_grade(n, ns, vowels).alias("flesch_kincaid_grade"),
        X.num_paragraphs(t).cast("bigint").alias("num_paragraphs"),
        F.octet_length(t).cast("bigint").alias("size_bytes"),
    )


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, num_words, num_lines, num_characters): what the record set of a document needs, without the other measures."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        id_col, F.regexp_count(F.lower(t), F.lit(X.WORD)).cast("bigint").alias("num_words"), X.num_lines(t).cast("bigint").alias("num_lines"), F.char_length(t).cast("bigint").alias("num_characters")
    )


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, n): counts are summed up within a task before they are shuffled."""
    return docs.select(id_col, F.explode(X.words(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))


def top_words(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, word, n): the k most frequent words of each document, equals by name."""
    w = W.partitionBy(id_col).orderBy(F.desc("n"), "word")
    return word_counts(docs, id_col, text_col).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stop_word_counts(docs: DataFrame, stop_words: tuple[str, ...] = X.STOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_stop_words, n_words), by a semi-join flag with the list of stop words, of fixed size."""
    stops = docs.sparkSession.createDataFrame([(w,) for w in stop_words], "word string").withColumn("stop", F.lit(1))
    flagged = word_counts(docs, id_col, text_col).join(F.broadcast(stops), "word", "left")
    return flagged.groupBy(id_col).agg(F.sum(F.coalesce("stop", F.lit(0)) * F.col("n")).alias("n_stop_words"), F.sum("n").alias("n_words"))
