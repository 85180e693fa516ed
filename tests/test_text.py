import re
import string
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import chunks, corpus
from plumbline.operators import documents as D

TEXTS = [
    "", "\n", "one line", "two\nlines\n", "a\r\nb\rc", "Étude à l'école. Ça va? Oui!", "?!.,;:", "para one\n\npara two\n\n\n\npara three", "x\x0by\x0cz\x1cw\x85v u",
    "A1 b_2 C3. 42! THE CAT sat on the mat", "   ", "word word Word", " nbsp em", "no terminators here\nat all", "ﬁ ｆｕｌｌ ١٢٣ x²",
]


def plain(text):
    words = re.findall(r"\b\w+\b", text.lower())
    n, c, counts = len(words), len(text), Counter(words)
    sentences = [len(re.findall(r"\b\w+\b", s)) for s in re.split(r"[.!?]", text) if s.strip()]
    syllables = sum(ch in "aeiouy" for ch in text.lower())
    div = lambda a, b: a / b if b else 0
    return {
        "num_lines": len(text.splitlines()), "num_words": n, "num_characters": c, "unique_words": len(counts), "avg_word_length": div(sum(map(len, words)), n),
        "typological_diversity": div(len(counts), n), "lexical_density": div(sum(len(w) > 3 for w in words), n), "longest_word": max(counts, key=len, default=""),
        "shortest_word": min(counts, key=len, default=""), "num_stop_words": sum(w in X.STOP_WORDS for w in words), "num_sentences": len(sentences),
        "avg_sentence_length": div(sum(sentences), len(sentences)), "punctuation_frequency": div(sum(ch in string.punctuation for ch in text), c),
        "capitalization_ratio": div(sum(ch.isupper() for ch in text), c), "whitespace_ratio": div(sum(ch.isspace() for ch in text), c),
        "flesch_kincaid_grade": 0.39 * n / len(sentences) + 11.8 * syllables / n - 15.59 if n and sentences else 0, "num_paragraphs": len(text.split("\n\n")),
        "size_bytes": len(text.encode()),
    }


def test_document_profile(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id int, text string")
    got = {r["doc_id"]: r for r in D.document_profile(df).collect()}
    for i, t in enumerate([*TEXTS, ""]):
        for k, v in plain(t).items():
            if k == "num_words" or "word" in k or k in ("typological_diversity", "lexical_density", "avg_sentence_length", "flesch_kincaid_grade"):
                if "²" in t:
                    continue  # digits that are no decimal numbers: words differ by design
            assert got[i][k] == pytest.approx(v), (t, k)


def test_words_of_a_document(spark):
    df = spark.createDataFrame([(1, "b a b c a b the"), (2, "")], "doc_id int, text string")
    assert [(r["rank"], r["word"], r["n"]) for r in D.top_words(df, 2).orderBy("rank").collect()] == [(1, "b", 3), (2, "a", 2)]
    assert [tuple(r) for r in D.stop_word_counts(df).collect()] == [(1, 3, 7)]


def test_header_and_body(spark):
    df = spark.createDataFrame([(" head --- body ",), ("no cut ",), ("--- only",), (" --- a --- b --- c",)], "t string")
    h, b = X.header_and_body(F.col("t"), "---")
    assert [tuple(r) for r in df.select(h, b).collect()] == [("head", "body"), (None, "no cut"), ("only", ""), ("a", "b")]


def test_keywords_prefer_rare_words(spark):
    df = spark.createDataFrame([(1, "common rare rare"), (2, "common other"), (3, "common")], "doc_id int, text string")
    got = {r["doc_id"]: r["keywords"] for r in corpus.keyword_lists(df, 1).collect()}
    assert got == {1: ["rare"], 2: ["other"], 3: ["common"]}


def test_language_is_learnt(spark):
    rows = [(i, "the cat and the dog were there with them", "en") for i in range(5)] + [(i + 5, "der Hund und die Katze waren nicht da", "de") for i in range(5)] + [(10, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r["doc_id"]: r["language"] for r in corpus.detect_language(df, corpus.train_language_model(df), corpus.language_priors(df)).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:-1]) and got[10] == "n/a"


def test_chunks_of_paragraphs():
    text = "a" * 200 + "\n\n" + "b" * 50 + "\n\n" + "c" * 290 + "\n\n" + ("d" * 100 + ". ") * 5
    got = list(chunks.split_text(text))
    assert got[0] == "a" * 200 + "\n\n" + "b" * 50 and got[1] == "c" * 290 and all(len(c) <= 300 for c in got)
    assert list(chunks.split_text("x" * 500)) == ["x" * 500] and list(chunks.split_text("")) == []


def test_chunks_overlap():
    got = list(chunks.split_text(" ".join(f"w{i:03}" for i in range(100)), 50, 12, (" ",)))
    assert all(a.split()[-2:] == b.split()[:2] for a, b in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_the_text(text, size, overlap):
    got = list(chunks.split_text(text, size, overlap, ("\n\n", "\n", ". ", " ", "")))
    assert all(0 < len(c) <= size and c == c.strip() for c in got)
    assert set("".join(got)) - set(" \n") == set(text) - set(" \n") or "." in text
    joined = re.sub(r"[ .\n]", "", "".join(got))
    kept = re.sub(r"[ .\n]", "", text)
    assert len(joined) >= len(kept)


def test_offsets_point_at_chunks(spark):
    texts = ["one. two. three " * 40, "p\n\n\n\nq\n\n" * 100, "same\n\nsame", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = chunks.chunk_offsets(df, size=60, overlap=10).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2}
    for r in got:
        if r["start"] is not None:
            assert texts[r["doc_id"]][r["start"] : r["end"] + 1] == r["chunk"]
    numbers = [r["chunk_no"] for r in got if r["doc_id"] == 0]
    assert sorted(numbers) == list(range(len(numbers)))
    plain_chunks = chunks.chunk_documents(df, size=60, overlap=10).select("doc_id", "chunk_no", "chunk")
    assert plain_chunks.exceptAll(chunks.chunk_offsets(df, size=60, overlap=10).select("doc_id", "chunk_no", "chunk")).isEmpty()
