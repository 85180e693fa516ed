"""The stages on a small corpus, each held against what the operator's brute-force version keeps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.decontam import normalise

from .test_near import brute_classes
from .texts import edited, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    g = random.Random(21)
    good = [prose(g, g.randint(40, 120)) for _ in range(150)]
    bench = [" ".join(prose(g, 30)) for _ in range(5)]
    rows, labels = [], []

    def add(text, kind, y=1):
        rows.append((len(rows), text, "en", "src0" if g.random() < 0.4 else f"src{g.randint(1, 4)}", len(text), kind))
        labels.append((len(labels), y, 0))

    for w in good:
        add(" ".join(w), "clean")
    for w in good[:20]:
        add(" ".join(w).title(), "exact")
    for w in good[20:40]:
        add(" ".join(edited(g, w, 1)), "near")
    for t in bench:
        w = prose(g, 60)
        add(" ".join(w[:30]) + " " + t + " " + " ".join(w[30:]), "leak")
    for _ in range(50):
        add(" ".join(x + "&&&" for x in prose(g, 60)), "junk", 0)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string").drop("kind").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_stages(spark, corpus):
    folder, rows, bench = corpus
    kind = {r[0]: r[5] for r in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "mixing" else None
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test")
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            assert sum(kind[i] == "junk" for i in kept[name]) <= 2 and sum(kind[i] != "junk" for i in kept[name]) >= 190
        if name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t.lower()] = max(i, last.get(t.lower(), -1))
            assert kept[name] == set(last.values())
        if name == "near_dedup":
            root = brute_classes(sorted(before.items()))
            assert kept[name] == set(root.values())
        if name == "decontamination":
            assert kept[name] == {i for i, t in before.items() if not any(normalise(b) in normalise(t) for b in bench)}
        if name == "mixing":
            assert kept[name] == kept["decontamination"] and docs.count() == len(kept[name])
    assert len(corpus_pipeline.STAGES) == 5


def test_run(spark, corpus):
    folder, rows, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[0] == "doc_id" and 120 <= got.count() <= 160 and got.filter("copies < 1").isEmpty()


EDGES = [
    (1, "a a b c d e f", "src", "x"),
    (1, "b b b c d e f g", "src", "x"),
    (2, "a a b c d e f", "src", "x"),
    (3, "c c c d e f g h", None, "x"),
    (3, "c c c d e f g h", None, "x"),
    (None, "a a b c d e f", "src", "x"),
    (None, "only here at all", None, None),
    (5, None, "src", "x"),
    (6, "", "src", "x"),
    (7, "long " * 30_000, "src", "x"),
]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """A folder with a documents table of odd rows, whose columns clash with names used inside, and an empty one."""
    folder = str(tmp_path_factory.mktemp("edges"))
    schema = "doc_id bigint, text string, source string, _score string"
    for name, rows in (("some", EDGES), ("none", [])):
        df = spark.createDataFrame([(*r[:3], r[3]) for r in rows], schema)
        df.withColumns({"_row": F.lit("r"), "_text": F.lit("t"), "class_id": F.lit(0), "key": F.lit(1)}).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "b b b c d e f g"), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize(
    ("stage", "lost"),
    [
        ("quality", []),
        ("exact_dedup", [(1, "a a b c d e f"), (3, "c c c d e f g h"), (None, "a a b c d e f"), (5, None)]),
        ("near_dedup", [(2, "a a b c d e f"), (3, "c c c d e f g h"), (None, "a a b c d e f"), (6, "")]),
        ("decontamination", [(1, "b b b c d e f g")]),
    ],
)
def test_odd_rows(spark, edges, stage, lost):
    docs = spark.read.parquet(f"{edges}/some.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, edges)
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert Counter(left) == Counter((r[0], r[1]) for r in EDGES) - Counter(lost)


def test_mix_of_odd_rows(spark, edges):
    got = corpus_pipeline.mix(spark, spark.read.parquet(f"{edges}/some.parquet"), edges).collect()
    assert len(got) == len(EDGES) and all(r["copies"] >= 1 and r["n_tokens"] >= 1 for r in got)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, edges, stage):
    docs = spark.read.parquet(f"{edges}/none.parquet")
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, edges).count() == 0


def test_numbers_stay_however_files_are_split(spark, tmp_path):
    """A row keeps its number if the plan is made for another number of cores; so the rows that a stage judges are those that it drops."""
    g = random.Random(4)
    spark.createDataFrame([(i, " ".join(prose(g, 20))) for i in range(3000)], "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    seen = []
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        rows, row = corpus_pipeline.numbered(spark.read.parquet(str(tmp_path / "d")))
        seen.append({r["doc_id"]: r[row] for r in rows.collect()})
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == 3000
    rows, row = corpus_pipeline.numbered(spark.range(100).withColumn("_row", F.lit(1)))
    assert row == "__row" and rows.select(row).distinct().count() == 100 and rows.columns == ["id", "_row", "__row"]


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [1000, 3])
def test_ids_beyond_the_limit(spark, how, limit):
    from plumbline.llm.common import only_ids, written

    docs = spark.range(500).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    ids = written(spark.range(0, 500, 7).toDF("i"), "ids")
    want = [i for i in range(500) if i % 50 and (i % 7 == 0) == (how == "left_semi")] + [None] * (10 if how == "left_anti" else 0)
    got = [r["doc_id"] for r in only_ids(docs, "doc_id", ids, how, limit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
