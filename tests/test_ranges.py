"""Files read by byte ranges: CSV with quoted line breaks, heads and digests."""

import csv
import hashlib
import random

import pytest

from plumbline.sources import files, quoted, ranges


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 300 bytes, so that records lie in several."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(path, rows, ending, encoding, quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, delimiter=";", lineterminator=ending, quoting=quoting).writerows(rows)


def odd_rows(g, n, name):
    texts = ["plain", "a\nb", 'say "hi"\n\nthere', "", "semi;colon", "é\n", "NA", '"', '\n"\n', "'q", " spaced ", "many\n" * 200]
    return [["id", "no te", "x"], *([f"{name}-{i}", g.choice(texts), g.choice(["1", "", "\n", "2;3"])] for i in range(n))]


@pytest.mark.parametrize(("ending", "encoding", "quoting"), [("\n", "ISO-8859-1", csv.QUOTE_MINIMAL), ("\r\n", "UTF-8", csv.QUOTE_ALL), ("\n", "UTF-8", csv.QUOTE_ALL)])
def test_like_the_reader_of_whole_files(spark, tmp_path, small_ranges, ending, encoding, quoting):
    g, n = random.Random(3), 0
    for k in range(3):
        rows = odd_rows(g, 150, k)
        n += len(rows) - 1
        write(tmp_path / f"f{k}.csv", rows, ending, encoding, quoting)
    got = quoted.read_quoted_csv(spark, str(tmp_path), ";", encoding=encoding)
    assert got.columns == ["id", "no te", "x"]
    assert plain(got) == plain(files.read_csv(spark, str(tmp_path), ";", encoding=encoding)) and got.count() == n
    assert quoted.ranges_of_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 30


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(quoted, "BROADCAST_RANGES", 0)  # and states by shuffle
    long = "line\n" * 2000
    write(tmp_path / "a.csv", [["a", "b"], ["1", long], ["2", long + '"x"'], ["3", "z"]], "\n", "UTF-8")
    (tmp_path / "b.csv").write_bytes(b'"a";"b\nc"\n4;5\n\n6\n7;8;9\n10;"open\nend')
    got = {r[0]: r[1] for r in quoted.read_quoted_csv(spark, str(tmp_path), ";", ["a", "b"], "UTF-8").collect()}
    assert got == {"1": long, "2": long + '"x"', "3": "z", "4": "5", "6": None, "10": got["10"]}
    assert quoted.read_quoted_csv(spark, str(tmp_path / "b.csv"), ";", encoding="UTF-8").columns == ["a", "b\nc"]


def test_empty_texts_and_odd_characters(spark, tmp_path, small_ranges):
    texts = ["", "\0", 'a\0"b', '"\0"', "\x01", "\x01a", "\x01\0", "\0a\x01b\n", '\0,"', "\ufeffx", "x" * 2000 + "\0"]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        f.write("id,t,u\n" + "".join(f'{i},"{t.replace(chr(34), chr(34) * 2)}",{"" if i % 2 else chr(34) * 2}\n' for i, t in enumerate(texts)))
    got = sorted(map(tuple, quoted.read_quoted_csv(spark, str(tmp_path), encoding="UTF-8", missing_tokens=False).collect()), key=lambda r: int(r[0]))
    assert got == [(str(i), t, None if i % 2 else "") for i, t in enumerate(texts)]


def test_cores_that_come_and_go(spark, tmp_path, monkeypatch):
    """More cores at the second scan would make smaller ranges, of which the first one knew nothing."""
    key, old = "spark.sql.leafNodeDefaultParallelism", spark.conf.get("spark.sql.files.openCostInBytes")
    write(tmp_path / "a.csv", [["id", "t"], *([str(i), "a\nb" * (i % 5)] for i in range(2000))], "\n", "UTF-8")
    dirs = quoted.scratch_dir

    def more_cores(spark, label):
        spark.conf.set(key, "64" if label == "records" else "4")
        return dirs(spark, label)

    monkeypatch.setattr(quoted, "scratch_dir", more_cores)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = quoted.read_quoted_csv(spark, str(tmp_path), ";", encoding="UTF-8").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
        spark.conf.unset(key)
    assert sorted(int(r["id"]) for r in got) == list(range(2000))


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert quoted.read_quoted_csv(spark, str(tmp_path), ";").columns == []
    (tmp_path / "b.csv").write_bytes(b"x;y\r\n")
    got = quoted.read_quoted_csv(spark, str(tmp_path), ";")
    assert got.columns == ["x", "y"] and got.count() == 0


def test_heads_parts_and_digests(spark, tmp_path):
    g = random.Random(1)
    data = {f"d{k % 3}/f{k}.bin": bytes(g.randrange(256) for _ in range(n)) for k, n in enumerate((0, 1, 10, 4096, 5000))}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    short = lambda p: p[len(str(tmp_path)) + 1 :]
    assert {short(r["path"]): bytes(r["content"]) for r in ranges.heads(spark, str(tmp_path), "*.bin", 7).collect()} == {k: v[:7] for k, v in data.items()}
    assert {short(r["path"]): (r["length"], r["content_sha256"]) for r in ranges.whole_digests(spark, f"file://{tmp_path}").collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    parts = lambda v: [hashlib.sha256(v[i : i + 1000]).hexdigest() for i in range(0, max(1, len(v)), 1000)]
    assert {short(r["path"]): (r["parts"], r["parts_sha256"]) for r in ranges.part_digests(spark, str(tmp_path), part=1000).collect()} == {k: (len(parts(v)), hashlib.sha256("".join(parts(v)).encode()).hexdigest()) for k, v in data.items()}
    assert ranges.heads(spark, str(tmp_path), "*.none").count() == 0


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large.csv", "wb") as f:
        f.write(b"a;b\n1;2\n")
        f.truncate(3 * 10**9)
    parts = ranges.part_digests(spark, str(tmp_path)).collect()[0]
    assert (parts["length"], parts["parts"]) == (3 * 10**9, -(-3 * 10**9 // ranges.PART))
    digest = files.digests(spark, str(tmp_path)).collect()[0]
    h = hashlib.sha256()
    with open(tmp_path / "large.csv", "rb") as f:
        while b := f.read(1 << 24):
            h.update(b)
    assert digest["content_sha256"] == h.hexdigest()
    assert files.detect_delimiters(spark, str(tmp_path)).collect()[0]["delimiter"] == ";"


def test_a_store_that_arrow_cannot_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(b"a|b\n1|2\n")
    assert not ranges.can_open("viewfs://store/in") and not ranges.can_open(str(tmp_path / "none"))
    monkeypatch.setattr(ranges, "can_open", lambda p: False)
    assert files.detect_delimiters(spark, str(tmp_path)).collect()[0]["delimiter"] == "|"
    assert files.digests(spark, str(tmp_path)).collect()[0]["content_sha256"] == hashlib.sha256(b"a|b\n1|2\n").hexdigest()
