"""What the operators share: staged tables, size-checked filters, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a single 8- to 16-byte key that may be broadcast: at most some tens of MB.
BROADCAST_KEYS = 1_000_000

#: Rows of one key that may meet in one task.
HOT_ROWS = 1_000

#: Bits that ``maybe_in`` broadcasts at most, and bits in one row of them (what ``bitmap_construct_agg`` takes).
SLOTS, SLOTS_A_ROW = 1 << 28, 1 << 15

#: Buckets of the hashes that ``in_buckets`` deals; 32 bits of each are kept besides.
BUCKETS = 1 << 11

#: Texts in one Arrow batch.
TEXTS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage, outlives executors and has known size."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    fs, where = _file(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Steps:
    """Written tables of one operator's steps; they go when its result is written.

    Only for operators whose returned DataFrame reads none of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, scratch_dir(spark, "steps")

    def __enter__(self) -> Steps:
        return self

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        fs, where = _file(self.spark, self.path)
        fs.delete(where, True)


def checked_broadcast(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys, marked for broadcast only if a count shows that it is within ``limit`` rows."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def maybe_in(rows: DataFrame, at: list[Column], keys: DataFrame, flag: str = "_maybe") -> DataFrame:
    """``rows`` with a flag that is true if ``at`` is a row of the written table ``keys``: a bit for each hash is broadcast, 32 MB at most.

    It is never false for a key, so an exact join of the flagged rows can follow. How often it
    is true by mistake is the share of bits that are set.
    """
    size = min(SLOTS, max(SLOTS_A_ROW, 1 << (32 * keys.count()).bit_length()))
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(size))
    bits = keys.select(slot(*keys.columns).alias("s")).groupBy(F.floor(F.col("s") / SLOTS_A_ROW).alias("__slots"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("s") % SLOTS_A_ROW).alias("__bits"))
    tried = rows.withColumn("__slot", slot(*at)).withColumn("__slots", F.floor(F.col("__slot") / SLOTS_A_ROW)).join(F.broadcast(bits), "__slots", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(__slot % {SLOTS_A_ROW} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(__slot % 8 as int))")) != 0
    return tried.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop("__slot", "__slots", "__bits")


def only_ids(docs: DataFrame, id_col: str, ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``docs`` whose id is (``left_anti``: is not) in the written one-column table ``ids``.

    Up to ``limit`` ids are broadcast. With more, only rows whose id's bit is set meet the ids; most other texts stay where they are.
    """
    ids = ids.toDF("_only_id")
    if ids.count() <= limit:
        return docs.join(F.broadcast(ids), docs[id_col] == ids["_only_id"], how)
    tried = maybe_in(docs, [docs[id_col]], ids, "__maybe")
    maybe = tried.filter("__maybe").drop("__maybe")
    found = maybe.join(ids, maybe[id_col] == ids["_only_id"], how)
    return found if how == "left_semi" else found.unionByName(tried.filter("not __maybe").drop("__maybe"))


def split_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with the written table ``groups``, which has each key once and its number of rows in ``size``.

    Rows of a hot key stay where they are: those keys are broadcast. Hot is a key of more than
    ``HOT_ROWS`` rows and of more than a millionth of all rows, so there are never more than
    ``BROADCAST_KEYS`` of them, and no other key is a notable part of a task. All others meet by shuffle.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).collect()[0]
    limit = max(HOT_ROWS, (total or 0) // BROADCAST_KEYS)
    if (most or 0) <= limit:
        return rows.join(groups, on)
    large = groups.filter(F.col(size) > limit)
    there = rows.join(F.broadcast(large), on)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(groups.filter(F.col(size) <= limit), on)
    return rest.unionByName(there)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else. Texts of one-byte characters take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches that keep whole texts small in memory: at most TEXTS_PER_BATCH rows and 16 MB each.

    Spark reads these limits when the plan runs, so they are set for the session and stay; a session that has
    its own limit of up to TEXTS_PER_BATCH rows keeps it.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, TEXTS_PER_BATCH + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return df.mapInArrow(run, schema)


def arrow_texts(batches: Iterator, text: str = "_text") -> Iterator[tuple]:
    """Each Arrow batch with its texts as a list of str."""
    for batch in batches:
        yield batch, batch.column(text).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word (bytes or str), remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 14, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values of ``h``, the same wherever the run stands."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power(len(h))
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def in_buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ``keys`` by bucket, where each bucket ends in it, and the 32 bits of each that are kept, in this order.

    A table of many hashes is shuffled as a row for each bucket with four bytes a hash, not as a row for each. Some hashes become alike by that.
    """
    bucket = ((keys >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    return order, np.cumsum(np.bincount(bucket, minlength=BUCKETS)), keys[order].astype(np.uint32)


def slices(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of ``values`` between one of ``ends`` and the next."""
    return [values[a:z].tobytes() for a, z in zip([0, *ends.tolist()], ends.tolist())]
