"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found by regular expressions; their positions come from the lengths of what
lies between them. The hash of each candidate's value is counted over distinct repositories and
owners: a value that many owners have, or that is in many repositories of more than one, is
a copied example; another one that looks random is taken for a live credential of its owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import split_join, whole_text, written

BASE_KINDS = ("assign", "access", "hex")
#: kind, pattern, group that has the value, least length of the value
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 or more begins where the run begins, so shorter runs need not be listed
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    # of the method's own: tokens whose prefix names their issuer
    ("issued", r"(?:gh[opsu]_|xox[abprs]-|sk_live_|eyJ)[A-Za-z0-9_.-]{20,}", 0, 20),
)
MATCH = "struct<rank:int,at:int,gap:bigint,length:bigint,value_hash:string,varied:boolean>"

#: A value of so many owners is an example, and so is one of fewer owners, but two, in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 5
#: A live-looking value has so many different characters.
LIVE_CHARACTERS = 8


def _matches(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Each match of one kind, in text order: how long it is, what lies before it (``gap``), and its value's hash if the value is long enough."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def match(p: Column, at: Column) -> Column:
        holds = F.char_length(p["value"]) >= least
        return F.struct(
            F.lit(rank).alias("rank"),
            at.alias("at"),
            F.char_length(p["gap"]).cast("bigint").alias("gap"),
            F.char_length(p["all"]).cast("bigint").alias("length"),
            F.when(holds, F.sha2(p["value"], 256)).alias("value_hash"),
            F.when(holds, F.size(F.array_distinct(F.split(p["value"], ""))) >= LIVE_CHARACTERS).alias("varied"),
        )

    return F.filter(F.transform(parts, match), lambda m: m["length"].isNotNull())  # the last gap has no match


def candidate_matches(text: Column) -> Column:
    """All matches of all kinds; each kind is in text order."""
    none = F.expr(f"cast(array() as array<{MATCH}>)")
    return F.concat(*(F.when(text.rlike(p), _matches(text, r, p, g, n)).otherwise(none) for r, (_, p, g, n) in enumerate(PATTERNS)))


def located(rows: DataFrame) -> DataFrame:
    """The matches of ``rows`` (_row, _owner, _repo, _matches) that hold, a row each, with their spans: lengths and gaps are summed along each text."""
    upto = Window.partitionBy("_row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.select("_row", "_owner", "_repo", F.explode("_matches").alias("m")).select("_row", "_owner", "_repo", "m.*")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).filter("value_hash is not null")
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in PATTERNS)), F.col("rank") + 1)
    return each.select("_row", "_owner", "_repo", (F.col("end") - F.col("length")).alias("start"), "rank", "end", kind.alias("kind"), "value_hash", "varied")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (start, end, kind, value_hash, owners, repos, verdict).

    Spans are in code points, end exclusive, by start and then by kind; values leave only as
    sha256. ``owners`` and ``repos`` count the distinct ones that have the value anywhere in the
    table (``repo_col`` None: each document is a repository). The verdict is ``example`` from
    ``EXAMPLE_OWNERS`` owners on, or from two owners and ``EXAMPLE_REPOS`` repositories on; else ``live``, or
    ``weak`` if the value has few different characters. All null owners count as one, and so do all
    null repositories. Null and empty texts have no spans; very long ones are scanned whole, and their matches are rows of their own
    until they have their positions. Repeated rows are each reported and add no owner. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\u0000")).alias("_owner"),
        F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit("\u0000")).alias("_repo"),
        whole_text(text_col).alias("_text"),
    )
    rows = written(rows.select("_id", "_owner", "_repo", candidate_matches(F.col("_text")).alias("_matches"), F.monotonically_increasing_id().alias("_row")), "secrets")
    found = F.exists("_matches", lambda m: m["value_hash"].isNotNull())
    with_any = rows.filter(found)
    each = written(located(with_any), "secret-spans")
    # rows of a value are reduced to its distinct owners and repositories before they meet
    each = each.withColumn("_h", F.col("value_hash"))
    distinct = each.groupBy("_h", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_k"))
    by_owner = distinct.groupBy("_h", "_owner").agg(F.count(F.lit(1)).alias("_n"), F.sum("_k").alias("_k"))
    counts = by_owner.groupBy("_h").agg(F.count(F.lit(1)).alias("owners"), F.sum("_n").alias("repos"), F.sum("_k").alias("_k"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= EXAMPLE_REPOS))
    verdict = F.when(copied, "example").when(F.col("varied"), "live").otherwise("weak")
    full = F.struct("start", "rank", "end", "kind", "value_hash", "owners", "repos", verdict.alias("verdict"))
    judged = split_join(each, written(counts, "secret-owners"), ["_h"], "_k").select("_row", full.alias("s"))
    back = judged.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    kind = dict(back.dtypes)["spans"]
    none = rows.filter(~found).select("_id", F.expr(f"cast(array() as {kind})").alias("spans"))
    return with_any.join(back, "_row").select("_id", "spans").unionByName(none).withColumnRenamed("_id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judged(spans: Column) -> Column:
    """start:end:owners:repos:verdict of each span, comma-joined."""
    each = lambda s: F.concat_ws(":", *(s[k].cast("string") for k in ("start", "end", "owners", "repos", "verdict")))
    return F.array_join(F.transform(spans, each), ",")
