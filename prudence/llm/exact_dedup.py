"""Exact deduplication: tree-merge of sorted digest runs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.llm.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ("text_sha256", "n_bytes", "check")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else; a text of ASCII alone takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, SHA-256 of the normalised text, and its length and a second hash that verify equality."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    return norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"))


def merged_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8, keep: str = "largest") -> DataFrame:
    """Merge the digest runs in rounds until one run per digest range is left.

    Level 0 sorts each task's digests into runs and merges equal ones before anything moves, so a digest of any
    number of rows leaves a task as one row per run. Round k merges the fan_in runs whose numbers agree above their
    last k digits to base fan_in (a binomial tree of higher degree). The struct that is kept makes Spark aggregate
    by sorting, so every merge reads sorted runs. Equal means equal digest, length and second hash.
    """
    best, known = (F.max, F.col("doc_id").isNotNull()) if keep == "largest" else (F.min, F.col("doc_id").isNull())
    level = rows.select(*KEY, F.struct(known.alias("known"), F.col("doc_id")).alias("kept"), F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"))
    left = runs
    while True:
        level = level.groupBy(*KEY, "run").agg(best("kept").alias("kept"), F.sum("n").alias("n"))
        if left == 1:
            return level.select(*KEY, F.col("kept.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        left = -(-left // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64, fan_in: int = 8, hot_groups: int = 1000) -> DataFrame:
    """Mark the copies of each text.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty. A null
    id loses to any other; a group of null ids alone has keep_id null and kept true. Rows repeated with the same id
    are all marked kept when their id stays; drop_copies() leaves one of them. An empty table gives an empty table,
    and further columns of docs are ignored.
    Groups of over one hot_groups-th of all rows, of which there can't be more than hot_groups, are joined back by
    broadcast, all others by a shuffle on the digest, where no key exceeds that share.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(merged_runs(rows, runs, fan_in, keep).where("group_size > 1"), "digest-groups")
    share = max(10_000, rows.count() // hot_groups)
    hot = F.broadcast(groups.where(F.col("group_size") > share))
    back = rows.join(hot, list(KEY)).unionByName(
        rows.join(hot, list(KEY), "left_anti").join(groups.where(F.col("group_size") <= share), list(KEY), "left"), allowMissingColumns=True
    )
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return back.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one for each text; columns as in docs.

    Rows repeated with the same id and text leave one row. Rows of one id with different texts are told apart by digest.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    marked = stored(exact_dedup(docs, **how), "marked")
    gone = marked.where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_digest")).distinct()
    out = docs.withColumn("_digest", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    out = out.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.col("_digest") == F.col("_gone_digest")), "left_anti")
    if not marked.where("kept AND group_size > 1").groupBy("text_sha256").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "_digest"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
