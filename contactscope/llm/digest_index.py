"""Exact deduplication against a persistent digest index.

The index is a Parquet table of the digests seen so far with the id of the row that stands for
each, bucketed and sorted by digest. New rows are grouped by digest, the groups are checked by a
sort-merge anti-join that reads the index bucket by bucket without shuffling it, and the digests
that are new are appended in the same buckets. ``compact`` rewrites the index to one sorted file
a bucket. The table lives in the shared folder, so a later session goes on from it.

Two texts are equal when they agree after every character 0x09 to 0x0D and 0x20 is deleted; the
digest is SHA-256 of what is left, in UTF-8. Defined results: null text counts as empty, and empty
texts equal each other; of equal rows the longest original text in code points stays, then the
smallest id, a missing id last; rows that repeat the id of the row that stays and are as long as
it are kept with it; rows of a text that the index has go, whatever their length. Extra columns are
passed by. An empty table gives an empty result and adds nothing.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactscope.llm.common import stored
from contactscope.sources.tables import shared_folder

BUCKETS = 64
GAPS = " \t\n\x0b\x0c\r"
_WIDE = "decimal(38,0)"
_TOP, _STEP = Decimal(2**63), Decimal(2**65)


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, lowercase hex; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), GAPS, "").cast("binary"), 256)


def _rank(text: Column, doc_id: Column) -> Column:
    """Larger for the row to keep: one fixed-width number, so that grouping can hash."""
    length = F.length(F.coalesce(text, F.lit(""))).cast(_WIDE)
    late = F.lit(_TOP).cast(_WIDE) - F.coalesce(doc_id.cast(_WIDE), F.lit(_TOP).cast(_WIDE))
    return length * F.lit(_STEP).cast(_WIDE) + late


class DigestIndex:
    """A digest index at ``path``; opened where it exists, created where it does not."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path or f"{shared_folder(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
        self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self._open()

    def _open(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id) rows that the index does not have."""
        (
            rows.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def compact(self, path: str) -> DigestIndex:
        """The same index at a new path, one sorted file a bucket."""
        fresh = DigestIndex(self.spark, path, self.buckets)
        fresh.append(self.table())
        return fresh

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Decide every row of ``docs`` and add its new digests to the index.

        One row per document: doc_id, keep_id, group_size (rows of the batch with this text), kept,
        text_sha256. ``keep_id`` is the row that stays; where the index had the text before, it is
        the id kept then, and no row of the batch is kept.
        """
        rows = docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            digest(F.col("text")).alias("digest"),
            _rank(F.col("text"), F.col("doc_id")).alias("rank"),
        )
        rows = stored(rows, "digests")
        groups = rows.groupBy("digest").agg(
            F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        late = F.pmod(F.col("best"), F.lit(_STEP).cast(_WIDE))
        chosen = F.when(late > 0, (F.lit(_TOP).cast(_WIDE) - late).cast("bigint"))
        groups = stored(groups.select("digest", "group_size", "best", chosen.alias("own_id")), "digest-groups")
        known = stored(
            self.table().hint("merge").join(groups.select("digest"), "digest", "left_semi"),
            "digests-known",
        )
        fresh = groups.hint("merge").join(self.table(), "digest", "left_anti")
        fresh = stored(fresh.select("digest", F.col("own_id").alias("keep_id")), "digests-fresh")
        self.append(fresh)
        groups = groups.join(known.withColumnRenamed("keep_id", "old_id").withColumn("old", F.lit(True)), "digest", "left")
        found = rows.join(groups, "digest")
        old = F.coalesce("old", F.lit(False))
        return found.select(
            "doc_id",
            F.when(old, F.col("old_id")).otherwise(F.col("own_id")).alias("keep_id"),
            "group_size",
            (~old & (F.col("rank") == F.col("best"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each text.

    Of rows that repeat an id and a text of one length, one arbitrary row stays; such rows can
    differ only in white space and in other columns.
    """
    index = index or DigestIndex(docs.sparkSession)
    names = docs.columns

    def key(doc_id: Column, hashed: Column) -> Column:
        return F.concat_ws(":", hashed, F.coalesce(doc_id.cast("string"), F.lit("none")))

    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        key(F.col("doc_id").cast("bigint"), digest(F.col("text"))).alias("_key"),
        _rank(F.col("text"), F.col("doc_id")).alias("_rank"),
    )
    kept = index.dedup(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    # Only a repeated id can give a key twice; the longest of its rows is the kept one. Both steps
    # need the rows by key, so the texts are shuffled once.
    found = marked.hint("merge").join(kept.distinct(), "_key")
    ranked = found.groupBy("_key").agg(F.max_by("_row", "_rank").alias("_row"))
    return ranked.select(*[F.col("_row").getField(c).alias(c) for c in names])
