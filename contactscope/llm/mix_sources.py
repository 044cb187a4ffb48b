"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents end to end, are packed into blocks of one fixed length. Every
source has a target, and so a number of slots; output shards of equal length draw how many of their
slots each source fills (a multinomial draw, conditioned on the totals so that the targets hold
exactly), slot j of a source is mapped to a block through the source's own pseudorandom permutation
of block numbers, and blocks are joined by (source, number). A second pass over a source, where the
target is above its size, uses another permutation. All draws are keyed hashes: reruns agree and a
lost executor recomputes the same.

Permutations are swap-or-not networks: each round maps x to (k - x) mod n or leaves it, by a hash of
the larger of the two, which is one-to-one on any n and needs no table.

Targets: sources by code point, a missing one last, weigh 3, 1, 2, repeating, and share ``share`` of
all sizes; none goes above ``cap`` times its size, and the excess is shared by weight among the rest.

Defined results: null text has size 0 and is never taken; a missing source is a source of its own;
repeated rows are separate documents; rows without an id are mixed like others; extra columns are
passed by. An empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.llm.common import ranked, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 128
BLOCKS_LEAST = 1000  # a source too small for so many blocks gets shorter ones
SHARD_SLOTS = 1024
ROUNDS = 24
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, another one for every key."""

    def step(acc: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(r, F.lit(1), *key), n)
        other = F.pmod(k - acc, n)
        coin = F.pmod(F.xxhash64(r, F.greatest(acc, other), *key), F.lit(2))
        return F.when(coin == 1, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), step)


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to sid, weight and target. One row a source goes through one task."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    named = sizes.withColumn("sid", F.row_number().over(by_name).cast("bigint"))
    named = named.withColumn(
        "weight", F.element_at(weights, ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    )
    most = F.col("source_size") * F.lit(float(cap))
    fill = Window.orderBy(most / F.col("weight"), "sid")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    filled = named.withColumn("level", level)
    filled = filled.withColumn("capped", F.col("level") >= most / F.col("weight"))
    even = F.min(F.when(~F.col("capped"), F.struct(most / F.col("weight"), "sid", "level")))
    filled = filled.withColumn("even", even.over(everything).getField("level"))
    return filled.select(
        "source",
        "sid",
        "source_size",
        "weight",
        F.when(F.col("capped"), most).otherwise(F.col("even") * F.col("weight")).alias("target"),
    )


class Mix:
    """One mix of ``docs``: its sources, documents, slots, and what each document gives."""

    def __init__(
        self,
        docs: DataFrame,
        share: float = SHARE,
        cap: float = CAP,
        block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS,
        seed: int = 0,
    ):
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        sized = docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
            F.xxhash64("doc_id", "source", text).alias("tie"),
        )
        sized = stored(sized, "mix-sizes")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        length = F.greatest(
            F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / BLOCKS_LEAST))
        ).cast("bigint")
        planned = targets(sizes, share, cap).withColumn("block", length)
        planned = planned.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
        slots = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")
        most = F.floor(F.col("blocks") * F.lit(float(cap)))
        slots = F.when(F.col("source_size") > 0, F.least(slots, most)).otherwise(F.lit(0))
        planned = planned.withColumn("slots", slots.cast("bigint"))
        through = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
        planned = planned.withColumn("base", F.coalesce(F.sum("slots").over(through), F.lit(0)))
        #: source, sid, source_size, weight, target, block, blocks, slots, base
        self.sources = stored(planned, "mix-sources")
        self.shard_slots, self.seed = shard_slots, seed

        known = self.sources.select(F.col("source").alias("_source"), "sid", "block", "blocks", "source_size", "target")
        placed = sized.join(known, sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
        rows = sized.count()
        #: doc_id, source, size, tie, sid, _rank, start (words of the source before it), ...
        self.placed = stored(
            ranked(placed, ["sid"], [F.col("doc_id"), F.col("tie")], {"start": "size"}, rows),
            "mix-placed",
        )

    def slots(self) -> DataFrame:
        """shard, slot, sid, block number, pass: every place of the output and what fills it."""
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
        chunks = self.sources.where("slots > 0").select(
            "sid",
            "blocks",
            "slots",
            "base",
            F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"),
        )
        # By number: rows this small would be dealt to one task otherwise, and grow there.
        tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = chunks.repartition(tasks, "sid", "chunk").select(
            "sid",
            "blocks",
            "base",
            F.explode(
                F.expr(f"sequence(chunk * {CHUNK}, least(slots, (chunk + 1) * {CHUNK}) - 1)")
            ).alias("j"),
        )
        each = each.withColumn("pass", F.expr("j div blocks"))
        seed = F.lit(self.seed)
        place = permuted(F.col("base") + F.col("j"), F.lit(max(1, total)), seed)
        block = permuted(F.expr("j % blocks"), F.col("blocks"), seed, F.col("sid"), F.col("pass"))
        return each.select(
            "sid", "pass", block.alias("number"), place.alias("_place")
        ).select(
            F.expr(f"_place div {self.shard_slots}").alias("shard"),
            F.expr(f"_place % {self.shard_slots}").alias("slot"),
            "sid",
            "number",
            "pass",
        )

    def shard_counts(self) -> DataFrame:
        """shard, sid, n: how many slots each source fills in each output shard."""
        return self.slots().groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))

    def parts(self) -> DataFrame:
        """Documents cut at block ends: sid, number, _rank, and the words from ``lo`` up to ``hi``."""
        last = F.col("start") + F.col("size") - 1
        cut = self.placed.where("size > 0").withColumn(
            "number",
            F.explode(F.sequence(F.expr("start div block"), F.floor(last / F.col("block")).cast("bigint"))),
        )
        lo = F.greatest(F.lit(0).cast("bigint"), F.col("number") * F.col("block") - F.col("start"))
        hi = F.least(F.col("size"), (F.col("number") + 1) * F.col("block") - F.col("start"))
        return cut.withColumns({"lo": lo, "hi": hi})

    def blocks(self) -> DataFrame:
        """The output: shard, slot, and the document parts (doc_id, words lo to hi) in it."""
        return self.slots().hint("merge").join(self.parts(), ["sid", "number"])

    def taken(self) -> DataFrame:
        """One row per document: doc_id, source, size, source_size, target, taken."""
        times = self.slots().groupBy("sid", "number").agg(F.count(F.lit(1)).alias("times"))
        words = (
            self.parts()
            .hint("merge")
            .join(times, ["sid", "number"])
            .groupBy("sid", "_rank")
            .agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        )
        return self.placed.hint("merge").join(words, ["sid", "_rank"], "left").select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row for each pass over a document, holding the words taken in it.

    A document taken whole keeps its text as it is; of others the taken words follow each other
    with single spaces. ``n_chars``, where the table has it, is the length of the new text.
    """
    names = docs.columns
    mix = Mix(docs, **how)
    ranges = (
        mix.blocks()
        .groupBy("sid", "_rank", "pass", "doc_id", "tie", "size")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.groupBy(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_id"),
        F.xxhash64("doc_id", "source", text).alias("_tie"),
    ).agg(*[F.first(F.col(f"`{c}`")).alias(f"_v_{c}") for c in names])
    met = ranges.hint("merge").join(
        texts, (F.coalesce("doc_id", F.lit(-1)) == F.col("_id")) & (F.col("tie") == F.col("_tie"))
    )
    words = F.regexp_extract_all("_v_text", F.lit(f"({WORD})"), F.lit(1))
    met = met.withColumn("_words", words)
    pieces = F.transform(
        "ranges", lambda r: F.slice("_words", r["lo"].cast("int") + 1, (r["hi"] - r["lo"]).cast("int"))
    )
    sizes = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["hi"] - r["lo"])
    new = F.when(sizes == F.col("size"), F.col("_v_text")).otherwise(
        F.array_join(F.flatten(pieces), " ")
    )
    met = met.withColumn("_new", new)
    out = {c: F.col(f"_v_{c}") for c in names} | {"text": F.col("_new")}
    if "n_chars" in names:
        out["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return met.select(*[out[c].alias(c) for c in names])
