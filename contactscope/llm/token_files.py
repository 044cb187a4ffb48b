"""Token counts from flat, unindexed token files by a separator scan.

A flat file is nothing but big-endian 16-bit token ids, every document followed by an end id. There is
no index: where documents begin is found by searching for the end id. Files are cut into blocks at
fixed token numbers, each block is searched as one array, and only its summary and its end places go
on. Documents that cross blocks are stitched by a prefix scan over the blocks of a file: the tokens
before a block, and the last end before it, give the start of its first document.

Defined results: null and empty texts are documents of 0 tokens; the end id's own string in a text is
ordinary text, so it never splits a document; tokens after a file's last end are one document that is
not ``complete``; an odd last byte is not a token; empty files and folders have no documents. Repeated
rows are documents of their own, and other columns than ``text`` are not read. Texts are encoded in
bounded runs, a very long one alone; a file holds ``FILE_DOCS`` documents and is read as one row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactscope.llm.common import only, text_runs
from contactscope.llm.tokens import END_OF_TEXT, VOCABULARY, batch_encoder
from contactscope.sources.tables import shared_folder

BLOCK_TOKENS = 1 << 19
FILE_DOCS = 16_384  # documents in one file at most


def _bodies(vocabulary: str, end_id: int):
    def run(batches):
        import pyarrow as pa

        encode = batch_encoder(vocabulary, special=False)
        head = bytes([end_id >> 8])
        for batch in text_runs(batches):
            ids, offsets = encode(batch.column("text"))
            raw = ids.astype(">u2").tobytes()
            cut = (2 * offsets).tolist()
            rows = [raw[a:b] + head for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["body"])

    return run


def write_flat(
    docs: DataFrame,
    path: str | None = None,
    vocabulary: str = VOCABULARY,
    end_id: int = END_OF_TEXT,
    file_docs: int = FILE_DOCS,
) -> str:
    """Write the documents' tokens as flat files through Spark's text sink; gives the folder.

    The sink puts its line separator after every row, which here is the low byte of the end id; so
    that byte must be ASCII, and ids must fit 16 bits.
    """
    if not 0 <= end_id < 1 << 16 or not 0 < end_id & 0xFF < 0x80:
        raise ValueError(f"the low byte of the end id must be ASCII: {end_id}")
    path = path or f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    bodies = only(docs, "text").select(F.col("text").cast("string").alias("text")).mapInArrow(
        _bodies(vocabulary, end_id), "body binary"
    )
    lines = bodies.select(F.col("body").cast("string").alias("value"))
    writer = lines.write.option("lineSep", chr(end_id & 0xFF)).option("compression", "none")
    writer.option("maxRecordsPerFile", file_docs).text(path)
    return path


def read_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block and tokens (bytes) of every flat file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    size = 2 * block_tokens
    files = files.where("length >= 2").select(
        name.alias("file"),
        "content",
        F.explode(F.expr(f"sequence(0L, (length div 2 * 2 - 1) div {size})")).alias("block"),
    )
    whole = F.expr("octet_length(content) div 2 * 2")
    at = (F.col("block") * size).cast("int")
    return files.select(
        "file", "block", F.substring("content", at + 1, F.least(F.lit(size), whole - at)).alias("tokens")
    )


def _ends(end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes, flat, cut = [], [], [0]
            for tokens in batch.column("tokens"):
                found = np.frombuffer(tokens.as_buffer(), ">u2")
                places = np.flatnonzero(found == end_id)
                sizes.append(len(found))
                flat.append(places)
                cut.append(cut[-1] + len(places))
            flat = np.concatenate(flat) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"),
                    batch.column("block"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int64())),
                ],
                ["file", "block", "n", "ends"],
            )

    return run


def count_documents(blocks: DataFrame, end_id: int = END_OF_TEXT) -> DataFrame:
    """One row per document: file, doc_no, start (token number), n_tokens, complete."""
    found = blocks.select("file", "block", "tokens").mapInArrow(
        _ends(end_id), "file string, block bigint, n bigint, ends array<bigint>"
    )
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # Each step of the scan is a sum or a maximum over the blocks before.
    found = found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("last", F.col("base") + F.try_element_at("ends", F.lit(-1)))
    found = found.withColumns(
        {
            "open": F.coalesce(F.max("last").over(before), F.lit(-1)) + 1,
            "docs": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
            "final": F.lead("block").over(in_file).isNull(),
        }
    )
    starts = F.concat(
        F.array("open"),
        F.transform("ends", lambda e: F.col("base") + e + 1),
    )
    stops = F.concat(
        F.transform("ends", lambda e: F.col("base") + e),
        F.when(F.col("final"), F.array(F.col("base") + F.col("n"))).otherwise(F.array().cast("array<bigint>")),
    )
    each = found.select(
        "file", "docs", "final", F.size("ends").alias("k"), starts.alias("starts"), F.posexplode(stops).alias("i", "stop")
    )
    each = each.select(
        "file",
        (F.col("docs") + F.col("i")).cast("bigint").alias("doc_no"),
        F.get("starts", F.col("i")).alias("start"),
        "stop",
        (F.col("i") < F.col("k")).alias("complete"),
    )
    return each.where("complete or stop > start").select(
        "file", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "complete"
    )
