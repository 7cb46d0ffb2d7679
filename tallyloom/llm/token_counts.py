"""Token counts of the documents in flat, unindexed token files, found by their end-of-document ids.

A file is nothing but ids of a fixed width. It is cut into blocks that tasks
read by byte range and search with one vectorised comparison. Documents that
cross blocks are stitched by a prefix scan over one row a block: the last
separator before it and the number of separators before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, text
from .encode import encoder
from .records import _filesystem

#: Blocks that one task scans when it adds up the rows of a file's blocks; the sums of such groups are scanned next.
GROUP = 4096

CATALOGUE = "file string, ordinal long, doc_id long, n_bytes long"
BLOCKS = "file string, block long, begin long, tokens long, n_ends long, last_end long, ends array<long>"


def write_flat(docs: DataFrame, directory: str, tokenizer: str, separator: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes texts into flat files, one a task, each document followed by the separator.

    Returns the catalogue, kept as Parquet: which document is which one of which
    file; only files of attempts that ended well are in it. The files
    themselves hold no such thing. A null text is an empty one. The strings of
    special tokens are ordinary text here, so a text that spells the separator's
    doesn't hold it; a text that has its id in another way is refused.
    """
    top = np.iinfo(dtype).max
    if separator > top:
        raise ValueError(f"the separator doesn't fit {dtype}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own, out, at = TaskContext.get(), encoder(tokenizer, special=False), None, 0
        for part in text.slices(batches, "x"):
            if out is None:
                fs, where = _filesystem(directory)
                fs.create_dir(where, recursive=True)
                name = f"flat-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
                out, size = fs.open_output_stream(f"{where}/{name}"), 0
            ids, places = own(part.column("x"))
            if len(ids) and ids.max() > top:
                raise ValueError(f"an id doesn't fit {dtype}")
            if (ids == separator).any():
                raise ValueError("a text holds the separator")
            n = part.num_rows
            data = np.insert(ids, places[1:], separator).astype(dtype).tobytes()
            out.write(data)
            size += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{directory}/{name}"] * n, pa.string()), pa.array(np.arange(at, at + n)), part.column("k"), pa.array(np.full(n, size))], names=["file", "ordinal", "doc_id", "n_bytes"]
            )
            at += n
        if out is not None:
            out.close()

    return scratch.written(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("x")).mapInArrow(write, CATALOGUE), "catalogue")


def scan_blocks(files: DataFrame, separator: int, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """files(file, n_bytes) cut into blocks; of each block the places of its separators in the file. Kept as Parquet."""
    width = np.dtype(dtype).itemsize
    per = block_tokens * width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = _filesystem(row["file"])
                with fs.open_input_file(where) as f:
                    f.seek(row["block"] * per)
                    ids = np.frombuffer(f.read(min(per, row["n_bytes"] - row["block"] * per)), dtype)
                begin = row["block"] * block_tokens
                ends = np.flatnonzero(ids == separator) + begin
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]], pa.string()), pa.array([row["block"]], pa.int64()), pa.array([begin], pa.int64()), pa.array([len(ids)], pa.int64()),
                        pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "begin", "tokens", "n_ends", "last_end", "ends"],
                )

    blocks = (
        files.filter(F.col("n_bytes") >= width)
        .withColumn("n_bytes", F.col("n_bytes") - F.col("n_bytes") % width)
        .select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / per))).alias("block"))
        .repartition("file", "block")
    )
    return scratch.written(blocks.mapInArrow(scan, BLOCKS), "blocks")


def document_spans(blocks: DataFrame) -> DataFrame:
    """Stitches: a row for each document of each file, with its ordinal, its start, its tokens without the separator,
    and whether it ended. What follows the last separator of a file is a document that hasn't ended."""
    group = F.floor(F.col("block") / GROUP)
    small = blocks.select("file", "block", "begin", "tokens", "n_ends", "last_end", group.alias("grp"))
    # the prefix scan: first over groups of blocks, then within each group
    tops = small.groupBy("file", "grp").agg(F.sum("n_ends").alias("g_ends"), F.max("last_end").alias("g_last"), F.max("block").alias("g_block"))
    earlier = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        "file", "grp", F.coalesce(F.sum("g_ends").over(earlier), F.lit(0)).alias("g_before"), F.max("g_last").over(earlier).alias("g_carry"), F.max("g_block").over(Window.partitionBy("file")).alias("last_block")
    )
    within = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        small.withColumns({"w_before": F.coalesce(F.sum("n_ends").over(within), F.lit(0)), "w_carry": F.max("last_end").over(within)})
        .join(tops, ["file", "grp"])
        .select("file", "block", (F.col("g_before") + F.col("w_before")).alias("before"), (F.coalesce("w_carry", "g_carry", F.lit(-1)) + 1).alias("open"), "last_block")
    )
    full = blocks.join(scanned, ["file", "block"])
    size = F.col("begin") + F.col("tokens")
    starts = F.concat(F.array("open"), F.transform("ends", lambda x: x + 1))
    rows = full.select(
        "file", "before", "ends", starts.alias("starts"), (F.col("block") == F.col("last_block")).alias("last"), size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ends"))).alias("i")
    )
    start = F.get("starts", F.col("i").cast("int"))
    end = F.get("ends", F.col("i").cast("int"))
    ended = end.isNotNull()
    return rows.filter(ended | (F.col("last") & (start < F.col("size")))).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.coalesce(end, F.col("size")) - start).alias("n_tokens"), ended.alias("ended")
    )


def flat_files(spark: SparkSession, directory: str) -> DataFrame:
    """file and n_bytes of the files of a directory, listed by Spark's own reader without their contents."""
    files = spark.read.format("binaryFile").load(directory)
    return files.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def token_counts(docs: DataFrame, tokenizer: str, separator: int, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """Token counts of documents by way of flat files: written, scanned without an index, stitched, and named
    again by their places. Null and empty texts count 0 tokens; each row of a repeated doc_id counts by itself. A text is
    encoded as one piece, so memory follows the longest one; files are scanned in blocks."""
    catalogue = write_flat(docs, scratch.fresh_dir(docs.sparkSession, "flat"), tokenizer, separator, dtype)
    files = catalogue.groupBy("file").agg(F.max("n_bytes").alias("n_bytes"))
    spans = document_spans(scan_blocks(files, separator, dtype, block_tokens))
    return catalogue.select("file", "ordinal", "doc_id").join(spans, ["file", "ordinal"])
