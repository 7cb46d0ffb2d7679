"""Token-ID output as length-delimited binary records with masked checksums and a separate offset index.

A record is: the payload's length (8 bytes), the masked checksum of these 8
bytes (4), the payload, the masked checksum of the payload (4); all integers
little-endian, ids of 2 bytes each, or 4 if the vocabulary needs them. A checksum is crc32, rotated right by 15
bits, plus a constant, so that the checksum of data that hold checksums stays
meaningful. The index beside each data file has 25 bytes for each record:
offset, payload length, document id, and 1 if the id is known (0 if null).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text
from .encode import encoder

MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("known", "u1")])
BLOCK = 8 << 20

MANIFEST = "shard long, data string, idx string, first long, records long, tokens long, width int"
READ = "shard long, doc_id long, position long, shard_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(buf: memoryview | bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at a place, and where the next one begins. Raises on a wrong checksum or a cut record."""
    head = bytes(buf[at : at + 8])
    if len(buf) < at + 12:
        raise ValueError("the record is cut")
    if masked(head) != struct.unpack("<I", buf[at + 8 : at + 12])[0]:
        raise ValueError("the checksum of a record's length is wrong")
    end = at + 12 + struct.unpack("<Q", head)[0]
    if len(buf) < end + 4:
        raise ValueError("the record is cut")
    payload = bytes(buf[at + 12 : end])
    if masked(payload) != struct.unpack("<I", buf[end : end + 4])[0]:
        raise ValueError("the checksum of a record is wrong")
    return payload, end + 4


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, directory: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes texts and writes them in ascending order of id; returns the table of shards, which is itself kept as Parquet.

    A null text is an empty one, so its record holds the end id alone. Rows of
    equal id are ordered by text, null ids come first. Each task writes files
    named after its attempt, and only the attempt whose row is in the table of
    shards counts, so lost executors and repeated tasks leave no trace. An
    empty table has no shards. Other columns are left out. A text is encoded and
    framed as one piece, so memory follows the longest one. The directory may be
    any that pyarrow's file systems open and all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        own = encoder(tokenizer)
        end, width = np.array([end_id], own.dtype).tobytes(), np.dtype(own.dtype).itemsize
        out = None
        index, at, tokens, first = [], 0, 0, None
        for part in text.slices(batches, "x"):
            keys, (ids, places) = part.column("k").to_pylist(), own(part.column("x"))
            if out is None:
                fs, where = _filesystem(directory)
                fs.create_dir(where, recursive=True)
                name = f"{where}/records-{shard:06d}-{task.taskAttemptId()}"
                out, first = fs.open_output_stream(f"{name}.rec"), keys[0]
            rows = []
            for k, a, b in zip(keys, places[:-1], places[1:]):
                payload = ids[a:b].tobytes() + end
                index.append((at, len(payload), k or 0, k is not None))
                rows.append(frame(payload))
                at += len(rows[-1])
                tokens += len(payload) // width
            out.write(b"".join(rows))
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{name}.idx") as f:
            f.write(np.array(index, INDEX).tobytes())
        base = f"{directory}/{name.rpartition('/')[2]}"
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "data": f"{base}.rec", "idx": f"{base}.idx", "first": first, "records": len(index), "tokens": tokens, "width": width}],
            pa.schema([("shard", pa.int64()), ("data", pa.string()), ("idx", pa.string()), ("first", pa.int64()), ("records", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]),
        )

    ordered = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("x")).repartitionByRange(F.col("k")).sortWithinPartitions("k", "x")
    return scratch.written(ordered.mapInArrow(write, MANIFEST), "shards")


def read_records(shards: DataFrame) -> DataFrame:
    """Reads every shard's data file in blocks, checks each record against its checksums and the index, and gives
    a row for each record: shard, doc_id, position in the shard, ids before it in the shard, n_tokens and the crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = _filesystem(row["idx"])
                with fs.open_input_stream(where) as f:
                    index = np.frombuffer(f.read(), INDEX)
                fs, where = _filesystem(row["data"])
                counts, crcs, rest, i, at = [], [], b"", 0, 0
                with fs.open_input_stream(where) as f:
                    while i < len(index):
                        need = 16 + int(index["length"][i])
                        got = f.read(max(BLOCK, need - len(rest)))
                        rest, begin = rest + got, 0
                        while i < len(index) and len(rest) - begin >= 16 + int(index["length"][i]):
                            if at != index["offset"][i]:
                                raise ValueError("the index doesn't fit the data")
                            payload, end = unframe(rest, begin)
                            at, begin, i = at + end - begin, end, i + 1
                            ids = np.frombuffer(payload, f"<u{row['width']}")
                            counts.append(len(ids))
                            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if not got:
                            raise ValueError("the data file is cut")
                        rest = rest[begin:]
                n = np.array(counts, np.int64)
                if n.sum() != row["tokens"]:
                    raise ValueError("the shard holds another number of ids than were written")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), row["shard"])),
                        pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0),
                        pa.array(np.arange(len(n))),
                        pa.array(np.cumsum(n) - n),
                        pa.array(n),
                        pa.array(np.array(crcs, np.int64)),
                    ],
                    names=["shard", "doc_id", "position", "shard_start", "n_tokens", "ids_crc32"],
                )

    return shards.select("shard", "data", "idx", "tokens", "width").mapInArrow(read, READ)


#: Records that a shuffled read looks up at a time, in the order of their files.
LOOKED_UP = 1024


def read_shuffled(shards: DataFrame, seed: int) -> DataFrame:
    """Every record once, in an order that follows from a seed: (place, shard, position, doc_id, ids). place is a hash of seed, shard and position; partitions are
    ranges of it and each is sorted by it, so reading them one after another is a shuffle of all records, the same for every number of partitions.

    Only the offset indexes are read to deal the records out; a task then reads each of its records at its offset, some at a time in the order of their
    files, and checks lengths and checksums. Shards without records have no rows."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = _filesystem(row["idx"])
                with fs.open_input_stream(where) as f:
                    index = np.frombuffer(f.read(), INDEX)
                n = len(index)
                columns = [np.full(n, row["shard"]), np.arange(n), index["offset"].astype(np.int64), index["length"].astype(np.int64)]
                same = [pa.array([row[c]] * n, kind) for c, kind in (("data", pa.string()), ("width", pa.int32()))]
                ids = pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, *same], names=["shard", "position", "offset", "length", "doc_id", "data", "width"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, LOOKED_UP):
                part = batch.slice(a, LOOKED_UP)
                rows = part.select(["data", "offset", "length", "width"]).to_pylist()
                found, name, f = [None] * len(rows), None, None
                for i in sorted(range(len(rows)), key=lambda i: (rows[i]["data"], rows[i]["offset"])):
                    r = rows[i]
                    if r["data"] != name:
                        if f is not None:
                            f.close()
                        name, (fs, where) = r["data"], _filesystem(r["data"])
                        f = fs.open_input_file(where)
                    payload, end = unframe(f.read_at(r["length"] + 16, r["offset"]))
                    if end != r["length"] + 16:
                        raise ValueError("the index doesn't fit the data")
                    found[i] = np.frombuffer(payload, f"<u{r['width']}").astype(np.int64)
                if f is not None:
                    f.close()
                ends = np.concatenate([[0], np.cumsum([len(v) for v in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "shard", "position", "doc_id")), ids], names=["place", "shard", "position", "doc_id", "ids"])

    listed = shards.select("shard", "data", "idx", "width").mapInArrow(indexed, "shard long, position long, offset long, length long, doc_id long, data string, width int")
    placed = listed.withColumn("place", F.xxhash64(F.lit(seed), "shard", "position"))
    dealt = placed.repartitionByRange("place", "shard", "position").sortWithinPartitions("place", "shard", "position")
    return dealt.mapInArrow(read, "place long, shard long, position long, doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes and reads back; start counts the ids of all records before, over the shards in their order."""
    spark = docs.sparkSession
    shards = write_records(docs, scratch.fresh_dir(spark, "records"), tokenizer, end_id, id_col, text_col)
    n = shards.count()
    # a row a shard
    before = shards.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("before"))
    rows = read_records(shards.repartitionByRange(max(1, n), "shard"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "position")
