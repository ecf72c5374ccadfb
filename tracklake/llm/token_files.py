"""Token-id output as patched frame-of-reference blocks (operator 10).

Files are Parquet tables, so that they go through the cluster's own committed writers. A row holds whole documents that
follow each other: the ids of the part before it (first), doc_ids, n_tokens, and a payload of blocks of at most `block`
ids with the index of the blocks' starts (block_starts). A block is, little-endian:

    n uint32 | least id uint32 | width uint8 | exceptions uint32 | packed low bits | exception places uint16 | exception high bits uint32

Packed are the low `width` bits of (id - least id), lowest bit first; the width is the one that the given percentile of
the differences needs, and what doesn't fit has its remaining high bits in the exception lists.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import in_batches, new_path, table
from tracklake.llm.tokens import encode_slices

_HEAD = struct.Struct("<IIBI")


def pack_block(ids: np.ndarray, percentile: float = 98.0) -> bytes:
    """One block, of 1 to 65,536 ids."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    at = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    return _HEAD.pack(len(ids), low, width, len(odd)) + _low_bits(rest, width) + odd.astype("<u2").tobytes() + (rest[odd] >> np.uint32(width % 32)).astype("<u4").tobytes()


def _low_bits(x: np.ndarray, width: int) -> bytes:
    """The low bits of each value, one value after the other."""
    if width in (16, 32):
        return x.astype(f"<u{width // 8}").tobytes()
    size = 2 if width < 16 else 4
    bits = np.unpackbits(x.astype(f"<u{size}").view(np.uint8).reshape(len(x), size), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def _from_low_bits(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    if width in (16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, at).astype(np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, (n * width + 7) // 8, at), bitorder="little", count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def unpack_block(data: bytes) -> np.ndarray:
    n, low, width, odd = _HEAD.unpack_from(data)
    at, size = _HEAD.size, (n * width + 7) // 8
    out = _from_low_bits(data, n, width, at)
    if odd:
        places = np.frombuffer(data, "<u2", odd, at + size)
        out[places] |= np.frombuffer(data, "<u4", odd, at + size + 2 * odd).astype(np.uint32) << np.uint32(width)
    return out + np.uint32(low)


#: One row of the files: documents of a part that follow each other, whole.
_WRITTEN = "part int, first long, doc_ids array<long>, n_tokens array<int>, block_starts array<int>, payload binary"
_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def pack_blocks(ids: np.ndarray, block: int, percentile: float) -> tuple[list[int], bytes]:
    """Where each block starts in the payload, and the payload."""
    blocks = [pack_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype(int).tolist()
    return starts, b"".join(blocks)


def unpack_blocks(starts: list[int], payload: bytes) -> np.ndarray:
    return np.concatenate([unpack_block(payload[a:b]) for a, b in zip(starts, [*starts[1:], len(payload)], strict=True)])


def _packer(tokenizer_path: str, end: int, block: int, percentile: float, row_ids: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, names, first = TaskContext.get().partitionId(), [c.split()[0] for c in _WRITTEN.split(", ")], 0
        doc_ids, ids = [], []

        def row() -> pa.RecordBatch:
            nonlocal first, doc_ids, ids
            whole, counts = np.concatenate(ids), [len(x) for x in ids]
            out = _batch([(part, first, doc_ids, counts, *pack_blocks(whole, block, percentile))], names, _TYPES)
            first, doc_ids, ids = first + len(whole), [], []
            return out

        for batch in batches:
            of = batch.column(0).to_pylist()
            held = sum(map(len, ids))
            for i, x in encode_slices(tokenizer_path, batch.column(1), end):
                doc_ids.append(of[i])
                ids.append(x)
                held += len(x)
                if held >= row_ids:
                    yield row()
                    held = 0
        if ids:
            yield row()

    return pack


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, percentile: float = 98.0, row_ids: int = 65_536) -> None:
    """Encodes every text, appends the id `end`, and writes all ids in ascending doc id order to `path` as packed blocks.

    Rows are dealt by ranges of (doc id, hash of the text), so parts follow each other in that order; rows with the same
    doc id come in the order of that hash, then of the text. A null text is an empty one: its only id is the end. A null
    doc id comes first. An empty table writes no blocks. Other columns aren't read, so their names can't clash.
    A row of the files holds whole documents, about `row_ids` ids or one longer document; so a task holds a batch of
    texts and one such row, and a lost task is done anew.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    rows.transform(in_batches, _packer(tokenizer_path, end, block, percentile, row_ids), _WRITTEN).write.option("compression", "zstd").parquet(path)


def _reader(with_ids: bool):
    last = ("ids", pa.binary()) if with_ids else ("ids_crc32", pa.int64())
    names, types = ["part", "doc_id", "start", "n_tokens", last[0]], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), last[1]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, at, found = unpack_blocks(r["block_starts"], r["payload"]).astype("<u4"), 0, []
                for doc_id, n in zip(r["doc_ids"], r["n_tokens"], strict=True):
                    own = ids[at : at + n]
                    found.append((r["part"], doc_id, r["first"] + at, n, own.tobytes() if with_ids else zlib.crc32(own)))
                    at += n
                yield _batch(found, names, types)

    return read


def read_documents(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Of every document, read from the files: doc_id, start (ids of all documents before it), n_tokens, and its ids as
    little-endian unsigned 32-bit integers, or without them their unsigned ids_crc32.

    Each row of the files is unpacked by itself. What is gathered is one number a part.
    """
    files = spark.read.schema(_WRITTEN).parquet(path)
    before = files.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    last = ("ids", "binary") if ids else ("ids_crc32", "long")
    found = files.transform(in_batches, _reader(ids), f"part int, doc_id long, start long, n_tokens long, {' '.join(last)}")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", last[0])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path, ids=False)
