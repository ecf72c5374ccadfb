"""Packing whole documents into few fixed-length sequences by bin completion (operator 13)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.bin_completion import Packing, bin_completion
from tracklake.llm.common import if_few, in_batches, materialize, table
from tracklake.llm.tokens import encode_slices

#: A piece as it is cut: the task that did it, and how many pieces of its length that task had cut before.
_CUT = "part int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long"


def _cutter(tokenizer_path: str, end: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = [c.split()[0] for c in _CUT.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            doc_ids, rows, held = batch.column(0).to_pylist(), [], 0

            def out() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*(r[:7] for r in rows), strict=True), types, strict=True)]
                extra = [pa.array([r[7] for r in rows], pa.binary())] if with_ids else []
                return pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *["ids"] * with_ids])

            for i, ids in encode_slices(tokenizer_path, batch.column(1), end):
                ids, start = ids.astype("<u4"), 0
                for piece in range(-(-len(ids) // capacity)):
                    stop = start + (capacity if piece else (len(ids) - 1) % capacity + 1)
                    own = ids[start:stop].tobytes()
                    rows.append((part, int(seen[stop - start]), doc_ids[i], piece, start, stop - start, zlib.crc32(own), own))
                    seen[stop - start] += 1
                    start, held = stop, held + len(own) * with_ids
                if len(rows) >= 50_000 or held > 8 << 20:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return cut


class Places:
    """Where the r-th piece of a length goes in a packing: bins are numbered through the patterns, and a pattern's bins take that many pieces of the length each."""

    def __init__(self, packing: Packing):
        rows, bins, used = [], 0, Counter()
        for pattern, times in packing:
            offset = 0
            for n, same in groupby(pattern):
                each = len(list(same))
                rows.append((n, used[n], each, bins, offset))
                used[n] += each * times
                offset += n * each
            bins += times
        rows.sort()
        self.length, self.first, self.each, self.bin, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = self._keys(self.length, self.first)

    @staticmethod
    def _keys(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return length << 44 | rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces, by their lengths and their numbers among the pieces of that length."""
        at = np.searchsorted(self.key, self._keys(length, rank), "right") - 1
        turn = rank - self.first[at]
        return self.bin[at] + turn // self.each[at], self.offset[at] + turn % self.each[at] * length


def _placer(places: Places, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            bins, offsets = places.of(length, b.column("number").to_numpy())
            new = {"length": pa.array(length), "sequence_id": pa.array(bins), "offset": pa.array(offsets)}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names=names)

    return place


def pack_whole(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", nodes: int = 1_000, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids its ids.

    Texts are encoded where they are read. A document of up to `capacity` ids is one piece; a longer one is cut into pieces of `capacity` ids, the first of
    which has what is left over. Pieces are then counted by length: at most `capacity` numbers, whatever the table's size. Bin completion
    finds a packing of these counts (patterns of lengths, each with a number of sequences), and every piece finds its place in it by its
    number among the pieces of its length. So all pieces are packed together, while only narrow rows are shuffled: counts by length and
    task, and, if these are many, the pieces to join with them. A length that a third of the pieces have costs no task more than another.

    Null and empty texts have one id, the end. Repeated rows and equal or null ids are packed one by one like others. An empty table gives no pieces. Other columns
    aren't read, so names can't clash. A task holds a batch of texts, or one long text. What is sent to tasks is the packing: for each length that it uses,
    a row for each pattern that has it, and patterns are some three for each length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialize(rows.transform(in_batches, _cutter(tokenizer_path, end, capacity, with_ids), _CUT + ", ids binary" * with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    lengths = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        lengths[r.length] = r.n
    places = Places(bin_completion(lengths, capacity, nodes))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    numbered = pieces.join(if_few(before), ["part", "length"]).withColumn("number", F.col("rank") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return numbered.transform(in_batches, _placer(places, names), schema)


def op13_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_whole(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
