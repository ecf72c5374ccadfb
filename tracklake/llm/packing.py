"""Packing documents into fixed-length sequences: first-fit decreasing on a tournament tree (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import in_batches, materialize, table
from tracklake.llm.tokens import encode_slices


class BinTree:
    """A tournament tree over bins in the order they were opened: each node has the most room of the bins below it."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """The first bin with room for `length`; the bin's room shrinks by it."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < length:
                i += 1
        place = i - self.size
        room[i] -= length
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return place


def pack_lengths(lengths: np.ndarray, capacity: int, full: float = 0.999) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); each id of each document lies in exactly one piece.

    Whole sequences of a long document are cut off first; what is left of each document is packed first-fit decreasing. Bins
    less full than `full` are opened again: their pieces, in order, are cut into full sequences, and the rest of these into
    sequences whose lengths are powers of two, so that nothing is padded but what `full` allows.
    """
    sequences, rest = [], []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            sequences.append([(d, start, capacity)])
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = BinTree(capacity, len(rest)), {}
    for n, d, start in rest:
        bins.setdefault(tree.first_fit(n), []).append((d, start, n))
    again = []
    for b in sorted(bins):
        used = sum(p[2] for p in bins[b])
        if used >= full * capacity:
            sequences.append(bins[b])
        else:
            again += bins[b]
    left = sum(p[2] for p in again)
    room, sequence = 0, None
    for d, start, n in again:
        while n:
            if not room:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                left -= room
                sequences.append(sequence := [])
            k = min(n, room)
            sequence.append((d, start, k))
            start, n, room = start + k, n - k, room - k
    return sequences


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoder(tokenizer_path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, held = [], [], 0
            for i, x in encode_slices(tokenizer_path, batch.column("text"), end):
                rows.append(i)
                ids.append(x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() + (b"\x02" if x.max() < 65536 else b"\x04"))
                held += len(ids[-1])
                if held >= 8 << 20:
                    yield _with_ids(batch, rows, ids)
                    rows, ids, held = [], [], 0
            if rows:
                yield _with_ids(batch, rows, ids)

    return encode


def _with_ids(batch: pa.RecordBatch, rows: list[int], ids: list[bytes]) -> pa.RecordBatch:
    kept = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([kept.column("group"), kept.column("doc_id"), pa.array(ids, pa.binary())], names=["group", "doc_id", "ids"])


def _ids(data: bytes) -> np.ndarray:
    """The last byte says how many bytes an id has."""
    return np.frombuffer(data, f"<u{data[-1]}", (len(data) - 1) // data[-1])


def _pack_group(capacity: int, with_ids: bool):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        found = rows.select(["doc_id", "ids"]).to_pylist()
        found.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]))  # whatever order the shuffle gave
        docs = [_ids(r["ids"]) for r in found]
        lengths, out = np.array([len(x) for x in docs], np.int64), []
        for s, pieces in enumerate(pack_lengths(lengths, capacity)):
            offset = 0
            for d, start, n in pieces:
                ids = docs[d][start : start + n].astype("<u4").tobytes()
                out.append((found[d]["doc_id"], start, n, zlib.crc32(ids), int(lengths[d]), (key[0].as_py() << 20) + s, offset, ids if with_ids else None))
                offset += n
        names = [c.split()[0] for c in _PIECES.split(", ")]
        columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))]
        if with_ids:
            names, columns = [*names, "ids"], [*columns, pa.array([o[-1] for o in out], pa.binary())]
        return pa.Table.from_arrays(columns, names=names)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 4_000_000, seed: int = 1, with_ids: bool = False, group_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids.

    Texts are encoded where they are read. Documents are dealt to groups by a seeded hash of doc id and text, so that a
    group has about `group_chars` characters, and each group is packed by itself; group_col names a column with numbers
    of the caller's own groups instead (say runs of a mix whose order is to last), each of about that size.
    A sequence id is the group's number times 2 ** 20 plus a count.

    Null and empty texts have one id, the end. A text longer than a sequence is cut. Rows with equal or null ids are
    packed one by one like others; where copies of one row alone would fill a group, all rows are dealt by numbers instead, which are kept with the ids in a written table.
    An empty table gives no pieces. Other columns aren't read, so names can't clash.
    A group is the most that a task holds: about `group_chars` characters, or one longer text.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    doc_id, schema, copies = F.col(id_col).cast("long").alias("doc_id"), "group long, doc_id long, ids binary", False
    if group_col:
        group = F.coalesce(F.col(group_col).cast("long"), F.lit(0))
    else:
        h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
        sizes = docs.select(h.alias("h"), (F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 16).alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.when(F.col("rows") > 1, F.col("n")))).first()
        groups, copies = F.lit(max(1, -(-total // group_chars))), (most or 0) > group_chars
        group = F.monotonically_increasing_id() if copies else F.pmod(h, groups).cast("long")
    rows = docs.select(group.alias("group"), doc_id, text)
    encoded = rows.transform(in_batches, _encoder(tokenizer_path, end), schema)
    if copies:
        # rows that are alike are told apart by numbers, which are written down before anything depends on them
        encoded = materialize(encoded, "pack-copies").withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "group"), groups).cast("long"))
    return encoded.groupBy("group").applyInArrow(_pack_group(capacity, with_ids), _PIECES + ", ids binary" * with_ids)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
