"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import WordHashes, connected_components, in_batches, kgram_hashes, materialize, mix64, table

#: Multipliers of the two permutations of the 32-bit universe.
_SIGMA, _PI = (0x85EBCA6B, 0xC2B2AE35), (0x7FEB352D, 0x846CA68B)

_words: WordHashes = WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of a text as 64-bit hashes; of fewer words, all of them as one shingle."""
    words = (text or "").encode().lower().split()  # bytes.lower() takes A-Z, bytes.split() white space as contracted
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(kgram_hashes(_words.of(words), min(k, len(words))))


def _permute(x: np.ndarray, by: tuple[int, int]) -> np.ndarray:
    """A permutation of all 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(by[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(by[1])
    x ^= x >> np.uint32(16)
    return x


def signatures(elements: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash of many non-empty sets, laid end to end: coordinate k is the least pi((sigma(e) + k) mod 2 ** 32)."""
    out = np.empty((len(starts), length), np.uint32)
    ends = np.append(starts[1:], len(elements))
    i = 0
    while i < len(starts):  # pieces that stay in cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 65536, "right")))
        s, at = _permute(elements[starts[i] : ends[j - 1]], _SIGMA), starts[i:j] - starts[i]
        for k in range(length):
            out[i:j, k] = np.minimum.reduceat(_permute(s + np.uint32(k), _PI), at)
        i = j
    return out


#: Bits of an odd sketch.
_BITS = 512


def sketches(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Odd sketches of many sets, laid end to end: bit i says whether an odd number of elements hash to i.

    Each element that only one of two sets has flips one bit, so their sketches never differ in more bits than the sets
    differ in elements.
    """
    at = np.repeat(np.arange(len(sizes)) * _BITS, sizes) + (elements >> np.uint64(64 - _BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sizes) * _BITS) & 1).astype(np.uint8).reshape(len(sizes), _BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def _near(percent: int) -> str:
    """SQL: whether a pair can be linked for all that its sizes and odd sketches show; no linked pair fails it."""
    bits = " + ".join(f"bit_count(sketch[{i}] ^ sketch_a[{i}])" for i in range(_BITS // 64))
    return f"({bits}) * {100 + percent} <= (n_a + n_shingles) * {100 - percent} AND 100 * least(n_a, n_shingles) >= {percent} * greatest(n_a, n_shingles)"


def _signer(k: int, bands: int, rows: int):
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, k) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                found, sketch = [None] * len(sets), [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    a[full], b[full] = np.add.reduceat(mix64(flat), starts), np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    sig = signatures(flat.astype(np.uint32), starts, bands * rows).astype(np.uint64)
                    bits = sketches(flat, sizes[full])
                    sig = sig.reshape(len(full), bands, rows)
                    key = np.zeros((len(full), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                    for i, row, b_ in zip(full, key.view(np.int64), bits, strict=True):
                        found[i], sketch[i] = row, b_
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(found, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=names)

    return sign


def _verifier(k: int, percent: int):
    names, types = ["a", "b"], [pa.int64(), pa.int64()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, text of a, text of b), sorted by a: the links."""
        last, of_a = None, None
        for batch in batches:
            left, right = [], []
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if last != a:
                    last, of_a = a, shingles(batch.column(2)[i].as_py(), k)
                of_b = shingles(batch.column(3)[i].as_py(), k)
                both = np.concatenate([of_a, of_b])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common and 100 * common >= percent * (len(of_a) + len(of_b) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, types[0]), pa.array(right, types[1])], names=names)

    return verify


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 24, rows: int = 5) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    A-Z are lowered, words are runs of anything but [\\x20\\x09-\\x0D], and a document's set are its distinct shingles of
    `words` words (of fewer words, the whole sequence). Documents are linked if 100 * |A and B| >= percent * |A or B|;
    component_id is the least id reachable, and the row with that id is kept. Null, empty and blank texts have no set
    and link with nothing; so do rows with a null id (component null, kept). Of repeated rows with the kept id, each has kept true.
    An empty table gives no rows. Other columns aren't read.

    How: documents with one set form a class, represented by its least id. Signatures of bands * rows coordinates come
    from two permutations of the 32-bit universe, the second one shifted circularly by the coordinate's number. Classes
    that share a band meet in a bucket. Pairs within a bucket aren't all made: its first class (a hub) meets the others,
    in four bands, then in all; links are verified on the full sets and components follow. In buckets that still hold
    several components, classes outside of the first one meet the classes of other components. So no bucket is capped,
    and a group of copies takes a few pairs a member. Before its texts are fetched, a pair's odd sketches are compared,
    which rules out only pairs that can't be linked and leaves few that aren't.
    A pair at the threshold misses all bands with probability (1 - t ** rows) ** bands: below 1e-6 for the production 85 %, 1e-4 for 80 %.
    """
    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(rows_.transform(in_batches, _signer(words, bands, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"), "minhash-signed")
    one = ["n_shingles", "set_a", "set_b"]
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy(*one).agg(F.min("doc_id").alias("rep"))
    members = materialize(known.select("doc_id", *one).distinct().join(classes, one).select("doc_id", "rep"), "minhash-members")
    # an id with several texts stands for each of them: its classes are linked through the id
    shared = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    bound = members.join(shared.select("doc_id", "a"), "doc_id").select(F.col("a"), F.col("rep").alias("b")) if not shared.isEmpty() else None

    reps = known.join(classes.select(F.col("rep").alias("doc_id"), *one), ["doc_id", *one]).dropDuplicates(["doc_id", *one])
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "sketch", "bands"), "minhash-classes")
    in_bands = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    sizes = in_bands.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "minhash-sizes")  # joins of two tables, so that a large bucket's rows can be split
    buckets = materialize(in_bands.join(sizes, ["band", "hash"]).select("band", F.xxhash64("band", "hash").alias("bucket"), "rep"), "minhash-buckets")
    candidates = buckets.select("rep").distinct()
    texts = rows_.join(candidates.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    texts = materialize(texts, "minhash-texts")

    near = F.expr(_near(percent))

    def linked(pairs: DataFrame, so_far: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All links, with those of these pairs, and the components they make."""
        with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        found = both.transform(in_batches, _verifier(words, percent), "a long, b long")
        links = materialize(found if so_far is None else so_far.union(found), "minhash-links")
        return links, connected_components(links if bound is None else links.union(bound), "minhash-components")

    def unsettled(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with their components as labels."""
        seen = rows.drop("label").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        seen = materialize(seen, "minhash-labels")
        still = seen.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
        return materialize(seen.join(materialize(still, "minhash-still"), "bucket", "left_semi"), "minhash-active")

    def with_sets(rows: DataFrame) -> DataFrame:
        """Sizes and sketches come to the rows that need them only."""
        return materialize(rows.join(reps.select("rep", "n_shingles", "sketch"), "rep"), "minhash-sets")

    def with_hubs(rows: DataFrame) -> DataFrame:
        """Pairs of each bucket's first class, the hub, and its other classes."""
        rows = with_sets(rows)
        heads = rows.groupBy("bucket").agg(F.min("rep").alias("a")).join(rows.withColumnRenamed("rep", "a"), ["bucket", "a"])
        heads = heads.select("bucket", "a", F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"), F.col("label").alias("label_a"))
        return rows.join(materialize(heads, "minhash-hubs"), "bucket").where((F.col("a") < F.col("rep")) & (F.col("label") != F.col("label_a")) & near)

    # a few bands and one hub for each class: after that most groups are one component
    some = buckets.where("band < 4").withColumn("label", F.col("rep"))
    links, parts = linked(with_hubs(some).groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a")), None)
    active = unsettled(buckets, parts)
    if not active.isEmpty():
        links, parts = linked(with_hubs(active).select("a", F.col("rep").alias("b")).distinct(), links)
        active = unsettled(active, parts)
    if not active.isEmpty():
        # what is left: classes outside of a bucket's first component, with all others
        active = with_sets(active)
        least = active.groupBy("bucket").agg(F.min("label").alias("first"))
        rest = active.join(materialize(least, "minhash-first"), "bucket").where("label > first")
        rest = rest.select("bucket", "first", F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"), F.col("label").alias("label_a"))
        pairs = active.join(materialize(rest, "minhash-rest"), "bucket").where((F.col("label") != F.col("label_a")) & ((F.col("label") == F.col("first")) | (F.col("a") < F.col("rep"))) & near)
        links, parts = linked(pairs.select("a", F.col("rep").alias("b")).distinct(), links)
    parts = parts.withColumnRenamed("node", "rep")
    whole = members.join(parts, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)
