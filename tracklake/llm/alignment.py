"""Which tokens of two tokenizers cover the same bytes: alignment by a dangling-suffix transducer (operator 11)."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, starmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import in_batches, materialize, table
from tracklake.llm.tokens import _WS


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, which writes a byte as a character: printable Latin-1 as itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_tokens(pieces: list[str]) -> list[bytes]:
    """Bytes of each id of a piece vocabulary: U+2581 is a space, and <0xHH> a byte."""
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


class Transducer:
    """Reads two token streams over the same bytes and closes a group wherever tokens of both end.

    A state is which side leads, and the bytes by which it does: the dangling suffix. The side that doesn't lead gives the next token; where nothing
    dangles, a does. What a state and a token lead to is remembered. A state is one number: that of its bytes, twice, and one more if b leads.
    """

    bound = 300_000

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}
        self.residuals = [b""]
        self.next: tuple[dict, dict] = ({}, {})  # (state, token) -> state, or None where bytes differ; for tokens of a and of b

    def _state(self, residual: bytes, b_leads: bool) -> int:
        if residual not in self.numbers:
            self.numbers[residual] = len(self.residuals)
            self.residuals.append(residual)
        return 2 * self.numbers[residual] + (b_leads and bool(residual))

    def _step(self, side: int, state: int, token: int) -> int | None:
        own, residual = self.bytes[side][token], self.residuals[state >> 1]
        if own.startswith(residual):
            found = self._state(own[len(residual) :], bool(side))
        elif residual.startswith(own):
            found = self._state(residual[len(own) :], not side)
        else:
            found = None
        self.next[side][state, token] = found
        return found

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where groups end: (tokens of a so far, tokens of b so far). None where the streams' bytes differ."""
        if len(self.residuals) + len(self.next[0]) + len(self.next[1]) > self.bound:
            self.forget()
        (of_a, of_b), step = self.next, self._step
        i = j = state = 0
        out = []
        try:
            while True:
                if state & 1 or not state:
                    token = a[i]
                    i += 1
                    key = state, token
                    state = of_a[key] if key in of_a else step(0, state, token)
                else:
                    token = b[j]
                    j += 1
                    key = state, token
                    state = of_b[key] if key in of_b else step(1, state, token)
                if not state:
                    if state is None:
                        return None
                    out.append((i, j))
        except IndexError:  # one side has ended
            return out if i == len(a) and j == len(b) and not state else None


class _Numbers(dict):
    """Numbers of chunks, by when they were first met."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        self[chunk] = i = len(self)
        self.chars += len(chunk)
        self.fresh.append(chunk)
        return i


class Aligner:
    """Alignments of texts, by those of their chunks, which are remembered up to a bound.

    A chunk is white space and the words after it, up to the next white space at which both tokenizers are known to start a new token: the first by
    its pattern, the second because none of its pieces has that character after another one. Nothing dangles there, so the groups of a text
    are those of its chunks in a row.
    """

    def __init__(self, a_path: str, b_path: str, bound: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.bound = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), bound
        self.a.encode_special_tokens = True
        self.b_pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.transducer = Transducer(byte_level_tokens(self.a.get_vocab()), piece_tokens(self.b_pieces))
        inner = {(x, y) for p in self.b_pieces if not re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) for x, y in zip(p.replace("▁", " "), p.replace("▁", " ")[1:], strict=False)}
        spaces = [c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c)]
        breaks = "".join(c for c in spaces if not any(y == c and x != c for x, y in inner))
        if " " not in breaks:
            raise ValueError("the second tokenizer has pieces with a space after another character")
        others = "".join(c for c in spaces if c not in breaks)
        self.chunk = re.compile(f"[{_WS}]*[^{_WS}]+" + f"(?:[{others}][{_WS}]*[^{_WS}]*)*" * bool(others) + f"|[{_WS}]+")
        self.one_word = re.compile(f"[^{_WS}]+")
        self.space = self.b.piece_to_id("▁")
        a_bytes = self.transducer.bytes[0]
        self.a_spaced = np.array([t[:1] == b" " for t in a_bytes])
        # then a's tokens of any text have its bytes
        self.lossless = self.a.normalizer is None and {bytes([i]) for i in range(256)} <= set(a_bytes)
        self.a_text, self.b_text = list(map(str, range(len(a_bytes)))), list(map(str, range(len(self.b_pieces))))
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.strings: list[str] = []
        self.counts = np.empty((0, 3), np.int64)  # tokens of a and of b, groups; -1 where bytes differ
        self.keys, self.starts = np.empty(0, np.int64), np.zeros(1, np.int64)  # of each chunk's links: a's id times the number of b's ids, plus b's id

    def _a_ids(self, chunks: list[str]) -> list[list[int]]:
        """a's ids of chunks. Those of a space and a word are encoded in one text: each has one token that starts with a space, its first."""
        plain = [c[0] == " " and len(c) > 1 and self.one_word.fullmatch(c, 1) is not None for c in chunks]
        ids = self.a.encode_batch_fast(["".join(c for c, p in zip(chunks, plain, strict=True) if p)], add_special_tokens=False)[0].ids
        starts = np.flatnonzero(self.a_spaced[np.array(ids, np.int64)]).tolist()
        inner = map(ids.__getitem__, starmap(slice, zip(starts, [*starts[1:], len(ids)], strict=True)))
        outer = iter(self.a.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        return [next(inner) if p else next(outer).ids for p in plain]

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        if not fresh:
            return
        counts, keys, n, groups = [], [], len(self.b_pieces), self.transducer.groups
        a_text, b_text = self.a_text, self.b_text
        for k in range(0, len(fresh), 4000):
            some = fresh[k : k + 4000]
            # the second tokenizer adds a space: one is left out where there is one, else its token is dropped
            b_all = self.b.encode([c[1:] if c[0] == " " else c for c in some], num_threads=1)
            for chunk, a, b in zip(some, self._a_ids(some), b_all, strict=True):
                b = [self.space] if chunk == " " else b if chunk[0] == " " else b[1:]
                ends = groups(a, b)
                if ends is None or not self.lossless and b"".join(map(self.transducer.bytes[0].__getitem__, a)) != chunk.encode():
                    counts.append((-1, 0, 0))
                    keys.append(())
                    self.strings.append("")
                    continue
                counts.append((len(a), len(b), len(ends)))
                keys.append([a[i - 1] * n + b[j - 1] for i, j in ends])
                p, q, parts = 0, 0, []
                for i, j in ends:
                    own_a = a_text[a[p]] if i - p == 1 else ",".join([a_text[x] for x in a[p:i]])
                    own_b = b_text[b[q]] if j - q == 1 else ",".join([b_text[x] for x in b[q:j]])
                    parts.append(f"{own_a}|{own_b}")
                    p, q = i, j
                self.strings.append(";".join(parts))
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.keys = np.concatenate([self.keys, np.fromiter(chain.from_iterable(keys), np.int64, sizes.sum())])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, np.ndarray, str]]:
        """Of each text: tokens of a and of b, groups, the links' keys in order, and the groups as text; no tokens for empty texts and where bytes differ. What
        is new in the texts is learnt at once."""
        if len(self.known) > self.bound or self.known.chars > 16 * self.bound:
            self.forget()
        number = self.known.__getitem__
        places = []
        for text in texts:
            chunks = self.chunk.findall(f" {text}") if text else []
            places.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        self._learn()
        for at in places:
            own = self.counts[at]
            if len(at) and own[:, 0].min() >= 0:
                n = self.starts[at + 1] - self.starts[at]
                stop = np.cumsum(n)
                keys = self.keys[np.arange(stop[-1]) + np.repeat(self.starts[at] - (stop - n), n)]
                yield (*own.sum(axis=0).tolist(), keys, ";".join(map(self.strings.__getitem__, at.tolist())))
            else:
                yield 0, 0, 0, np.empty(0, np.int64), ""


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of paths and Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def _in_slices(by: Aligner, texts: pa.Array, chars: int = 500_000) -> Iterator[tuple[int, int, int, np.ndarray, str]]:
    """Alignments text by text; at most about `chars` characters are taken out of Arrow at a time, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + sizes[j] <= chars):
            n += sizes[j]
            j += 1
        yield from by.align(texts.slice(i, j - i).to_pylist())
        i = j


def _aligning(a_path: str, b_path: str, with_groups: bool):
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, pa.string()][: len(rows[0])], strict=True)], names=[*names, "groups"][: len(rows[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a_path, b_path)
        for batch in batches:
            rows, held = [], 0
            for doc_id, (n_a, n_b, n_groups, keys, groups) in zip(batch.column(0).to_pylist(), _in_slices(by, batch.column(1)), strict=True):
                digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                own, times = np.unique(keys, return_counts=True)
                rows.append((doc_id, n_a, n_b, n_groups, len(keys), digest, own.astype("<i8").tobytes(), times.astype("<u4").tobytes(), *[groups] * with_groups))
                held += 12 * len(own) + len(groups) * with_groups
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair is linked in a task's documents: one row a pair that can be linked, of which the vocabularies allow few."""
    counts: dict[int, int] = defaultdict(int)
    for batch in batches:
        keys = [np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()]
        times = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
        if sum(map(len, keys)):
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            for k, n in zip(own.tolist(), np.bincount(at, np.concatenate(times)).astype(np.int64).tolist(), strict=True):
                counts[k] += n
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["key", "n"])


def _scoring(pairs, names: list[str]):
    """pairs: a broadcast of the linked pairs' keys, sorted, their counts, and whether that is the highest of their b id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = pairs.value
        for batch in batches:
            sums, bests = [], []
            for keys, times in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True):
                at, n = np.searchsorted(known, np.frombuffer(keys, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)
                sums.append(int((counts[at] * n).sum()))
                bests.append(int(n[best[at]].sum()))
            new = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return run


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(a, b, n, best) of every id pair that is linked: how many links hold it, and whether that is the most that any pair of its b id has."""
    pairs = aligned.select("keys", "times").transform(in_batches, _counting, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.expr(f"key div {b_size}").alias("a"), F.expr(f"key % {b_size}").alias("b"), "n")
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with_groups its groups as text.

    Tokenizer a (byte-level, a tokenizers file) encodes a space and the text, b (a sentencepiece model, which adds the space itself) the text, both without
    special tokens. Byte offsets where tokens of both end cut the tokens into groups, written `a1,a2|b1;a3|b2,b3`. The two tokens that end at such an
    offset are a link. A pair's count is how many links of all documents hold it; n_best are a document's links whose count is the highest of
    their b id, ties included, and count_sum is the sum of its links' counts.

    Texts are encoded where they are read, and nothing of them is shuffled: each document keeps its pairs, with their number, in a written table, from
    which tasks add up counts. Of two tokens that end together one is a suffix of the other; so pairs are at most as many as the
    vocabularies' tokens have bytes together, some 700,000 here, whatever the corpus: that is what is collected, broadcast, and held by a task.

    Null and empty texts, and texts whose tokens' bytes differ from a space and the text (U+2581 in them, say), have no tokens: zeros, and '' for the groups.
    Every row is a document of its own, repeated ones too. An empty table gives no rows. Other columns aren't read, so names can't clash. A task holds
    one long text with its tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = materialize(rows.transform(in_batches, _aligning(a_path, b_path, with_groups), _ALIGNED + ", groups string" * with_groups), "aligned")
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    pairs = pair_counts(aligned, size).toArrow()
    keys = pairs.column("a").to_numpy() * size + pairs.column("b").to_numpy()
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((keys[order], pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(bool)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    schema = ", ".join(f"{n} {'string' if n.startswith('groups') else 'long'}" for n in names)
    return aligned.transform(in_batches, _scoring(held, names), schema)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return align_tokenizers(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
