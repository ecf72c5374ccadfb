"""Removing passages that occur more than once, by suffix automata of reference shards (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import WordHashes, if_few, in_batches, kgram_hashes, materialize, table

_GRAM = 8

_words = WordHashes()


class SuffixAutomaton:
    """Of several word sequences, each with a weight; tells how often a stretch of words occurs in all of them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        next_, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            q = next_[last].get(w)
            if q is not None and length[q] == length[last] + 1:  # the sequence so far is known as it is
                last = q
            elif q is not None:
                last = self._split(last, w, q)
            else:
                new = len(next_)
                next_.append({})
                length.append(length[last] + 1)
                count.append(0)
                link.append(0)
                p = last
                while p >= 0 and w not in next_[p]:
                    next_[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = next_[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = new
            count[last] += weight

    def _split(self, p: int, w: object, q: int) -> int:
        next_, link, length = self.next, self.link, self.length
        copy = len(next_)
        next_.append(dict(next_[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = copy
        while p >= 0 and next_[p].get(w) == q:
            next_[p][w] = copy
            p = link[p]
        return copy

    def finish(self) -> SuffixAutomaton:
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]
        return self

    def repeated(self, words: list, least: int) -> list[int]:
        """Where stretches of `least` words start that occur at least twice; by matching statistics along the words."""
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= least:
                state = self.link[state]
                matched = self.length[state]
            if matched >= least and self.count[state] >= 2:
                out.append(i - least + 1)
        return out


def _window_keys(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all word grams, and of each window of `least` words the least of its grams' hashes."""
    g = kgram_hashes(h, min(_GRAM, least))
    m, width, want = g, 1, least - min(_GRAM, least) + 1
    while 2 * width <= want:
        m, width = np.minimum(m[: len(m) - width], m[width:]), 2 * width
    return g, np.minimum(m[: len(m) - (want - width)], m[want - width :])


def _runs(m: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of chosen windows with one key: first and last."""
    if not chosen.any():
        return []
    cut = np.flatnonzero((m[1:] != m[:-1]) | (chosen[1:] != chosen[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.append(cut, len(m)) - 1
    return [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if chosen[a]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_ANCHOR = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])


def _anchors(least: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, sizes, keys, counts = batch.slice(at, 256), [], [], []
                for text in part.column(2).to_pylist():
                    words = text.encode().split()
                    sizes.append(0)
                    if len(words) < least:
                        continue
                    g, m = _window_keys(_words.of(words), least)
                    own, g = np.unique(m), np.sort(g)
                    keys.append(own.view(np.int64))
                    counts.append(np.searchsorted(g, own, "right") - np.searchsorted(g, own, "left"))
                    sizes[-1] = len(own)
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(flat[0]), pa.array(flat[1].astype(np.int32))], schema=_ANCHOR)

    return anchors


_SORTED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("text", pa.string()), ("keys", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64()))])


def _sorter(with_text: bool):
    """Documents without a shared key are done: nothing of them goes. The others keep their texts for the next steps."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, tie, text, keys, hot in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if keys or hot:
                        rows.append((doc_id, tie, None, None, None, text, keys, hot))
                    else:
                        words = text.encode().split()
                        kept = b" ".join(words)
                        rows.append((doc_id, tie, len(words), kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest(), None, None, None))
                yield _batch(rows, _SORTED)

    return sort


_CONTEXT = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32())])
_RUN = pa.schema([("ra", pa.int64()), ("rb", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


class _Second(WordHashes):
    """Hashes of words that know nothing of the first ones."""

    def hashed(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, 0x5BD1E995)


_second = _Second()


def _candidates(least: int, windows: bool):
    """Runs of windows with a repeated key, with their words; or, windows, runs of hot keys with 128-bit digests of the run and of each window."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _RUN if windows else _CONTEXT
        for batch in batches:
            rows, size = [], 0
            for doc_id, tie, text, keys, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                h = _words.of(words)
                m = _window_keys(h, least)[1].view(np.int64)
                chosen = np.isin(m, np.array((hot if windows else keys) or [], np.int64))
                if windows:
                    if chosen.any():
                        a, b = kgram_hashes(h, least).view(np.int64), kgram_hashes(_second.of(words), least).view(np.int64)
                        for first, last in _runs(m, chosen):
                            x, y = a[first : last + 1], b[first : last + 1]
                            whole = [int.from_bytes(hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest()[i : i + 8], "little", signed=True) for i in (0, 8)]
                            rows.append((*whole, doc_id, tie, first, last + least, x.tolist(), y.tolist()))
                            size += 60 + 16 * len(x)
                else:
                    for first, last in _runs(m, chosen):
                        context = b" ".join(words[first : last + least])
                        rows.append((int(m[first]), context, doc_id, tie, first))
                        size += len(context) + 40
                if size > 4 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)

    return candidates


_SPAN = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _spans(starts: list[int], least: int) -> list[tuple[int, int]]:
    """The words that windows with these ascending starts cover, as maximal spans."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + least)
        else:
            out.append((s, s + least))
    return out


def _matcher(least: int):
    """Rows sorted by key and words: a key's contexts are a shard of reference text; each is streamed through its automaton."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, out = None, {}, []

        def close() -> None:
            if not shard:
                return
            contexts = {c: c.split(b" ") for c in shard}
            if len(shard) == 1 and len(next(iter(shard.values()))) > 1:
                found = {c: range(len(w) - least + 1) for c, w in contexts.items()}  # one sequence, there several times
            else:
                automaton = SuffixAutomaton()
                for c, places in shard.items():
                    automaton.add(contexts[c], len(places))
                automaton.finish()
                found = {c: automaton.repeated(w, least) for c, w in contexts.items()}
            for c, places in shard.items():
                for a, b in _spans(list(found[c]), least):
                    out.extend((doc_id, tie, at + a, at + b) for doc_id, tie, at in places)

        for batch in batches:
            for k, words, doc_id, tie, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    key, shard = k, {}
                shard.setdefault(words, []).append((doc_id, tie, at))
            if len(out) > 8192:
                yield _batch(out, _SPAN)
                out = []
        close()
        yield _batch(out, _SPAN)

    return match


_FINAL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _remover(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    words = text.encode().split()
                    goes = np.zeros(len(words), bool)
                    for s in spans or []:
                        goes[s["start"] : s["stop"]] = True
                    kept = b" ".join([w for w, g in zip(words, goes.tolist(), strict=True) if not g])
                    rows.append((doc_id, len(words), int(goes.sum()), kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
                yield _batch(rows, _FINAL)

    return remove


def _schema(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 35, most_places: int = 1000, with_text: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept (the text that stays), kept_sha256.

    Words are runs of anything but [\\x20\\x09-\\x0D]. Every word goes that a window of `least` words covers whose words also start
    anywhere else, in another row or in this one. Null and empty texts have no words; texts with fewer than `least` words lose
    none. Repeated rows are each other's copies and lose what they share. Null ids are ids like others. An empty table
    gives no rows. Other columns aren't read.

    How: the key of a window is the least hash of its 8-word grams, so equal windows have equal keys, and neighbours mostly
    share one. Keys that occur once in the corpus are dropped. A run of windows with one key takes its words to that key's
    shard; the shard's suffix automaton, weighted with how often each sequence is there, tells which windows occur twice.
    The corpus is its own reference, so automata would grow with it if they were broadcast: they are built where a shard's text meets.
    A shard has at most `most_places` runs, whatever the corpus. Runs of keys that stand at more places are known by digests of two independent 64-bit
    word hashes: copies of a run are counted as one, and only the windows of different runs are counted, by their digests. Their places are
    found by joins (the digests are broadcast only if they are counted as few).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("doc_id", "text"))
    anchors = materialize(rows.select("doc_id", "tie", "text").transform(in_batches, _anchors(least), _schema(_ANCHOR)), "substring-anchors")
    repeated = materialize(anchors.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key", (F.col("n") > most_places).alias("often")), "substring-keys")
    # the table of keys is as large as the corpus; places of a hot key are spread by adaptive execution
    shared = anchors.select("doc_id", "tie", "key").join(repeated.hint("merge"), "key").groupBy("doc_id", "tie")
    pick = shared.agg(F.collect_set(F.when(~F.col("often"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("often"), F.col("key"))).alias("hot")).withColumnsRenamed({"doc_id": "s_id", "tie": "s_tie"})
    sorted_ = rows.join(pick, (F.col("tie") == F.col("s_tie")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left").select("doc_id", "tie", "text", "keys", "hot")
    sorted_ = materialize(sorted_.transform(in_batches, _sorter(with_text), _schema(_SORTED)), "substring-sorted")
    done = sorted_.where("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept", "kept_sha256")
    some = sorted_.where("text IS NOT NULL").select("doc_id", "tie", "text", "keys", "hot")
    contexts = some.where("size(keys) > 0").transform(in_batches, _candidates(least, False), _schema(_CONTEXT)).repartition("key").sortWithinPartitions("key", "words")
    spans = contexts.transform(in_batches, _matcher(least), _schema(_SPAN))
    runs = materialize(some.where("size(hot) > 0").transform(in_batches, _candidates(least, True), _schema(_RUN)), "substring-runs")
    # copies of a run are one row from here on; all windows of a run that is there twice are repeated
    kinds = materialize(runs.groupBy("ra", "rb").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "substring-kinds")
    copied = kinds.where("n > 1").select("ra", "rb")
    spans = spans.union(runs.select("ra", "rb", "doc_id", "tie", "start", "stop").join(if_few(copied), ["ra", "rb"]).select("doc_id", "tie", "start", "stop"))
    windows = kinds.select("n", F.explode(F.arrays_zip("a", "b")).alias("w")).groupBy("w.a", "w.b").agg(F.sum("n").alias("n"))
    twice = materialize(windows.where("n > 1").select("a", "b"), "substring-twice")
    single = runs.join(if_few(copied), ["ra", "rb"], "left_anti").select("doc_id", "tie", "start", F.posexplode(F.arrays_zip("a", "b")).alias("i", "w")).select("doc_id", "tie", (F.col("start") + F.col("i")).alias("start"), "w.a", "w.b")
    spans = spans.union(single.join(if_few(twice), ["a", "b"]).select("doc_id", "tie", "start", (F.col("start") + least).alias("stop")))
    marks = spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("tie").alias("s_tie"), "spans")
    cleaned = some.join(marks, (F.col("tie") == F.col("s_tie")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left").select("doc_id", "text", "spans").transform(in_batches, _remover(with_text), _schema(_FINAL))
    return done.union(cleaned).withColumnRenamed("doc_id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
