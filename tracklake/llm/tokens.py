"""Token ids of whole texts, by the tokenizers library, for the packing and the token file operators."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: \s of the tokenizers' own patterns (Unicode white space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


_WS_CHARS = "".join(chr(c) for c in range(0x3001) if re.match(f"[{_WS}]", chr(c)))
#: White space for Python only.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: What makes splitting at single spaces and line ends wrong: other white space, and runs of white space.
_ODD = ["  ", " \n", "\n ", "\n\n", *(c for c in _WS_CHARS if c not in " \n")]


class _Chunks(dict):
    """Numbers of chunks, by when they were first met; fresh: those whose ids aren't known yet."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        self[chunk] = i = len(self)
        self.chars += len(chunk)
        self.fresh.append(chunk)
        return i


class ChunkTokenizer:
    """Encodes texts chunk by chunk and remembers chunks it has met, up to `bound` of them and 16 characters for each.

    A chunk is a run of white space and the word after it. Both tokenizers of this package start a new pre-token
    wherever white space follows a word, and none of their patterns looks behind, so the ids of a text are those of its
    chunks in a row; where a tokenizer drops white space, those of its words. tests/llm checks that against encoding
    whole texts.

    Chunks are known by keys: " " and a literal chunk; or a chunk of other white space and a word; or a word alone,
    which has one space before it. Literal are the first and the last chunk of a text, and those with several spaces.
    """

    def __init__(self, path: str, bound: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.drops_space = not self.tokenizer.encode(" \n", add_special_tokens=False).ids
        self.marks = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.marks[i] = token.endswith("</w>") if self.drops_space else token[0] in "\u0120\u010a"  # space and line end as the vocabulary writes them
        self.forget()

    def forget(self) -> None:
        self.known = _Chunks()
        self.ids, self.starts, self.met = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _forget_rare(self) -> None:
        """Keeps the chunks of up to 64 characters that were met more than once, at most half of the bound."""
        keys = list(self.known)
        kept = np.array([k for k in np.flatnonzero(self.met > 1).tolist() if len(keys[k]) <= 64][: self.bound // 2], np.int64)
        n = (self.starts[1:] - self.starts[:-1])[kept]
        stop = np.cumsum(n)
        ids = self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.starts[kept] - (stop - n), n)]
        self.forget()
        for k in kept.tolist():
            self.known[keys[k]]
        self.known.fresh = []
        self.ids, self.starts, self.met = ids, np.concatenate([self.starts, stop]), np.ones(len(kept), np.int64)

    def _keys(self, text: str) -> list[str]:
        if self.drops_space:
            return text.split() if not any(c in text for c in _NOT_SPACE) else [c.lstrip(_WS_CHARS) for c in _CHUNK.findall(text) if c.strip(_WS_CHARS)]
        if not text:
            return []
        if text[0] not in " \n" and text[-1] not in " \n" and not any(c in text for c in _ODD):
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = f" {keys[0]}"
            return keys
        chunks = _CHUNK.findall(text)
        inner = [f" {c}" if c[:2] == "  " or c[0] == " " and c[1] in _WS_CHARS else c[1:] if c[0] == " " else c for c in chunks[1:-1]]
        return [f" {chunks[0]}", *inner, *[f" {c}" for c in chunks[1:][-1:]]]

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        values, lengths = [self.ids], [self.starts[-1:]]
        for i in range(0, len(fresh), 4096):
            keys = fresh[i : i + 4096]
            is_inner = [self._is_plain(k) for k in keys]
            inner = [k for k, p in zip(keys, is_inner, strict=True) if p]
            # each has one token that marks it: its first, which has the space, or its last, which ends the word
            text = " ".join(["", *inner]).replace(" \n", "\n")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.marks[ids])
            n = np.diff(np.concatenate([[-1], at])) if self.drops_space else np.diff(np.append(at, len(ids)))
            if len(inner) < len(keys):
                outer = [k[1:] if k[0] == " " else k if k[0] in _WS_CHARS or self.drops_space else f" {k}" for k, p in zip(keys, is_inner, strict=True) if not p]
                e = self.tokenizer.encode(outer, is_pretokenized=True, add_special_tokens=False)
                mask, both = np.array(is_inner), np.zeros(len(keys), np.int64)
                both[mask], both[~mask] = n, np.bincount(np.array(e.word_ids, np.int64), minlength=len(outer))
                whole, own = np.empty(both.sum(), np.uint32), np.repeat(mask, both)
                whole[own], whole[~own] = ids, np.array(e.ids, np.uint32)
                ids, n = whole, both
            values.append(ids)
            lengths.append(n)
        if fresh:
            self.ids = np.concatenate(values)
            self.starts = np.concatenate([self.starts[:-1], np.cumsum(np.concatenate(lengths))])

    def _is_plain(self, key: str) -> bool:
        """Whether a chunk has exactly one token with the mark: one white space character and a word; or letters alone."""
        if self.drops_space:
            return key.isalpha() and (key.isascii() or max(key) < "\u0130")
        return key[0] not in _WS_CHARS or key[0] == "\n" and key[1] not in _WS_CHARS

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, then the id `end`, as unsigned 32-bit integers."""
        if len(self.known) > self.bound or self.known.chars > 16 * self.bound:
            self._forget_rare()
        known = self.known.__getitem__
        places = [np.fromiter(map(known, keys), np.int64, len(keys)) for keys in map(self._keys, texts)]
        self._learn()
        met = np.bincount(np.concatenate(places), minlength=len(self.known)) if places else np.zeros(0, np.int64)
        met[: len(self.met)] += self.met
        self.met, out = met, []
        for p in places:
            n = self.starts[p + 1] - self.starts[p]
            stop = np.cumsum(n)
            total = int(stop[-1]) if len(n) else 0
            ids = np.empty(total + 1, np.uint32)
            ids[:total] = self.ids[np.arange(total) + np.repeat(self.starts[p] - (stop - n), n)]
            ids[total] = end
            out.append(ids)
        return out


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One for each path and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def encode_slices(path: str, texts: pa.Array, end: int, chars: int = 500_000):
    """Yields (row, ids) text by text; at most about `chars` characters are taken out of Arrow and encoded at a time, or one text."""
    t, i = tokenizer(path), 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + sizes[j] <= chars):
            n += sizes[j]
            j += 1
        yield from zip(range(i, j), t.encode([x or "" for x in texts.slice(i, j - i).to_pylist()], end), strict=True)
        i = j
