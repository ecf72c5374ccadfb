import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracklake.llm.alignment import Aligner, Transducer, align_tokenizers, byte_level_tokens, op11_align, pair_counts, piece_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(libraries, text):
    """Token ids and bytes of whole texts, or none."""
    a, b = libraries
    if not text:
        return [], []
    first = a.encode(f" {text}", add_special_tokens=False)
    # the bytes of a byte-level token, from the library's own characters
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for byte in range(256):
        if byte in keep:
            table[chr(byte)] = byte
        else:
            table[chr(256 + extra)] = byte
            extra += 1
    as_ = [(i, bytes(table[c] for c in t)) for i, t in zip(first.ids, first.tokens, strict=True)]
    bs = [(i, bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    same = b"".join(x for _, x in as_) == b"".join(x for _, x in bs) == f" {text}".encode()
    return (as_, bs) if same else ([], [])


def brute(libraries, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = whole(libraries, text)
        ends = [{}, {}]
        for side, tokens in enumerate((a, b)):
            at = 0
            for k, (i, x) in enumerate(tokens):
                at += len(x)
                ends[side][at] = (k + 1, i)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][c][1], ends[1][c][1]) for c in cuts]
        groups, p, q = [], 0, 0
        for c in cuts:
            i, j = ends[0][c][0], ends[1][c][0]
            groups.append(f"{','.join(str(x) for x, _ in a[p:i])}|{','.join(str(x) for x, _ in b[q:j])}")
            p, q = i, j
        counts.update(links)
        docs.append((doc_id, len(a), len(b), len(cuts), links, ";".join(groups)))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted((str(d), n_a, n_b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if n_a else "") for d, n_a, n_b, g, links, s in docs)


def found(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def odd_texts(n=600):
    r = random.Random(7)
    parts = ["the", "Ünïcode", " ", "  ", "\n", "\t", "\r\n", "\r", ";\r", " ", "　", "\x1c", "\x85", "​", "'s", "don't", "12", "3.5", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "é", "日本語", "🙂", "...", "_", "\0", "()\r", "{"]
    return ["", None, " ", "\n", "\r", "a ", " a", "a  ", "▁", "a▁b", *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)), "word " * 4000, "unbroken" * 3000]


def test_chunks_give_the_groups_of_whole_texts(libraries):
    by = Aligner(A, B, bound=300)
    texts = odd_texts(3000)
    found = [x for i in range(0, len(texts), 40) for x in by.align(texts[i : i + 40])]
    for text, (n_a, n_b, n_groups, keys, groups) in zip(texts, found, strict=True):
        (row,) = brute(libraries, [(1, text)])
        assert (n_a, n_b, n_groups, len(keys), hashlib.sha256(groups.encode()).hexdigest() if n_a else "") == (*row[1:5], row[7]), repr(text)


def test_every_token_of_the_vocabularies(libraries):
    a, b = libraries
    for tokens, size in ((byte_level_tokens(a.get_vocab()), a.get_vocab_size()), (piece_tokens([b.id_to_piece(i) for i in range(b.get_piece_size())]), b.get_piece_size())):
        assert len(tokens) == size and all(tokens)


def test_transducer_on_small_vocabularies():
    t = Transducer([b"ab", b"c", b"a", b"bc"], [b"a", b"bc", b"abc", b"b", b"x"])
    assert t.groups([0, 1], [2]) == [(2, 1)]
    assert t.groups([0, 1], [0, 1]) == [(2, 2)]
    assert t.groups([2, 3], [0, 1]) == [(1, 1), (2, 2)]
    assert t.groups([0, 1, 2], [0, 3]) is None  # one side is longer
    assert t.groups([2], [4]) is None and t.groups([], []) == []
    steps = len(t.next[0]) + len(t.next[1])
    t.groups([0, 1] * 50, [0, 1] * 50)
    assert len(t.next[0]) + len(t.next[1]) == steps  # nothing new to remember
    t.bound = 1
    assert t.groups([0, 1] * 3, [2] * 3) == [(2, 1), (4, 2), (6, 3)]


def test_against_brute_force(spark, libraries):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (7, "again"), (7, "again")] + [(5000 + i, "copies of one") for i in range(300)]
    docs = spark.createDataFrame([(*x, "own", 1.0) for x in rows], "doc_id long, text string, keys string, n_a double").repartition(6)
    assert found(align_tokenizers(docs, A, B)) == brute(libraries, rows)
    with_groups = align_tokenizers(docs, A, B, with_groups=True).where("n_a > 0").collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in with_groups)


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(align_tokenizers(docs, A, B)) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]
    assert align_tokenizers(docs.limit(0), A, B).collect() == []


def test_query_against_brute_force(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(op11_align(spark, "/root/testdata/sf0.001")) == brute(libraries, rows)


def test_pair_counts_keep_ties(spark):
    import numpy as np

    rows = [(np.array([10, 21], "<i8").tobytes(), np.array([2, 1], "<u4").tobytes()), (np.array([20, 31], "<i8").tobytes(), np.array([2, 5], "<u4").tobytes())]
    got = pair_counts(spark.createDataFrame(rows, "keys binary, times binary"), 10).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 2, True), (2, 0, 2, True), (2, 1, 1, False), (3, 1, 5, True)]
