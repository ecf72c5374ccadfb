import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracklake.llm import packing, token_files
from tracklake.llm.tokens import ChunkTokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    r = random.Random(5)
    parts = ["the", "Ünïcode", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "​", "'s", "don't", "12", "3.5", "<|endoftext|>", "<|startoftext|>", "é", "é", "́", "日本語", "🙂", "...", "_", "İ", "\0"]
    return ["", " ", "\n\n", *("".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(3000)), "word " * 5000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(path):
    whole, chunked = Tokenizer.from_file(path), ChunkTokenizer(path, bound=500)
    texts = odd_texts()
    for i in range(0, len(texts), 100):
        for text, ids in zip(texts[i : i + 100], chunked.encode(texts[i : i + 100], 2), strict=True):
            assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], repr(text)


def rows_of(n=150):
    texts = odd_texts()[-n:]
    return [(1000 - 7 * i, t) for i, t in enumerate(texts)] + [(5000, None), (None, "no id"), (5001, "same id"), (5001, "same id"), (5001, "other text")]


def test_token_files_come_back(spark, tmp_path):
    rows, whole = rows_of(), Tokenizer.from_file(BYTE)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    token_files.write_token_files(docs, str(tmp_path / "t"), BYTE, block=64, row_ids=500)
    got = token_files.read_documents(spark, str(tmp_path / "t")).collect()
    want = sorted(((i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got.sort(key=lambda g: g.start)
    assert [g.doc_id for g in got] == [i for i, _ in want]
    assert sorted(map(str, [(g.doc_id, np.frombuffer(g.ids, "<u4").tolist()) for g in got])) == sorted(map(str, [(i, ids) for i, ids in want]))
    at = 0
    for g in got:
        assert g.start == at and g.n_tokens == len(g.ids) // 4
        at += g.n_tokens
    short = token_files.read_documents(spark, str(tmp_path / "t"), ids=False).collect()
    assert {(g.start, g.ids_crc32) for g in short} == {(g.start, zlib.crc32(g.ids)) for g in got}


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.array([7]), np.full(100, 2**32 - 1), np.array([0, 2**32 - 1]), r.integers(0, 2**32, 5000), r.integers(0, 50, 4096), np.append(r.integers(5, 9, 300), 70000)):
        ids = ids.astype(np.uint32)
        for p in (0, 50, 98, 100):
            assert np.array_equal(token_files.unpack_block(token_files.pack_block(ids, p)), ids)


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(none, str(tmp_path / "t"), BYTE)
    assert token_files.read_documents(spark, str(tmp_path / "t")).collect() == []
    assert packing.pack_documents(none, WORD).collect() == []


def test_packing_keeps_every_id_once(spark):
    rows, whole = rows_of(), Tokenizer.from_file(WORD)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, group int")
    got = packing.pack_documents(docs, WORD, capacity=256, group_chars=20_000, with_ids=True).collect()
    sequences = {}
    for g in got:
        assert g.ids_crc32 == zlib.crc32(g.ids) and len(g.ids) == 4 * g.length
        sequences.setdefault(g.sequence_id, []).append(g)
    for s in sequences.values():
        at = 0
        for g in sorted(s, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 256
    tokens = sum(g.length for g in got)
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in (sum(g.length for g in s) for s in sequences.values()))
    assert padding <= 0.01 * tokens
    once = [(i, t) for i, t in rows if i is not None and i != 5001]
    for i, t in once:
        own = sorted((g for g in got if g.doc_id == i), key=lambda g: g.start)
        ids = np.frombuffer(b"".join(g.ids for g in own), "<u4").tolist()
        assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert all(g.doc_tokens == len(ids) for g in own)
    assert sum(g.length for g in got if g.doc_id == 5001) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if i == 5001)


def test_first_fit_takes_the_first_bin_with_room():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 99) for _ in range(500)), reverse=True)
    tree, room = packing.BinTree(100, len(lengths)), [100] * len(lengths)
    for n in lengths:
        place = next(i for i, x in enumerate(room) if x >= n)
        assert tree.first_fit(n) == place
        room[place] -= n


def test_copies_of_one_row_go_to_many_groups(spark):
    rows = [(None, "boiler plate of many rows")] * 4000 + [(i, f"own {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack_documents(docs, WORD, capacity=256, group_chars=20_000).collect()
    per = {}
    for g in got:
        per[g.sequence_id >> 20] = per.get(g.sequence_id >> 20, 0) + g.length
    n = sum(per.values())
    one = len(Tokenizer.from_file(WORD).encode("boiler plate of many rows", add_special_tokens=False).ids) + 1
    assert sum(g.length for g in got if g.doc_id is None) == 4000 * one and len(got) >= len(rows)
    assert len(per) > 8 and max(per.values()) < 2 * n / len(per)
