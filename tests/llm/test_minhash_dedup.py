import random

from tracklake.llm.minhash_dedup import minhash_dedup, op8_minhash


def brute(rows, k, percent):
    """rows: (id, text). {(id): (size, component)} from all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_against_all_pairs(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(40):  # chains of copies, each a few words from the one before
        text = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 8)):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
    common = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(60):  # a passage that many share, with tails of their own
        rows.append((n, " ".join(common + [r.choice(vocabulary) for _ in range(r.randint(3, 30))])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "two words"), (n + 6, "Two words"), (n + 7, "TWO\vWORDS")]
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        got = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=k, percent=percent, bands=32, rows=4).collect()
        assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
        assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_odd_tables(spark):
    assert minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (None, "a b c d e f", 4), (3, "x y z", 5), (3, "a b c d e f", 6), (4, "x y z", 7)]
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, component_id long")).collect()
    assert len(got) == 7
    assert {(g.doc_id, g.component_id) for g in got} == {(1, 1), (2, 1), (None, None), (3, 1), (4, 1)}
    assert all(g.kept for g in got if g.doc_id in (None, 1))


def test_query_against_all_pairs(spark):
    """The query's own bands and rows, on a supplied table."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in op8_minhash(spark, sf).collect()} == brute(rows, 3, 85)
