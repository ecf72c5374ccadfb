import hashlib
import random
from collections import Counter

from tracklake.llm.substring_dedup import SuffixAutomaton, remove_repeated_passages


def brute(rows, least):
    split = [[w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + least]) for w in split for i in range(len(w) - least + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        goes = set()
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                goes |= set(range(i, i + least))
        kept = " ".join(x for i, x in enumerate(w) if i not in goes)
        out.append((doc_id, len(w), len(goes), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)] + ["naïve", " ", "a b"]
    passage = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [passage(n) for n in (34, 35, 36, 50, 90)]
    rows = []
    for i in range(160):
        words = passage(r.randint(0, 150))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(shared)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200, rows[0][1]), (201, rows[1][1]), (201, rows[1][1]), (None, rows[2][1]), (202, None), (203, ""), (204, " \n "), (205, "ha " * 200), (206, "la " * 35), (207, " ".join(["x y z"] * 30)), (208, "mm " * 36)]
    line = passage(20)
    rows += [(300 + i, " ".join(passage(r.randint(5, 40)) + line + passage(r.randint(20, 40)))) for i in range(80)]
    return rows


def test_against_all_windows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, key int").repartition(6)
    for least, more in ((35, {}), (35, {"most_places": 10}), (5, {})):
        got = remove_repeated_passages(docs, least=least, **more).collect()
        assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256, g.kept) for g in got), key=str) == brute(rows, least)


def test_hot_keys_by_digests(spark):
    rows = corpus()
    got = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), most_places=0).collect()  # every repeated key is hot
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256, g.kept) for g in got), key=str) == brute(rows, 35)


def test_no_rows(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_counts():
    r = random.Random(4)
    for _ in range(300):
        parts = [([r.choice("ab") for _ in range(r.randint(1, 12))], r.randint(1, 2)) for _ in range(r.randint(1, 4))]
        parts = list({tuple(p): (p, n) for p, n in parts}.values())
        automaton = SuffixAutomaton()
        for p, n in parts:
            automaton.add(p, n)
        automaton.finish()
        for least in (1, 2, 3, 5):
            seen = Counter()
            for p, n in parts:
                for i in range(len(p) - least + 1):
                    seen[tuple(p[i : i + least])] += n
            for p, _ in parts:
                assert automaton.repeated(p, least) == [i for i in range(len(p) - least + 1) if seen[tuple(p[i : i + least])] > 1]
