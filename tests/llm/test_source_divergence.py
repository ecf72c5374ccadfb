import re
from collections import Counter

import duckdb
import pytest

from tracklake.llm import source_divergence as sd


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        n = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        n[None] = sum(n.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept} for s, c in n.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            if s is not None:
                pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in n if o not in (s, None)]
                terms = [(f(p[s][t], p[None][t]), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
                for part, found in (("pair", pairs), ("term", terms)):
                    found.sort(key=lambda x: (-x[0], x[1].encode()))
                    out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def frame(spark, rows):
    # names of columns as the operator has them inside
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, names string").repartition(3)


def odd_rows():
    rows = [("en", f"s{i % 4}", f"The cat {'sat' if i % 3 else 'Éat Ünd'} it's a_b 12 {'x' * (i % 5)}\0y") for i in range(60)]
    rows += [(None, None, "Null Terms here"), (None, "s1", None), ("de", "only", "eins zwei eins"), ("fr", "a", ""), ("fr", "b", None)]
    return rows + [("es", "hot", "hola Hola mundo")] * 40 + [("es", "cold", "mundo")] * 3 + [("en", "s0", "word 日本語 " * 20_000)]


def test_against_brute_force(spark):
    assert found(sd.source_divergence(frame(spark, odd_rows()))) == brute(odd_rows())
    assert found(sd.source_divergence(frame(spark, odd_rows()), least_docs=1, top=3)) == brute(odd_rows(), 1, 3)


def test_no_terms_and_no_rows(spark):
    rows = [("fr", "a", ""), ("fr", "b", None), ("fr", "c", "123")]
    assert found(sd.source_divergence(frame(spark, rows))) == brute(rows)
    assert sd.source_divergence(frame(spark, rows).limit(0)).collect() == []


def test_ties_go_by_utf8(spark):
    rows = [("en", s, "Öl zu aa") for s in ("b", "a", "ä", "z") for _ in range(5)]
    assert found(sd.source_divergence(frame(spark, rows))) == brute(rows)


def test_vectors_have_an_entry_for_each_source(spark):
    vectors, langs = sd.term_vectors(frame(spark, odd_rows()))
    names = {r.lang: r.names for r in langs.collect()}
    assert names["en"] == ["s0", "s1", "s2", "s3"] and names[""] == ["", "s1"]
    assert all(len(v.counts) == len(names[v.lang]) for v in vectors.collect())


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = c.execute(sd.SQL).fetchall()
    assert len(got) > 1000
    assert found(sd.op12_source_divergence(spark, f"/root/testdata/{sf}")) == sorted(got)
