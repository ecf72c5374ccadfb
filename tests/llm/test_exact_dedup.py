from pyspark.sql import functions as F

from tracklake.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b"), (2, "ab  "), (3, "a\nb"), (4, None), (5, ""), (6, " \t\r\v\f\n"), (7, "a b"), (8, "x"), (9, "x"), (None, "x"), (10, "only"), (9, "x"), (11, "xx"), (12, "é " * 30000), (13, "é" * 30000)]


def want(rows):
    out, groups = [], {}
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    for i, t in rows:
        g = groups[norm(t)]
        out.append((i, min(g)[3], len(g)))
    return sorted(map(str, out))


def test_groups(spark):
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, keep_id int").repartition(6)
    for more in ({}, {"salts": 3, "hot_share": 0.9}, {"digest": lambda norm: F.substring(F.sha2(norm, 256), 1, 1)}, {"digest": lambda norm: F.lit("same")}):
        got = exact_dedup(docs, **more).collect()
        assert sorted(str((g.doc_id, g.keep_id, g.group_size)) for g in got) == want(ROWS)
        kept = [(g.doc_id, g.keep_id) for g in got if g.kept]
        assert len(kept) == len({g.keep_id for g in got}) and all(a == b for a, b in kept)


def test_no_rows(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
