"""How far the sources of a language differ in their words: divergences by wide term vectors (operator 12)."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import FEW, materialize, table

#: Runs of letters A-Z, a-z and of all that isn't ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def term_vectors(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10) -> tuple[DataFrame, DataFrame]:
    """The kept terms as wide vectors, and the languages that they are of.

    The first has (lang, term, counts): an entry of counts for each source of the language, in the order of names. The second has, for every
    language, names (its sources, sorted), totals (occurrences of kept terms in each) and terms (how many are kept).

    Terms are counted where the texts are read, so a source or a word of any share of the rows costs each task one row.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text.alias("text"))
    lists = base.select("lang", "source", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("terms"))
    # each text's terms twice: all of them for the counts, and each once for the number of documents
    lists = lists.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    rows = lists.select("lang", "source", "kind", F.explode("terms").alias("term"))
    counts = rows.groupBy("lang", "source", "term").agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("docs"))
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    wide = materialize(wide.where(F.col("docs") >= least_docs).select("lang", "term", "of"), "divergence-terms")

    groups = base.select("lang", "source").distinct()
    totals = wide.select("lang", F.inline("of").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = wide.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("s"))
    langs = langs.join(sizes, "lang", "left").select("lang", F.col("s.source").alias("names"), F.col("s.total").alias("totals"), F.coalesce("terms", F.lit(0)).alias("terms"))
    langs = materialize(langs, "divergence-langs")
    vectors = wide.join(_if_small(langs), "lang").withColumn("_of", F.map_from_entries("of"))
    vectors = vectors.select("lang", "term", F.expr("transform(names, s -> coalesce(try_element_at(_of, s), 0L))").alias("counts"))
    return vectors, langs


def _if_small(langs: DataFrame) -> DataFrame:
    """The languages for a join: broadcast where all of them together are counted to have few sources."""
    sources = langs.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    return F.broadcast(langs) if sources <= FEW else langs.hint("merge")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10, scale: int = 1_000_000_000) -> DataFrame:
    """Divergences of the sources of each language: (lang, source, part, item, value, rank).

    A language keeps the terms in at least `least_docs` of its documents, V of them. In a source that has N occurrences of these, a
    term with n of them has p = 1 + floor(scale * (n + 2) / (N + 2 * V)); in the whole language q likewise. The divergence of two such values is
    f = floor((p - q) ** 2 / (p + q)). Part `pair` has, for each other source of the language, f summed over all kept terms; part `term`
    has the source's `top` terms with p > q by f against the language. Ranks start at 1 for each source and part: value descending, then item ascending.

    Each kept term is a vector with an entry for each source. Array functions turn it into the contributions of pairs of sources, a source at a time
    (so no row has more of them than there are sources), and these are summed where they are made, before the shuffle. All arithmetic is exact: whole numbers.

    Null languages, sources and texts are ''. Every row is a document of its own, repeated ones too. A source without any kept term has N = 0 and is compared
    all the same; a language without kept terms gives its pairs with value 0. A language with one source has no pair. Empty tables give no rows.
    Other columns aren't read, so names can't clash. A long text is one list of its words in one task.
    """
    vectors, langs = term_vectors(docs, lang_col, source_col, text_col, least_docs)
    share = f"1L + (cast({{n}} + 2 AS decimal(20, 0)) * {scale}) div (cast({{total}} AS decimal(20, 0)) + 2 * terms)"
    wide = vectors.join(_if_small(langs), "lang")
    wide = wide.select("lang", "term", "names", "counts", F.expr(f"zip_with(counts, totals, (n, t) -> {share.format(n='n', total='t')})").alias("ps"), F.expr("aggregate(counts, 0L, (a, n) -> a + n)").alias("n"), F.expr("aggregate(totals, 0L, (a, n) -> a + n)").alias("total"), "terms")

    firsts = wide.select("lang", "ps", F.posexplode("ps").alias("i", "p"))
    parts = firsts.select("lang", "i", F.posexplode(F.expr("transform(slice(ps, i + 2, size(ps)), q -> ((p - q) * (p - q)) div (p + q))")).alias("k", "f"))
    sums = parts.groupBy("lang", "i", "k").agg(F.sum("f").alias("value"))
    both = langs.select("lang", "names", F.posexplode("names").alias("i", "a"))
    both = both.select("lang", "a", "i", F.posexplode(F.expr("slice(names, i + 2, size(names))")).alias("k", "b"))
    both = both.join(sums, ["lang", "i", "k"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = both.select("lang", "value", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    own = wide.select("lang", "term", F.expr(share.format(n="n", total="total")).alias("q"), F.inline(F.arrays_zip("names", "counts", "ps")).alias("source", "count", "p"))
    own = own.where("count > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(own)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.v) AS p
  FROM t JOIN kept ON kept.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
q AS (SELECT p.lang, p.term, 1 + (1000000000::HUGEINT * (sum(p.n)::HUGEINT + 2)) // (any_value(l.total) + 2 * any_value(v.v)) AS q
  FROM p JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM t GROUP BY lang) l ON l.lang = p.lang JOIN v ON v.lang = p.lang GROUP BY p.lang, p.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
