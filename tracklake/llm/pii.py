"""Personal data: base patterns and information-theoretic sanitisation (operator 3), in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import FEW, if_few, materialize, table

#: Fixed patterns. Possessive runs and the look-behinds (a match starts where a run starts, or where the last match
#: ended) leave the matches as they are and keep long runs from being tried at each of their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> cast(d AS int) * (1 + i % 2)), 0, (a, v) -> a + if(v > 9, v - 9, v)) % 10 = 0"
#: What a match must fulfil.
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> p RLIKE '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
KINDS = [*PATTERNS, "term"]
#: What a text must hold to have a match that passes; the others aren't searched.
_NEED = {
    "email": "contains(text, '@')",
    "ip": r"text RLIKE r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
    "card": r"text RLIKE r'(?:[0-9][\x20-]?){12}[0-9]'",
    "phone": r"contains(text, '+') AND text RLIKE r'\+[0-9][\x20().0-9-]{7,}'",
}
_NONE = "cast(array() AS array<struct<start: int, stop: int, value: string>>)"
#: Parts of a text, or spans in it, that one fold goes through; folds of blocks are then put together, so that work grows as the text.
_BLOCK = 256
#: Stands for a letter of a base span where only words outside of them count.
_MASK = "\\u0002"
_WORD = r"[\p{L}\x02]"


def matches(text: str, pattern: str, keep: str = "true") -> Column:
    """All matches p with `keep` in a text without \\x01, with their code point bounds: matches are put between marks and cut out there."""
    parts = f"split(regexp_replace({text}, r'{pattern}', '\\u0001$0\\u0001'), '\\u0001', -1)"
    block = f"""aggregate(slice(ps, b * {_BLOCK} + 1, {_BLOCK}), struct(0 AS i, 0 AS at, {_NONE} AS found),
        (s, p) -> struct(s.i + 1 AS i, s.at + length(p) AS at, if(s.i % 2 = 1 AND {keep}, concat(s.found, array(struct(s.at AS start, s.at + length(p) AS stop, p AS value))), s.found) AS found))"""
    return F.expr(
        f"""transform(array({parts}), ps -> aggregate(transform(sequence(0, int((size(ps) - 1) div {_BLOCK})), b -> {block}), struct(0 AS at, {_NONE} AS found),
        (s, b) -> struct(s.at + b.at AS at, concat(s.found, transform(b.found, x -> struct(s.at + x.start AS start, s.at + x.stop AS stop, x.value AS value))) AS found), s -> s.found))[0]"""
    )


def _pieces(text: str) -> str:
    """A text in pieces of 512 code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,512}}', 0)"


def _cut(start: str, stop: str) -> str:
    """The code points from start to stop of a text whose pieces are `pieces`, at a cost that grows with what is cut out only."""
    return f"substring(array_join(slice(pieces, int(({start}) div 512) + 1, int(({stop}) div 512 - ({start}) div 512) + 1), ''), ({start}) % 512 + 1, ({stop}) - ({start}))"


def _let(name: str, value: str, body: str) -> str:
    """`body`, in which `name` is a value that is worked out once: a column would be put into lambdas and be worked out for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _rewritten(spans: str, piece: str) -> str:
    """The text with the spans x (start, stop, tag), in any order, put as `piece`, which sees in s.at where the last one ended; piece is null where a span is to be left out."""
    step = f"if({piece} IS NULL, s, struct(greatest(s.at, x.stop) AS at, concat(s.done, if(x.start > s.at, {_cut('s.at', 'x.start')}, ''), {piece}) AS done))"
    block = f"aggregate(slice(xs, b * {_BLOCK} + 1, {_BLOCK}), struct(t.at AS at, '' AS done), (s, x) -> {step})"
    whole = _let("d", block, "struct(d.at AS at, concat(t.done, d.done) AS done)")
    folded = f"aggregate(sequence(0, int((size(xs) - 1) div {_BLOCK})), struct(0 AS at, '' AS done), (t, b) -> {whole}, t -> concat(t.done, {_cut('t.at', 'length(text)')}))"
    return _let("pieces", _pieces("text"), _let("xs", f"array_sort({spans})", folded))


def _words(text: str) -> Column:
    """The different words of at least three letters, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 3), F.lower))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and tie (a hash of both) of every row. The controls that serve as marks stand as \\x03, which is no letter, digit or part of a pattern either."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("doc_id", "text"))
    return rows.withColumn("text", F.when(F.contains("text", F.lit("\x01")) | F.contains("text", F.lit("\x02")), F.translate("text", "\x01\x02", "\x03\x03")).otherwise(F.col("text")))


def _in_whole_texts(found: DataFrame, near: DataFrame, least_contexts: int) -> DataFrame:
    """term, entity, together: rows that have both anywhere, for pairs of `near` and pairs in at least `least_contexts` different texts."""
    texts = found.where("size(entities) > 0").groupBy("text_hash").agg(F.count("*").alias("n"), F.first("words").alias("words"), F.first("entities").alias("entities"))
    often = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= least_contexts).select("entity")
    often = materialize(often.union(near.select("entity")).distinct(), "pii-often")
    pairs = texts.select("n", "words", F.explode("entities").alias("entity")).join(often, "entity").select("n", "entity", F.explode("words").alias("term"))
    pairs = pairs.groupBy("term", "entity").agg(F.sum("n").alias("together"), F.count("*").alias("texts")).join(near.select("term", "entity", F.lit(True).alias("near")), ["term", "entity"], "left")
    return pairs.where((F.col("texts") >= least_contexts) | F.col("near")).select("term", "entity", "together")


def _masked(kinds: list[str]) -> Column:
    """The text with letters in base spans masked: a word that meets a span has masks in it."""
    spans = f"flatten(array({', '.join(f'transform({k}, x -> struct(x.start AS start, x.stop AS stop))' for k in kinds)}))"
    piece = f"if(x.stop <= s.at, '', regexp_replace({_cut('greatest(s.at, x.start)', 'x.stop')}, r'\\p{{L}}', '{_MASK}'))"
    return F.expr(_rewritten(spans, piece))


def _everywhere(docs: DataFrame, found: DataFrame, strong: DataFrame, id_col: str, text_col: str, remove_bits: float) -> DataFrame:
    """doc_id, tie, term: every place of a strong term outside of base spans, in all rows that have one. It is told by the entity that it discloses most of."""
    action = materialize(strong.groupBy("term").agg((F.min("bits") <= remove_bits).alias("removed")), "pii-actions")
    rows = _texts(docs, id_col, text_col)
    hits = rows.select("doc_id", "tie", F.explode(_words("text")).alias("term")).join(if_few(action), "term")
    hits = hits.groupBy("doc_id", "tie").agg(F.collect_set("term").alias("strong"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
    spans = found.where("size(entities) > 0").select("doc_id", "tie", *PATTERNS).dropDuplicates(["doc_id", "tie"])
    hits = hits.join(spans, _same(hits, spans), "left").select(hits["doc_id"].alias("h_id"), hits["tie"].alias("h_tie"), "strong", "gone", *PATTERNS)
    hits = materialize(hits, "pii-hits")
    # most texts have hits once there are many entities, so texts are dealt by a shuffle at every size, once
    rows = rows.join(hits.hint("merge"), (F.col("tie") == F.col("h_tie")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    rows = rows.withColumn("masked", F.when(F.col("email").isNull(), F.col("text")).otherwise(_masked([*PATTERNS])))
    places = rows.select("doc_id", "tie", "gone", matches("masked", _WORD + "{3,}+", f"NOT contains(p, '{_MASK}') AND array_contains(strong, lower(p))").alias("x"))
    return places.select("doc_id", "tie", F.expr("transform(x, x -> struct(x.start AS start, x.stop AS stop, x.value AS value, if(array_contains(gone, lower(x.value)), 'remove', 'generalise') AS action))").alias("term")).dropDuplicates(["doc_id", "tie"])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["tie"] == b["tie"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every row: id, tie, text and the base matches of each kind."""
    rows = _texts(docs, id_col, text_col)
    rows = rows.withColumns({k: F.when(F.expr(_NEED[k]), matches("text", p)).otherwise(F.expr(_NONE)) for k, p in PATTERNS.items()})
    return rows.withColumns({k: F.expr(f"filter({k}, x -> {CHECKS[k]})") for k in PATTERNS})


def _contexts(reach: int) -> Column:
    """On either side of each base match: its entity, and the masked text up to `reach` code points and one more, by which a cut word shows."""
    matched = ", ".join(f"transform({k}, x -> struct(x.start AS start, x.stop AS stop, concat('{k}:', lower(x.value)) AS entity))" for k in PATTERNS)
    sides = f"flatten(transform(flatten(array({matched})), x -> array(struct(x.entity AS entity, greatest(x.start - {reach} - 1, 0) AS lo, x.start AS hi, true AS before), struct(x.entity AS entity, x.stop AS lo, least(x.stop + {reach} + 1, n_points) AS hi, false AS before))))"
    cut = _cut("x.lo", "x.hi")
    body = f"transform({sides}, x -> struct(x.entity AS entity, x.lo AS lo, x.hi AS hi, x.before AS before, x.lo = 0 OR NOT x.before AS from_start, x.hi = n_points OR x.before AS to_end, {cut} AS words, {cut.replace('pieces', 'masked_pieces')} AS masked))"
    return F.expr(_let("pieces", _pieces("text"), _let("masked_pieces", _pieces("masked"), _let("n_points", "length(text)", body))))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 80, least_contexts: int = 3, remove_bits: float = 1.0, generalise_bits: float = 3.3, with_text: bool = True, whole_texts: bool = False
) -> DataFrame:
    """One row for each row of docs: id, the span lists email, ip, card, phone and term, and with_text the sanitised text.

    A span is (start, stop, value, action), in code points, stop exclusive. The base kinds are the fixed patterns' leftmost matches that pass
    their checks; each is an entity to protect, known by kind and lower-case value. Terms are words of at least three
    letters, in lower case, within `reach` code points of an entity and outside of base spans. From all rows come: in how many rows a term stands within reach of an
    entity, in how many rows it stands at all, and in how many different contexts it meets the entity (copies of one context count once). What is left to
    guess of the entity once the term is read is -log2(rows with both / rows with the term) bits. A term met in at
    least `least_contexts` contexts is removed near the entity if at most `remove_bits` are left, and generalised (to its length class) if at
    most `generalise_bits` are.

    With whole_texts, the rows with both are those that have term and entity anywhere, support is also to meet in so many different texts, and each
    place outside of base spans of a term that is strong for any entity is marked, in all rows, also in those without the entity.

    Null and empty texts have no spans; their sanitised text is empty. Rows with a null or repeated id are rows like others. An empty table gives no rows.
    Work grows as the text, also in one text of very many matches. Other columns aren't read, so their names can't clash.
    """
    lists = _lists(docs, id_col, text_col)
    some = " OR ".join(f"size({k}) > 0" for k in PATTERNS)
    lists = lists.withColumn("any", F.expr(some))
    lists = lists.withColumn("masked", F.when(F.col("any"), _masked([*PATTERNS])))
    lists = lists.withColumn("around", F.when(F.col("any"), _contexts(reach)))
    lists = lists.withColumn("entities", F.expr("array_distinct(transform(around, x -> x.entity))"))
    if whole_texts:
        lists = lists.withColumn("text_hash", F.xxhash64(F.lower("text"))).withColumn("words", F.when(F.col("any"), _words("text")))
    lists = lists.withColumn("row", F.monotonically_increasing_id())  # rows with a null id and repeated ones count like others
    found = materialize(lists.select("row", "doc_id", "tie", *PATTERNS, "around", "entities", *["text_hash", "words"] * whole_texts), "pii-found")

    places = found.where("size(around) > 0").select("row", "doc_id", "tie", F.explode("around").alias("x")).select("row", "doc_id", "tie", "x.*").withColumn("context", F.xxhash64("before", F.lower("words")))
    places = places.withColumn("word", F.explode(matches("masked", _WORD + "+")))
    # a word that touches the far end of its context may be cut there
    places = places.where(f"length(word.value) >= 3 AND NOT contains(word.value, '{_MASK}') AND (from_start OR word.start > 0) AND (to_end OR word.stop < hi - lo)")
    places = places.select("row", "doc_id", "tie", "entity", "context", (F.col("lo") + F.col("word.start")).alias("start"), (F.col("lo") + F.col("word.stop")).alias("stop"), F.lower("word.value").alias("term"), F.col("word.value").alias("value"))
    places = materialize(places, "pii-places")

    met = places.groupBy("term", "entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("together")).where(F.col("contexts") >= least_contexts)
    met = materialize(met, "pii-met")
    if whole_texts:
        met = materialize(_in_whole_texts(found, met, least_contexts), "pii-whole")
    if met.isEmpty():
        terms = None
    else:
        met_terms = materialize(met.select("term").distinct(), "pii-terms")
        words = _texts(docs, id_col, text_col).select(F.explode(_words("text")).alias("term"))
        if met_terms.count() <= FEW:
            words = words.join(F.broadcast(met_terms), "term", "left_semi")
        words = words.groupBy("term").agg(F.count("*").alias("rows"))
        strong = met.join(words, "term").withColumn("bits", F.greatest(F.lit(0.0), -F.log2(F.col("together") / F.col("rows")))).where(F.col("bits") <= generalise_bits)
        strong = materialize(strong.select("term", "entity", "bits"), "pii-strong")
        if whole_texts:
            terms = _everywhere(docs, found, strong, id_col, text_col, remove_bits)
        else:
            action = F.when(F.min("bits") <= remove_bits, "remove").otherwise("generalise")
            terms = places.join(strong, ["term", "entity"]).groupBy("doc_id", "tie", "start", "stop", "value").agg(action.alias("action"))
            terms = terms.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "value", "action"))).alias("term"))
    out = found.select("doc_id", "tie", *[F.expr(f"transform({k}, x -> struct(x.start AS start, x.stop AS stop, x.value AS value, 'remove' AS action))").alias(k) for k in PATTERNS])
    none = F.expr("cast(array() AS array<struct<start: int, stop: int, value: string, action: string>>)")
    if terms is None:
        out = out.withColumn("term", none)
    else:
        out = out.join(terms, _same(out, terms), "left").select(out["doc_id"], out["tie"], *PATTERNS, F.coalesce("term", none).alias("term"))
    if with_text:
        texts = docs.select(F.col(id_col).cast("long").alias("s_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("s_tie", F.xxhash64("s_id", "text")).dropDuplicates(["s_id", "s_tie"])
        out = out.join(texts, (F.col("tie") == F.col("s_tie")) & F.col("doc_id").eqNullSafe(F.col("s_id")))
        out = out.withColumn("sanitised", sanitised())
    return out.select(F.col("doc_id").alias(id_col), *KINDS, *["sanitised"] * with_text)


def sanitised() -> Column:
    """The text with each span replaced by [KIND], removed terms by [TERM], generalised ones by [WORD] or [LONG WORD]; of overlapping spans the first counts."""
    tags = ", ".join(f"transform({k}, x -> struct(x.start AS start, x.stop AS stop, {repr('[' + k.upper() + ']') if k != 'term' else _GENERAL} AS tag))" for k in KINDS)
    return F.expr(_rewritten(f"flatten(array({tags}))", "if(x.start < s.at, NULL, x.tag)"))


_GENERAL = "if(x.action = 'remove', '[TERM]', if(length(x.value) > 7, '[LONG WORD]', '[WORD]'))"


def spans_text(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind, then start."""
    return F.concat_ws(",", *[F.expr(f"transform({k}, x -> concat('{k}:', x.start, ':', x.stop))") for k in kinds])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), with_text=False, whole_texts=True)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(spans_text(KINDS[:4]), 256).alias("base_sha256"), spans_text(KINDS).alias("spans"), counts[4])
