import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tracklake.llm.pii import KINDS, find_personal_data, op3_pii, spans_text

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base(text):
    out = {}
    for kind, p in PATTERNS.items():
        found = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), m.end(), m[0]))
        out[kind] = found
    return out


def brute_terms(rows, reach, least, generalise):
    places, has, texts = [], defaultdict(int), [t or "" for _, t in rows]
    for r, text in enumerate(texts):
        for w in {w.lower() for w in re.findall(r"[^\W\d_]+", text)}:
            has[w] += 1
        found = base(text)
        spans = [s for k in found.values() for s in k]
        for kind, own in found.items():
            for a, b, value in own:
                for lo, hi, before in ((max(a - reach - 1, 0), a, True), (b, min(b + reach + 1, len(text)), False)):
                    for m in re.finditer(r"[^\W\d_]+", text[lo:hi]):
                        if len(m[0]) < 3 or before and lo and not m.start() or not before and hi < len(text) and m.end() == hi - lo:
                            continue
                        s, e = lo + m.start(), lo + m.end()
                        if not any(s < y and e > x for x, y, _ in spans):
                            places.append((r, f"{kind}:{value.lower()}", (before, text[lo:hi].lower()), m[0].lower(), s, e))
    contexts, together = defaultdict(set), defaultdict(set)
    for r, entity, context, term, _, _ in places:
        contexts[term, entity].add(context)
        together[term, entity].add(rows[r])
    out = defaultdict(set)
    for r, entity, _, term, s, e in places:
        if len(contexts[term, entity]) >= least and max(0.0, -math.log2(len(together[term, entity]) / has[term])) <= generalise:
            out[r].add((s, e))
    return out


def rows_of():
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "of", "in", "Zeta"]
    bits = ["a.b@c.de", "x@y", "x@y.z_q@r.st", "@@a@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+12", "+1.2.3.4.5.6.7.8.9", "12345678901234567890", "++49 30 1234567-", "٣.4.5.6", "a+b@c-d.e.f", "😀me@x.org😀", "\x01q@w.er\x01"]
    rows = [(i, " ".join(r.choice(bits) if r.random() < 0.2 else r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(150)]
    for i in range(8):
        rows.append((500 + i, f"{' '.join(r.choice(words) for _ in range(5))} Müller writes {' '.join(r.choice(words) for _ in range(i))} mueller@post.de {r.choice(words)} end"))
    return rows + [(700, None), (701, ""), (None, "ann@b.cc here"), (702, "same@b.cc row"), (702, "same@b.cc row"), (703, "a" * 3000), (704, "1" * 3000), (705, "1 " * 2000), (706, "a." * 1500 + "@" + "b." * 1500), (707, "+1" * 1500)]


def test_against_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, term string").repartition(4)
    got = find_personal_data(docs).select("doc_id", *KINDS, "sanitised", spans_text(KINDS[:4]).alias("base"), spans_text(KINDS).alias("all")).collect()
    clean = [(i, (t or "").replace("\x01", "\x02")) for i, t in rows]
    terms, want = brute_terms(clean, 80, 3, 3.3), []
    for r, (i, t) in enumerate(clean):
        found = base(t)
        text = [f"{k}:{a}:{b}" for k in PATTERNS for a, b, _ in found[k]]
        want.append((i, ",".join(text), ",".join(text + [f"term:{a}:{b}" for a, b in sorted(terms[r])])))
    assert sorted(map(str, ((g.doc_id, g.base, g["all"]) for g in got))) == sorted(map(str, want))
    one = next(g for g in got if g.doc_id == 503)
    assert "mueller@post.de" not in one.sanitised and "Müller" not in one.sanitised and "[EMAIL]" in one.sanitised and "[TERM]" in one.sanitised
    assert next(g for g in got if g.doc_id == 700).sanitised == ""


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {g.doc_id: g for g in op3_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found, g = base(d.text), got[d.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b, _ in found[k])
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and g.spans.startswith(text)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(len(found[k]) for k in PATTERNS)


def test_no_rows(spark):
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).select(F.lit(1)).collect() == []


def test_very_long_runs(spark):
    n = 300_000
    rows = [(1, "a" * n), (2, "1" * n), (3, "1 " * n), (4, "a." * n + "@" + "b." * n), (5, "+" + "1." * n), (6, "a@b.c " * 2000)]
    got = {g.doc_id: g for g in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()}
    assert len(got[6].email) == 2000 and len(got[4].email) == 1 and not got[1].email and not got[2].card and not got[3].card


def brute_whole(texts, reach, least, generalise):
    near, support, together, has = brute_near(texts, reach), defaultdict(set), defaultdict(int), defaultdict(int)
    entities = [{f"{k}:{v.lower()}" for k, own in base(t).items() for _, _, v in own} for t in texts]
    for text, own in zip(texts, entities, strict=True):
        for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", text)}:
            has[w] += 1
            for e in own:
                support[w, e].add(text.lower())
                together[w, e] += 1
    strong = {w for (w, e), n in together.items() if max(len(support[w, e]), len(near[w, e])) >= least and max(0.0, -math.log2(n / has[w])) <= generalise}
    out = []
    for text in texts:
        spans = [s for own in base(text).values() for s in own]
        words = [m for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in strong]
        out.append(",".join(f"term:{m.start()}:{m.end()}" for m in words if not any(m.start() < y and m.end() > x for x, y, _ in spans)))
    return out


def brute_near(texts, reach):
    contexts = defaultdict(set)
    for text in texts:
        found = base(text)
        spans = [s for k in found.values() for s in k]
        for kind, own in found.items():
            for a, b, value in own:
                for lo, hi, before in ((max(a - reach - 1, 0), a, True), (b, min(b + reach + 1, len(text)), False)):
                    for m in re.finditer(r"[^\W\d_]{3,}", text[lo:hi]):
                        cut = before and lo and not m.start() or not before and hi < len(text) and m.end() == hi - lo
                        if not cut and not any(lo + m.start() < y and lo + m.end() > x for x, y, _ in spans):
                            contexts[m[0].lower(), f"{kind}:{value.lower()}"].add((before, text[lo:hi].lower()))
    return contexts


def test_whole_texts(spark, tmp_path):
    head = [(800 + i, f"Quentin, {'1 2 ' * 150}{i} quentin {'3 4 ' * 150}q.t@far.org") for i in range(4)]
    rows = rows_of() + head + [(810, "No address, but Quentin is here."), (811, "Plain text")] + [(820, f"{w} x{i}") for i in range(60) for w in ("alpha", "beta")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_pii(spark, str(tmp_path)).collect()
    texts = [(t or "").replace("\x01", "\x02") for _, t in rows]
    want = []
    for (i, _), t, terms in zip(rows, texts, brute_whole(texts, 80, 3, 3.3), strict=True):
        want.append((i, ",".join([f"{k}:{a}:{b}" for k in PATTERNS for a, b, _ in base(t)[k]] + [terms] * bool(terms))))
    assert sorted(map(str, ((g.doc_id, g.spans) for g in got))) == sorted(map(str, want))
    n = {g.doc_id: g.n_term for g in got}
    assert [n[i] for i in (800, 801, 802, 803)] == [2] * 4 and "term:16:23" in next(g.spans for g in got if g.doc_id == 810)


def test_null_ids_and_repeated_rows(spark):
    met = [(None, f"common {i}{i} x@null.org") for i in range(3)]
    copies = [(900 + i, f"rare {i}{i} y@copy.org") for i in range(3) for _ in range(20)]
    docs = spark.createDataFrame(met + copies + [(i, "common words") for i in range(200)], "doc_id long, text string")
    for whole in (False, True):
        got = find_personal_data(docs, whole_texts=whole).where("size(term) > 0").select("doc_id", F.expr("transform(term, t -> t.value)").alias("v"), F.expr("transform(term, t -> t.action)").alias("a")).collect()
        assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=i, v=["rare"], a=["remove"]) for i, _ in copies]))
