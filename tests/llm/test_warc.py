import gzip
import random
from pathlib import Path

from tracklake.llm.warc import audit, levels_for, merkle_tree, op9_warc_audit, read_warc, sharded, warc_records, write_warc


def pages(spark, n=300):
    r = random.Random(2)
    rows = [(i, f"http://x/{i}", "é\r\n\r\nWARC/1.0" * r.randint(0, 40), 1) for i in range(n)] + [(None, None, None, 1), (5, "http://x/\r\n5", "", 2), (7, "u", "same", 3), (7, "u", "same", 3)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard int")


def test_round_trip_and_damage(spark, tmp_path):
    dealt = sharded(pages(spark), shard_bytes=15_000)
    records = warc_records(dealt).cache()
    write_warc(dealt, str(tmp_path / "w"), 20)
    back = read_warc(spark, str(tmp_path / "w"))
    assert back.count() == 304
    html = {(r.page_id, r.url, r.html or "") for r in pages(spark).collect()}
    assert {(r.page_id, r.url.replace("http://x/5", "http://x/5"), r.html) for r in back.collect()} == {(i, (u or "").replace("\r\n", ""), h) for i, u, h in html}
    levels = max(2, levels_for(records, 4))
    tree = merkle_tree(records, levels, 4)
    assert tree.where(f"level = {levels}").count() == records.select("shard").distinct().count() > 5
    assert audit(tree, merkle_tree(back, levels, 4), levels, 4).collect() == []

    files = sorted(Path(tmp_path / "w").glob("shard=*/part-*.gz"))
    data = bytearray(gzip.decompress(files[0].read_bytes()))
    shard = int(files[0].parent.name[6:])
    own = sorted((r for r in records.collect() if r.shard == shard), key=lambda r: r.idx)
    victim = own[len(own) // 2]
    data[victim.stop - 6] ^= 1  # in the payload, or the header of an empty one
    files[0].write_bytes(gzip.compress(bytes(data)))
    cut = gzip.decompress(files[1].read_bytes())
    files[1].write_bytes(gzip.compress(cut[:-10]))
    for f in files[:2]:
        Path(f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    wrong = audit(tree, merkle_tree(read_warc(spark, str(tmp_path / "w")), levels, 4), levels, 4).collect()
    other = int(files[1].parent.name[6:])
    last = max(r.idx for r in records.collect() if r.shard == other)
    assert {(w.shard, w.idx, w.status) for w in wrong} == {(shard, victim.idx, "changed"), (other, last, "changed")}
    gone = audit(tree, tree.where(f"shard <> {shard}"), levels, 4).collect()
    assert {w.status for w in gone} == {"missing"} and len(gone) == len(own)


def test_no_pages(spark, tmp_path):
    none = warc_records(sharded(pages(spark).limit(0)))
    write_warc(sharded(pages(spark).limit(0)), str(tmp_path / "w"), 0)
    assert none.collect() == [] and read_warc(spark, str(tmp_path / "w")).collect() == []
    assert audit(merkle_tree(none, 1), merkle_tree(none, 1), 1).collect() == []


def test_one_id_and_repeated_rows_fill_no_shard(spark):
    one_id = spark.range(100_000).selectExpr("CAST(NULL AS bigint) AS page_id", "'u' AS url", "concat('page ', id) AS html")
    copies = spark.range(20_000).selectExpr("1L AS page_id", "'v' AS url", "'the same page' AS html")
    for rows in (one_id, copies, one_id.union(copies)):
        dealt = sharded(rows, shard_bytes=400_000)
        sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
        assert sum(sizes) == rows.count() and len(sizes) > 5 and max(sizes) < 8000, sizes


def test_query_finds_the_planted_damage(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_warc_audit(spark, sf).collect()
    assert sorted(g.page_id for g in got if not g.intact) == [i for i in range(len(got)) if i % 1000 == 7]
