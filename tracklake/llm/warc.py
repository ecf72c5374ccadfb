"""WARC files and their Merkle fixity audit (operator 9)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import if_few, in_batches, materialize, new_path, table

#: What ends a record; the text writer puts it after each.
_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def record(id_col: str, url_col: str, html_col: str, date: str) -> Column:
    """A WARC resource record as text, up to the line ends that follow every record."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.translate(F.coalesce(F.col(url_col), F.lit("")), "\r\n", "")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(_END), html,
    )


def sharded(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 8_000_000, date: str = DATE) -> DataFrame:
    """Every page with its shard: shard, page_id, url, html, digest. Pages are dealt by the md5 of id, url and html, so that a shard has about
    `shard_bytes` bytes whichever ids repeat. Repeated rows that are more than that together are dealt by their places in the table too.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    none = F.lit("")
    rows = rows.withColumn("digest", F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), none), F.lit(" "), F.coalesce("url", none), F.lit(" "), F.coalesce("html", none))))
    sizes = materialize(rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum(_size(date)).alias("bytes")), "warc-sizes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_bytes))
    dealt = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    heavy = sizes.where((F.col("n") > 1) & (F.col("bytes") > shard_bytes)).select("digest", F.ceil(F.col("bytes") / shard_bytes).alias("parts"))
    if not heavy.isEmpty():
        rows = materialize(rows.withColumn("copy", F.monotonically_increasing_id()), "warc-rows").join(if_few(heavy), "digest", "left")
        dealt = dealt + F.when(F.col("parts").isNull(), 0).otherwise(F.col("copy") % F.col("parts"))
    return rows.withColumn("shard", dealt % shards).select("shard", "page_id", "url", "html", "digest")


def _size(date: str) -> Column:
    return (F.octet_length(record("page_id", "url", "html", date)) + len(_END)).cast("long")


def warc_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The table's own list of records, from sharded pages: shard, idx, page_id, start, stop, hash (SHA-256 of a record's bytes).

    A shard is in the order of id, url and digest, nulls first; start and stop are a record's byte offsets in the shard's
    file. A null id, url or html is an empty one; repeated rows are records of their own. Line ends in urls are dropped.
    An empty table gives no records. No page is shuffled.
    """
    rows = pages.select("shard", "page_id", "url", "digest", _size(date).alias("bytes"), F.sha2(record("page_id", "url", "html", date), 256).alias("hash"))
    own = Window.partitionBy("shard").orderBy("page_id", "url", "digest")
    rows = rows.withColumn("stop", F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("idx", F.row_number().over(own).cast("long") - 1)
    return rows.select("shard", "idx", "page_id", (F.col("stop") - F.col("bytes")).alias("start"), "stop", "hash")


def write_warc(pages: DataFrame, path: str, shards: int, date: str = DATE) -> None:
    """Writes each shard of sharded pages as one gzipped WARC file in a folder shard=N; Spark's text writer ends each record.

    There are as many tasks as shards. A file is one gzip member, so records are found by their offsets once it is unpacked.
    """
    rows = pages.repartition(max(1, min(shards, 100_000)), "shard").sortWithinPartitions("shard", "page_id", "url", "digest")
    rows.select("shard", record("page_id", "url", "html", date).alias("record")).write.option("lineSep", _END).option("compression", "gzip").partitionBy("shard").text(path)


def _records(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, stop, bytes without the ending, whole) of each record; what can't be read is one record that isn't whole."""
    at, end = 0, _END.encode()
    while at < len(data):
        head = data.find(end, at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line) if head > 0 else {}
        size = fields.get("Content-Length", "")
        stop = head + len(end) + int(size) if size.isdigit() else len(data) + 1
        if not data.startswith(b"WARC/", at) or stop + len(end) > len(data) or data[stop : stop + len(end)] != end:
            yield at, len(data), data[at:], False
            return
        yield at, stop + len(end), data[at:stop], True
        at = stop + len(end)


_READ = pa.schema([("shard", pa.int64()), ("idx", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            gunzip = zlib.decompressobj(31)
            data = b""
            try:
                data = gunzip.decompress(content)
            except zlib.error:  # as far as it can be read: byte by byte up to the damage
                gunzip, data = zlib.decompressobj(31), bytearray()
                for at in range(0, len(content), 64):
                    try:
                        data += gunzip.decompress(content[at : at + 64])
                    except zlib.error:
                        break
                data = bytes(data)
            rows = []
            for idx, (start, stop, own, whole) in enumerate(_records(data)):
                head, _, html = own.partition(_END.encode())
                fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
                number = fields.get("WARC-Record-ID", "")[len("<urn:page:") : -1]
                rows.append((shard, idx, start, stop, hashlib.sha256(own).hexdigest(), int(number) if whole and number.lstrip("-").isdigit() else None, fields.get("WARC-Target-URI") if whole else None, html.decode("utf-8", "replace") if whole else None))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_READ)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ.types, strict=True)], schema=_READ)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below path: shard, idx, start, stop, hash, page_id, url, html.

    A file is read whole in one task, so shards have a bounded size. Damaged or cut ends of a file become one record
    without id, url and html.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:  # no file was written
        files = files.withColumn("shard", F.lit(None).cast("long"))
    return files.select(F.col("shard").cast("long"), "content").transform(in_batches, _parse, "shard long, idx long, start long, stop long, hash string, page_id long, url string, html string")


def merkle_tree(records: DataFrame, levels: int, fanout: int = 16) -> DataFrame:
    """Nodes (level, shard, idx, start, stop, hash): level 0 are records, a node above covers `fanout` that follow each other.

    Its hash is the SHA-256 of its children's offset ranges and hashes in order. `levels` must be so many that each
    shard ends in one node (levels_for). No group has more than `fanout` rows.
    """
    nodes = records.select(F.lit(0).alias("level"), "shard", "idx", "start", "stop", "hash")
    tree = nodes
    for level in range(1, levels + 1):
        child = F.struct("idx", F.concat(F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(":"), F.col("hash")).alias("text"))
        nodes = nodes.groupBy("shard", F.expr(f"idx div {fanout}").alias("up")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(child)).alias("children"))
        nodes = nodes.select(F.lit(level).alias("level"), "shard", F.col("up").alias("idx"), "start", "stop", F.sha2(F.array_join(F.transform("children", lambda c: c.text), ","), 256).alias("hash"))
        tree = tree.union(nodes)
    return tree


def levels_for(records: DataFrame, fanout: int = 16) -> int:
    most, levels = (records.agg(F.max("idx")).first()[0] or 0) + 1, 0
    while fanout**levels < most:
        levels += 1
    return levels


def audit(expected: DataFrame, found: DataFrame, levels: int, fanout: int = 16) -> DataFrame:
    """Records that differ between two trees: shard, idx, status (changed, missing or extra), start, stop (where it should be; of an extra one, where it is), hash, found_hash.

    Roots are compared first; below, only children of differing nodes are read. Equal trees end with the roots.
    """
    spark, differing = expected.sparkSession, None
    for level in range(levels, -1, -1):
        sides = []
        for tree, name in ((expected, "e"), (found, "f")):
            nodes = tree.where(F.col("level") == level)
            if differing is not None:
                nodes = nodes.withColumn("up", F.expr(f"idx div {fanout}")).join(differing.withColumnRenamed("idx", "up"), ["shard", "up"], "left_semi")
            sides.append(nodes.select("shard", "idx", F.struct("start", "stop", "hash").alias(name)))
        both = sides[0].join(sides[1], ["shard", "idx"], "full").where(~F.col("e").eqNullSafe(F.col("f")))
        if not level:
            status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("changed")
            return both.select("shard", "idx", status.alias("status"), *[F.coalesce(f"e.{c}", f"f.{c}").alias(c) for c in ("start", "stop")], F.col("e.hash").alias("hash"), F.col("f.hash").alias("found_hash"))
        differing = materialize(both.select("shard", "idx"), f"merkle-{level}")
        if differing.isEmpty():
            return spark.createDataFrame([], "shard long, idx long, status string, start long, stop long, hash string, found_hash string")
    raise AssertionError


def _rotten(pages: DataFrame) -> DataFrame:
    """Sharded pages as a damaged replica has them: of ids that are 7 mod 1000, the first byte of the html is another one, where it is ASCII."""
    hit = (F.pmod("page_id", F.lit(1000)) == 7) & F.col("html").rlike(r"^[\x20-\x7E]")
    return pages.withColumn("html", F.when(hit, F.concat(F.when(F.substring("html", 1, 1) == "?", "!").otherwise("?"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html")))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in shards. A replica in which some bytes have changed is written as files, read back and audited against the
    table's own tree: each record's place, hash and root, and whether the replica has it intact.
    """
    pages = sharded(table(spark, sf_dir, "pages"))
    records = materialize(warc_records(pages), "warc-records")
    path = new_path(spark, "warc")
    write_warc(_rotten(pages), path, records.agg(F.count_distinct("shard")).first()[0])
    levels = max(4, levels_for(records))
    expected = materialize(merkle_tree(records, levels), "warc-tree")
    found = materialize(merkle_tree(read_warc(spark, path), levels), "warc-found")
    wrong = audit(expected, found, levels).where("status <> 'extra'").select("shard", "idx", F.lit(False).alias("intact"))
    roots = expected.where(F.col("level") == levels).select("shard", F.col("hash").alias("shard_root"))
    out = records.join(roots, "shard").join(wrong, ["shard", "idx"], "left")
    return out.select("page_id", "shard", "idx", "start", "stop", F.col("hash").alias("record_sha256"), "shard_root", F.coalesce("intact", F.lit(True)).alias("intact"))


def _level(n: int) -> str:
    return f"l{n} AS (SELECT shard, idx // 16 AS idx, min(start) AS start, max(stop) AS stop, sha256(string_agg(start || '-' || stop || ':' || hash, ',' ORDER BY idx)) AS hash FROM l{n - 1} GROUP BY shard, idx // 16)"


SQL = f"""
WITH r AS (SELECT page_id, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
  || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || translate(coalesce(url, ''), chr(13) || chr(10), '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record,
  md5(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '') || ' ' || coalesce(html, '')) AS digest FROM pages),
s AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT % (SELECT greatest(1, ceil(sum(strlen(record) + 4) / 8000000.0))::BIGINT FROM r) AS shard FROM r),
l0 AS (SELECT page_id, shard, row_number() OVER w - 1 AS idx, (sum(strlen(record) + 4) OVER w)::BIGINT - strlen(record) - 4 AS start, (sum(strlen(record) + 4) OVER w)::BIGINT AS stop, sha256(record) AS hash,
  NOT coalesce(((page_id % 1000) + 1000) % 1000 = 7 AND regexp_matches(html, '^[ -~]'), false) AS intact FROM s
  WINDOW w AS (PARTITION BY shard ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{", ".join(_level(n) for n in range(1, 5))}
SELECT page_id, shard, l0.idx, l0.start, l0.stop, l0.hash AS record_sha256, l4.hash AS shard_root, intact FROM l0 JOIN l4 USING (shard)
"""
