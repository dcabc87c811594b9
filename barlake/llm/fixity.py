"""Merkle fixity audit of WARC archives.

Archives are WARC files that Spark writes; an index is what reading them gives: each record's place, offset, length and
SHA-256. The tree of a file hashes the records of FANOUT consecutive keys, in order and with their offsets from the first of
them, then FANOUT neighbouring nodes and so on up to its root. Two replicas are compared root by root; only below roots
that differ are their children compared, and so on down, which ends at the records of damaged offset ranges. A record
that is lost or has another length shifts what follows it in the file but not within the ranges after its own, so the
damage stays in one branch. No tree is gathered anywhere: a node is an aggregate over its children, a leaf over the
records of its keys, which are no more than a volume holds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, shared_dir

FANOUT = 16
#: Levels above the ranges of records; FANOUT ^ (LEVELS + 1) keys make an archive.
LEVELS = 2
PER_ARCHIVE = FANOUT ** (LEVELS + 1)
#: Bytes of a file; an archive of more bytes, or of more records than keys, is dealt to several volumes.
VOLUME_BYTES = 256 << 20
_EOL = "\r\n"
_HEAD = re.compile(rb"WARC/1\.1\r\n(?:[^\r]*\r\n)*?WARC-Record-ID: <urn:page:(-?\d*)>\r\n(?:[^\r]*\r\n)*?Content-Length: (\d+)\r\n\r\n")


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text, but for its last line end; Content-Length counts bytes of its UTF-8 form."""
    body = F.coalesce(body, F.lit(""))
    size = F.octet_length(body).cast("string")
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: resource{_EOL}WARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(f">{_EOL}WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", ""),
        F.lit(f"{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), size, F.lit(_EOL + _EOL), body, F.lit(_EOL),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", content: str = "html") -> None:
    """Write each row as a record of a gzipped WARC file under path/archive=N/volume=V.

    An archive holds PER_ARCHIVE consecutive keys in key order, null keys are archive -1. Where keys are repeated (or
    null) or texts are long, an archive has more than PER_ARCHIVE records or VOLUME_BYTES bytes; it is then dealt by
    hash to as many volumes as that takes (a power of two), each in key order. Equal records go to one volume, in two
    replicas the same, unless they would fill one. Records of one key follow each other by their
    hash. Null urls and contents are empty, line ends in urls are left out. An empty table writes nothing.
    """
    record = warc_record(F.col(key), F.col(url).cast("string"), F.col(content).cast("string"))
    number = F.coalesce(F.floor(F.col(key).cast("long") / PER_ARCHIVE), F.lit(-1)).cast("long")
    rows = pages.select(number.alias("archive"), F.col(key).cast("long").alias("key"), record.alias("record"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("same", F.xxhash64("key", "record"))
    share = F.greatest(F.count(F.lit(1)) / PER_ARCHIVE, F.sum(F.octet_length("record")) / VOLUME_BYTES)
    several = F.pow(F.lit(2), F.ceil(F.log2(share))).cast("int").alias("volumes")
    volumes = materialize(rows.groupBy("archive").agg(several).where("volumes > 1"), "volumes")  # few archives have several
    if volumes.isEmpty():
        dealt = rows.withColumn("volume", F.lit(0))
    else:
        # many equal records are dealt by their rows' places in the input, so that a repeated task deals them alike
        counts = rows.select("archive", "same", F.octet_length("record").alias("size")).join(volumes, "archive").groupBy("archive", "same").agg(F.count(F.lit(1)).alias("times"), F.sum("size").alias("size"))
        counts = materialize(counts.where((F.col("times") > PER_ARCHIVE) | (F.col("size") > VOLUME_BYTES)).select("archive", "same", F.lit(True).alias("many")), "many")
        by = F.when(F.coalesce("many", F.lit(False)), F.xxhash64("row")).otherwise(F.col("same"))
        dealt = rows.join(volumes, "archive", "left").join(counts, ["archive", "same"], "left").withColumn("volume", F.coalesce(F.pmod(by, F.col("volumes")), F.lit(0)).cast("int"))
    order = ["archive", "volume", "key", F.xxhash64("record")]
    dealt.repartition("archive", "volume").sortWithinPartitions(*order).select("archive", "volume", "record").write.partitionBy("archive", "volume").option("lineSep", _EOL).option("compression", "gzip").text(path)


def records_of(data: bytes) -> Iterator[tuple[int | None, int, int, str]]:
    """(key, offset, length, SHA-256) of each record of a WARC file."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        end = m.end() + int(m[2]) + 4 if m else 0
        if not m or data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at offset {at}")
        yield int(m[1]) if m[1] else None, at, end - at, hashlib.sha256(memoryview(data)[at:end]).hexdigest()
        at = end


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, volume, nth, key, offset, length, sha256) of each record of the files under path, read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, volume, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                rows = list(records_of(zlib.decompress(content.as_buffer(), 31)))
                n = len(rows)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if n else [pa.array([], t) for t in kinds]
                fixed = [pa.array([archive.as_py()] * n, pa.int64()), pa.array([volume.as_py()] * n, pa.int32()), pa.array(range(n), pa.int64())]
                yield pa.record_batch([*fixed, *own], ["archive", "volume", "nth", "key", "offset", "length", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    part = lambda name: F.regexp_extract("path", rf"/{name}=(-?\d+)/", 1)
    named = files.select(part("archive").cast("long").alias("archive"), part("volume").cast("int").alias("volume"), "content")
    return named.mapInArrow(run, "archive long, volume int, nth long, key long, offset long, length long, sha256 string")


def archive_index(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """The index of the archives of pages, which are written to the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, key, url, content)
    return materialize(read_index(spark, path), "index")


def _hash_of(children: Column, shown) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(children), shown), ","), 256)


def _leaf(absolute: bool) -> Column:
    """The leaf of a record: of its key, or where offsets count in the whole file, of its place."""
    place = F.col("nth") if absolute else F.pmod(F.coalesce("key", F.lit(0)), F.lit(PER_ARCHIVE))
    return F.floor(place / FANOUT).cast("long").alias("node")


def leaves(index: DataFrame, absolute: bool = False) -> DataFrame:
    """(archive, volume, node, hash): level 0, a node for the records of FANOUT consecutive keys with their offsets from the first.

    If absolute, for FANOUT consecutive records with their offsets in the file.
    """
    list_ = F.collect_list(F.struct("nth", "offset", "length", "sha256")).alias("list")
    start = F.lit(0).cast("long") if absolute else F.array_min(F.col("list.offset"))
    shown = lambda c: F.concat_ws(":", (c["offset"] - F.col("start")).cast("string"), c["length"].cast("string"), c["sha256"])
    lists = index.groupBy("archive", "volume", _leaf(absolute)).agg(list_).withColumn("start", start)
    return lists.select("archive", "volume", "node", _hash_of(F.col("list"), shown).alias("hash"))


def parents(level: DataFrame) -> DataFrame:
    """The level above: hashes of FANOUT neighbouring nodes, in order and with their places."""
    shown = lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])
    return level.groupBy("archive", "volume", F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(_hash_of(F.collect_list(F.struct("node", "hash")), shown).alias("hash"))


def tree(index: DataFrame, absolute: bool = False) -> list[DataFrame]:
    """Levels from the leaves to the roots."""
    levels = [materialize(leaves(index, absolute), "leaves")]
    for _ in range(LEVELS):
        levels.append(parents(levels[-1]))
    return levels


def descend(ours: list[DataFrame], theirs: list[DataFrame]) -> list[DataFrame]:
    """The nodes that differ between two trees, the roots first; only children of nodes that differ are compared."""
    node = ["archive", "volume", "node"]
    found: list[DataFrame] = []
    for depth in range(LEVELS, -1, -1):
        a, b = ours[depth], theirs[depth]
        if found:
            up = found[-1].withColumnRenamed("node", "up")
            a, b = (x.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(up, ["archive", "volume", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.withColumnRenamed("hash", "x").join(b.withColumnRenamed("hash", "y"), node, "full_outer")
        found.append(materialize(both.where("not x <=> y").select(*node), "branches"))
    return found


def audit(primary: DataFrame, replica: DataFrame, moved: bool = False) -> DataFrame:
    """Records of two archive indexes that differ: (key, archive, offset, length, primary_sha256, replica_sha256, status).

    status is changed, missing (not in the replica) or extra (not in the primary, with the replica's offset), and where
    asked for moved (the same record of the same archive at another offset, such as after one that changed its length). Equal replicas,
    and two empty ones, give no rows. Repeated records count as often as they occur. A changed record of a repeated key
    is reported as one missing and one extra.
    """
    open_ = descend(tree(primary, moved), tree(replica, moved))[-1]
    below = [x.withColumn("node", _leaf(moved)).join(open_, ["archive", "volume", "node"], "left_semi").drop("node", "nth") for x in (primary, replica)]
    # how often a record occurs on each side; a null key is one like any other
    record = ["archive", "none", "key", "sha256"]
    shown = ["archive", "volume", F.col("key").isNull().alias("none"), F.coalesce("key", F.lit(0)).alias("key"), "offset", "length", "sha256"]
    left, right = (x.select(*shown) for x in below)
    times = left.groupBy(*record).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*record).agg(F.count(F.lit(1)).alias("r")), record, "full_outer").na.fill(0, ["l", "r"])
    times = materialize(times, "times")

    def excess(side: DataFrame, own: str, other: str) -> DataFrame:
        whole = side.join(times.where(f"{other} = 0").select(*record), record, "left_semi").select(*side.columns)
        some = side.join(times.where(f"{other} > 0 and {own} > {other}").select(*record, other), record)
        nth = F.row_number().over(Window.partitionBy(*record).orderBy(F.col("volume").desc(), F.col("offset").desc()))
        return whole.union(some.withColumn("_nth", nth).where(F.col("_nth") > F.col(other)).select(*side.columns))

    gone, new = materialize(excess(left, "l", "r"), "gone"), materialize(excess(right, "r", "l"), "new")
    own_key = ["archive", "none", "key"]
    count = lambda d, name: d.groupBy(*own_key).agg(F.count(F.lit(1)).alias(name))
    pairs = count(gone, "g").join(count(new, "n"), own_key).where("g = 1 and n = 1").select(*own_key)
    changed = pairs.join(gone, own_key).join(new.select(*own_key, F.col("sha256").alias("other")), own_key)
    place = ["archive", "volume", "offset", "none", "key", "sha256"]
    none = F.lit(None).cast("string")
    key = F.when(~F.col("none"), F.col("key")).alias("key")
    shape = lambda d, p, r, status: d.select(key, "archive", "offset", "length", p.alias("primary_sha256"), r.alias("replica_sha256"), F.lit(status).alias("status"))
    out = shape(changed, F.col("sha256"), F.col("other"), "changed")
    out = out.union(shape(gone.join(pairs, own_key, "left_anti"), F.col("sha256"), none, "missing"))
    out = out.union(shape(new.join(pairs, own_key, "left_anti"), none, F.col("sha256"), "extra"))
    if moved:
        same = left.join(right.select(*place), place, "left_anti").join(gone.select(*place), place, "left_anti")
        out = out.union(shape(same, F.col("sha256"), F.col("sha256"), "moved"))
    return out


def damaged_replica(pages: DataFrame, key: str = "page_id", content: str = "html") -> DataFrame:
    """A replica with known damage, to audit: the last character of every 97th record is lost, every 389th is missing."""
    k = F.col(key)
    kept = pages.where(F.coalesce(k % 389 != 7, F.lit(True)))
    body = F.col(content)
    return kept.withColumn(content, F.when(k % 97 == 13, F.substring(body, F.lit(1), F.greatest(F.length(body) - 1, F.lit(0)))).otherwise(body))
