"""WARC archives, and a capture index by external merging.

Pages become records of `.warc.gz` files in the shared folder: a gzip member for each record, and a warcinfo record
first. Files are written by Spark's text writer, whose rows are members without their last byte; that is the highest
byte of the member's length, 0, and the writer's line separator is that byte (a member of 16 MiB and more is followed by
an empty one, so that it ends in 0 too). Spark reads the files as binary ones. Each file's captures are sorted by URL
key, timestamp and page_id: a run. Runs are cut at common splitters, taken from a sample of keys, into ranges of about
RANGE_ROWS captures, and each range merges its runs with a loser tree, so that ranges and positions in them are one
global order. Keys end in page_id, so a URL with very many captures spreads over ranges, and ranges of about one size fit
a task however many captures there are.

Of records with equal payloads of at least `least` bytes the one with the smallest page_id is a response, and the others
revisit it. Pages have no capture time; theirs is EPOCH plus page_id seconds.

Bounded: the driver sees the splitters' sample, 32 keys for each of MOST_RANGES ranges at most, and the ranges' sizes.
Files hold as many records as make ARCHIVE_BYTES of average payloads.

Defined cases: null html is an empty payload; null urls are empty; control characters and blanks of a url are escaped in
the record; rows without a page_id have no record; of repeated rows with one page_id all are records, and those with
equal payloads are alike; an empty table gives an empty result; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import new_path, partitions, salted_join, save, table, utf8

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
ARCHIVE_BYTES = 16 << 20
RANGE_ROWS = 200_000
MOST_RANGES = 1 << 16
#: Bytes of an archive that go to the decompressor at a time.
STEP = 1 << 14
END = b"\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def timestamp(page_id: int) -> datetime:
    return EPOCH + timedelta(seconds=page_id % 10**10)


def escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int, url: str, payload: bytes, size: int, digest: str, first: int | None) -> bytes:
    """One gzip member; a revisit (first is the page it refers to) has no payload, but tells its size and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {escaped(url)}",
        f"WARC-Date: {timestamp(page_id).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return member("\r\n".join(head).encode("utf-8", "surrogatepass") + END + END + block + END + END)


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def warcinfo(name: str) -> bytes:
    block = b"software: terraloc\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {EPOCH.strftime('%Y-%m-%dT%H:%M:%SZ')}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return member("\r\n".join(head).encode() + END + END + block + END + END)


def line(data: bytes) -> bytes:
    """A gzip member without its last byte, which the writer's line separator 0 adds."""
    return (data if not data[-1] else data + member(b""))[:-1]


def records(data: bytes):
    """Offset, headers and block of each record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        start, stretch, parts = at, zlib.decompressobj(31), []
        while not stretch.eof and at < len(data):
            parts.append(stretch.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data))
        if not stretch.eof:
            raise ValueError(f"truncated record at {start}")
        at -= len(stretch.unused_data)
        whole = b"".join(parts)
        if not whole:  # ends a long record
            continue
        head, _, rest = whole.partition(END + END)
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields["Content-Length"])
        block = rest[:size]
        if not lines[0].startswith("WARC/") or len(block) != size or rest[size:] != END + END:
            raise ValueError(f"broken record at {start}")
        yield start, fields, block


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_key(url: str) -> str:
    """Host labels from the last to the first, A-Z in lower case, then the rest: com,example)/path."""
    rest = url.split("://", 1)[-1]
    host, path = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    return ",".join(reversed(host.translate(str.maketrans(UPPER, LOWER)).split("."))) + ")" + (path or "/")


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes a record for each page into .warc.gz files in the folder path."""
    spark = pages.sparkSession
    known = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), utf8("html").alias("payload"))
    average = known.agg(F.avg(F.octet_length("payload"))).first()[0] or 0.0
    per_file = int(min(max(ARCHIVE_BYTES / (average + 500), 2), 1 << 20))
    known = known.withColumn("sha", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    same = known.filter("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = save(same.filter("n > 1").select("sha", "first"), "payloads")
    joined = salted_join(known, same, ["sha"], deal="page_id").select("page_id", "url", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first"), "sha", "payload")

    def run(batches):
        """Lines; the writer opens a file every per_file lines, so that each begins with a warcinfo record."""
        count, part = 0, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for i, url, first, sha, payload in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "first", "sha", "payload")), strict=True):
                if count % (per_file - 1) == 0:
                    out.append(line(warcinfo(f"{part}-{count // (per_file - 1)}")))
                count += 1
                digest = base64.b32encode(bytes.fromhex(sha)).decode() if sha else base32_sha1(payload)
                out.append(line(record(i, url, payload, len(payload), digest, first)))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["line"])

    lines = joined.mapInArrow(run, "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), folder.suffix(f"/{name.removesuffix('.txt')}.warc.gz"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (a file's name), data (its bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


CAPTURES = "run string, place long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
_TYPES = {"string": pa.string(), "long": pa.int64()}
SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in CAPTURES.split(", ")])


def captures(stored: DataFrame) -> DataFrame:
    """CAPTURES of the records of archives, each archive's in order: a run. Payloads that are there are checked."""

    def run(batches):
        for b in batches:
            for archive, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist(), strict=True):
                out = []
                for offset, fields, block in records(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(END + END)
                    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"broken payload of {fields['WARC-Record-ID']}")
                    of = lambda f: int(fields[f].removeprefix("<urn:page:").rstrip(">")) if f in fields else None  # noqa: B023,E731
                    out.append((url_key(fields["WARC-Target-URI"]), re.sub(r"\D", "", fields["WARC-Date"]), of("WARC-Record-ID"), size, digest, fields["WARC-Type"], of("WARC-Refers-To"), offset))
                out.sort(key=lambda x: x[:3])
                cols = [[archive] * len(out), range(len(out)), *zip(*out, strict=True)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

    return stored.mapInArrow(run, CAPTURES)


class LoserTree:
    """The least of k sorted lists at a time, with one comparison a level."""

    def __init__(self, lists: list[list]):
        self.lists, self.at, self.k = lists, [0] * len(lists), max(1, len(lists))
        self.tree = [-1] * self.k  # losers; the winner is at 0
        for i in range(len(lists)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.lists[a]) or self.at[b] >= len(self.lists[b]):
            return self.at[a] < len(self.lists[a])
        return (self.lists[a][self.at[a]], a) < (self.lists[b][self.at[b]], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:  # the first to come waits
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.lists and self.at[w := self.tree[0]] < len(self.lists[w]):
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


INDEX = "range int, place long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long"


def merged_index(found: DataFrame) -> DataFrame:
    """found: saved captures. position, and the columns of INDEX but range and place: in the order of position they are ordered by URL key, timestamp and page_id."""
    spark = found.sparkSession
    n = found.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS), min(partitions(spark), n // 1000)))
    sample = found.select("url_key", "captured", "page_id", F.xxhash64("page_id", "run").alias("h")).orderBy("h", "page_id").limit(max(4096, 32 * ranges))
    keys = sorted(zip(*(c.to_pylist() for c in sample.drop("h").toArrow().columns), strict=True))
    splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def ranged(batches):
        for b in batches:
            own = [bisect_right(splitters, key) for key in zip(*(b.column(c).to_pylist() for c in ("url_key", "captured", "page_id")), strict=True)]
            yield pa.record_batch([pa.array(own, pa.int32()), *b.columns], names=["range", *b.schema.names])

    def merge(t):
        t = t.sort_by([("run", "ascending"), ("place", "ascending")])
        runs: dict[str, list] = {}
        for k, (run, *key) in enumerate(zip(*(t.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id")), strict=True)):
            runs.setdefault(run, []).append((*key, k))
        t = t.take(pa.array([x[-1] for x in LoserTree(list(runs.values()))], pa.int64()))
        names = [x.split()[0] for x in INDEX.split(", ")]
        return t.set_column(t.column_names.index("place"), "place", pa.array(range(len(t)), pa.int64())).select(names)

    index = save(found.mapInArrow(ranged, "range int, " + CAPTURES).groupBy("range").applyInArrow(merge, INDEX), "index")
    before, starts = 0, []
    for r in index.groupBy("range").count().sort("range").collect():  # MOST_RANGES rows at most
        starts.append((r.range, before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "range int, before long"))
    return index.join(starts, "range").withColumn("position", F.col("before") + F.col("place")).drop("range", "before", "place")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = save(captures(read_archives(spark, path)), "captures")
    return merged_index(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def _escaped_sql(url: str) -> str:
    for code in (*range(0x21), 0x7F):
        url = f"replace({url}, chr({code}), '%{code:02X}')"
    return url


OP9_SQL = f"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, {_escaped_sql("coalesce(url, '')")} AS url, encode(coalesce(html, '')) AS payload
  FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE url END AS rest FROM d),
k AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_replace(rest, '^[^/?#]*', '') AS path,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 10000000000), '%Y%m%d%H%M%S') AS captured FROM f),
i AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key FROM k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 5 * (j // 4) + 1, 5))::INTEGER >> (15 - 5 * (j % 4))) & 31) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
FROM i
"""
