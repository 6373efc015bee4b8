"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into blocks of 23, 23 and 18. Two fingerprints that differ in at most 4 bits differ in
at most 1 bit of the first block, or at most 1 of the second, or not at all in the third: otherwise there were at
least 2 + 2 + 1 differing bits. The anchors of a 23-bit block are the words of the binary Golay code, whose covering
radius is 3, and a fingerprint goes to each anchor within 3 + 1 of its block, about 5 of them. The anchors of the
18-bit block are all words (radius 0, threshold 0). So each linked pair meets at the anchor nearest to one of the two.

Fingerprints are compared once per distinct value. An anchor that more than GROUP_ROWS of them reach is cut into
blocks, and each pair of blocks is a task of its own. A group gives a spanning forest, never its pairs.

Defined cases: null texts are empty; texts without words have fingerprint 0 and link like any other; equal texts have
equal fingerprints; an empty table gives an empty result; rows without a
doc_id have no result, and near_dedup keeps them; columns other than doc_id and text aren't read. Of several texts with
one doc_id near_dedup judges each by itself; repeated rows with equal doc_id and text are one document and stay or go
together.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import binary_lists, discard, fresh, partitions, salted_join, save, table, utf8

WORDS = 4
SEED = 42
MAX_BITS = 4
GROUP_ROWS = 4096
#: The generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
LOW23 = (1 << 23) - 1


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -WORDS]))
    digest = xxhash.xxh64_intdigest
    n, counts = len(starts), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        cut = zip(starts[a : a + (1 << 16)].tolist(), (ends[WORDS - 1 :][a : a + (1 << 16)] - 1).tolist(), strict=True)
        h = np.array([digest(joined[i:j], SEED) for i, j in cut], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in binary_lists(b.column(1))], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(fps), b.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), text_hash (which tells texts with one doc_id apart)."""
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), F.xxhash64(utf8()).alias("text_hash"))
    return own.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def _remainders(bits: int, shift: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for i in range(bits):
        r = 1 << (i + shift)
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        out[1 << i : 2 << i] = out[: 1 << i] ^ r
    return out


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and by syndrome the errors of weight 4 or less, filled up with -1."""
    low, high = _remainders(12, 0), _remainders(11, 12)
    errors = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    syndrome = low[errors & 4095] ^ high[errors >> 12]
    order = np.argsort(syndrome, kind="stable")
    counts = np.bincount(syndrome, minlength=2048)
    out = np.full((2048, counts.max()), -1, np.int64)
    first = np.cumsum(counts) - counts
    out[syndrome[order], np.arange(len(order)) - first[syndrome[order]]] = errors[order]
    return low, high, out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: row numbers and the anchors that each goes to (block in the top bits)."""
    low, high, errors = golay_tables()
    rows, keys = [], []
    for block in (0, 1):
        y = (fps >> np.uint64(23 * block)).astype(np.int64) & LOW23
        e = errors[low[y & 4095] ^ high[y >> 12]]
        at, which = np.nonzero(e >= 0)
        rows.append(at)
        keys.append((y[at] ^ e[at, which]) | block << 40)
    rows.append(np.arange(len(fps)))
    keys.append((fps >> np.uint64(46)).astype(np.int64) | 2 << 40)
    return np.concatenate(rows), np.concatenate(keys)


def _to_anchors(batches):
    for b in batches:
        fps, nodes = b.column("fp").to_numpy(), b.column("node").to_numpy()
        rows, keys = anchors(fps.view(np.uint64))
        yield pa.record_batch([pa.array(keys), pa.array(fps[rows]), pa.array(nodes[rows])], names=["anchor", "fp", "node"])


def forest(fps: np.ndarray, nodes: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links each fingerprint of a group to the smallest node of its component within the group; roots are left out.

    Goes from hub to hub: a fingerprint near a hub is joined to it at once and is later compared only if it isn't yet in
    the same component as what it is compared with.
    """
    order = np.argsort(nodes, kind="stable")
    fps, nodes, n = fps[order], nodes[order], len(fps)
    root = np.arange(n)
    if n <= 1024:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        near_rows = [np.nonzero(near[i])[0] for i in np.nonzero(near.sum(1) > 1)[0]]
        heads = np.nonzero(near.sum(1) > 1)[0]
    else:
        heads, near_rows = range(n), None
    for k, i in enumerate(heads):
        hit = near_rows[k] if near_rows is not None else np.nonzero(np.bitwise_count(fps ^ fps[i]) <= bits)[0]
        found = np.unique(root[hit])
        if len(found) > 1:
            root[np.isin(root, found[1:])] = found[0]
    child = np.nonzero(root != np.arange(n))[0]
    return nodes[child], nodes[root[child]]


def _several(at: np.ndarray):
    """Starts and ends of the groups with two rows or more."""
    wide = np.nonzero(np.diff(at) > 1)[0]
    return zip(at[wide].tolist(), at[wide + 1].tolist(), strict=True)


def _groups(batches, keys: list[str]):
    """Arrow batches that are sorted by the keys, as a dict of column arrays for each key with two rows or more."""
    held: list[pa.RecordBatch] = []

    def solved(t: pa.Table):
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        cut = np.zeros(t.num_rows, bool)
        cut[0] = True
        for k in keys:
            cut[1:] |= cols[k][1:] != cols[k][:-1]
        return cols, np.append(np.nonzero(cut)[0], t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if all(b.column(k)[-1] == held[0].column(k)[0] for k in keys):
            continue
        cols, at = solved(pa.Table.from_batches(held))
        for i, j in _several(at[:-1]):
            yield {c: v[i:j] for c, v in cols.items()}
        held = [pa.RecordBatch.from_arrays([pa.array(v[at[-2] :]) for v in cols.values()], schema=b.schema)]
    if held:
        cols, at = solved(pa.Table.from_batches(held))
        for i, j in _several(at):
            yield {c: v[i:j] for c, v in cols.items()}


def _links(batches):
    out: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        return pa.record_batch([pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)) for k in (0, 1)], names=["u", "v"])

    for g in _groups(batches, ["anchor", "part"]):
        u, v = forest(g["fp"].view(np.uint64), g["node"])
        if len(u):
            out.append((u, v))
            size += len(u)
        if size > 50_000:
            yield flush()
            out, size = [], 0
    yield flush()


def links(nodes: DataFrame) -> DataFrame:
    """nodes: fp, node (both unique). u, v with u > v: links whose components are those of all pairs within MAX_BITS."""
    spark = nodes.sparkSession
    at = nodes.mapInArrow(_to_anchors, "anchor long, fp long, node long")
    sizes = at.groupBy("anchor").count()
    # At most a row for each of the 2 * 4096 + 2^18 anchors, whatever the input.
    hot = {r.anchor: -(-r["count"] // GROUP_ROWS) for r in sizes.filter(F.col("count") > GROUP_ROWS).collect()}
    at = at.withColumn("part", F.lit(0))
    if hot:
        cuts = spark.createDataFrame([(int(k), int(m)) for k, m in hot.items()], "anchor long, cuts int")
        at = at.drop("part").join(F.broadcast(cuts), "anchor", "left")
        cuts, own, other = F.coalesce("cuts", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("cuts", F.lit(1))), F.col("other")
        pair = F.least(own, other) * cuts + F.greatest(own, other)
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1))).select("anchor", "fp", "node", pair.cast("int").alias("part"))
    dealt = at.repartition(partitions(spark), "anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """u, component (the smallest node that u reaches) for all nodes with a link to a smaller one. Alternates large-star and small-star steps until nothing changes; each round is a table in the shared folder."""
    edges = save(edges.select("u", "v"), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select("u", F.col("v").alias("component"))
        seen = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = salted_join(both, least, ["u"], salts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = salted_join(large, least, ["u"], salts)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        before, edges = edges, save(small, "edges")
        discard(before)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, component_id for each row of docs with a doc_id."""
    fps = save(fingerprints(docs), "fps")
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    comps = components(links(nodes))
    named = save(nodes.join(comps.hint("merge"), nodes.node == comps.u, "left").select("fp", F.coalesce("component", "node").alias("component_id")), "comps")
    return salted_join(fps, named, ["fp"], deal="doc_id").select("doc_id", "fp", "text_hash", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without those that link, over any chain, to one with a smaller doc_id, or to another text of theirs with a smaller hash."""
    found = simhash_components(docs)
    first = found.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("least"))
    first = first.withColumnRenamed("component_id", "first_id")
    id_name, hash_name = fresh(docs, "gone_id", "gone_hash")
    gone = salted_join(found.withColumn("first_id", F.col("component_id")), first, ["first_id"], deal="doc_id")
    gone = gone.filter((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.col("least")))
    gone = gone.select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).hint("merge")
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(id_name)) & (F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit(b""))) == F.col(hash_name)), "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
