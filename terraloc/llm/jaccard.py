"""Similarity components of sets of word shingles: a size-aware heavy-light Jaccard join.

Two sets of sizes a and b link when their intersection is at least c = 4 (a + b) / 9 (similarity 0.8), so b lies within
0.8 a and 1.25 a. Sets of up to a boundary size are light: for each partner size each of them gives all its subsets of c
shingles, and two that give the same subset link. Larger sets are heavy: each is listed under those of its shingles that
come first in one order of all shingles, as many as make it sure that linked sets share one, and the lists are scanned.
Light sets that a heavy one may link with are listed too. The boundary is the size at which enumerating costs least in
total, told from the sizes of all sets and from how often two sets share a frequent shingle.

The order puts shingles that aren't frequent first. Frequent ones are counted within stretches of a task
(WINDOW shingles), where those in LOCAL sets or more are reported, and summed; the order takes the HOT most frequent
ones, and whatever it takes, results are the same.

Equal sets are one node. A round takes, for each list and class of sizes, one node of each component so far and tests it
against the list's first, another one in each round; rounds go on while they find many links. Then only pairs of different components are left; they
are compared within each list, where lengths, places in the order and parities of shingles' numbers by bucket rule out nearly all.
Each pair that is left in any round is tested by its whole sets, once, so subsets and lists only propose.

Shingles are compared by 64-bit hashes of all their bytes. Bounded: sets of one size class in a list are combined in
partial aggregates; lists of over GROUP_ROWS nodes are cut into pairs of blocks; a pair's test holds two sets, and a
node with many pairs is dealt to several tasks. HOT bounds what is broadcast. Time for the last step grows with the pairs
of different components that share a list.

Defined cases: a null or wordless text has an empty set and links with nothing; fewer than five words are one shingle;
equal sets link; of repeated rows each is a row of the result, and texts with one doc_id are judged each by itself; rows
without a doc_id have no result; an empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import binary_lists, discard, hot_join, partitions, salted_join, save, table, utf8
from terraloc.llm.simhash import _groups, components

WORDS = 5
WINDOW = 1 << 21
LOCAL = 4
HOT = 1 << 19
#: The largest size that the boundary may have, and what testing one proposed pair costs in rows.
LIGHT_MOST = 20
TEST_ROWS = 20
GROUP_ROWS = 4096
BROADCAST_ROWS = 1 << 19
#: Rounds end when one finds no more than this part of all links.
LAST_SHARE = 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: By k, the bits of a little-endian number's first k bytes.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def needed(a, b):
    """The least intersection of linked sets of sizes a and b."""
    return -(-4 * (a + b) // 9)


def prefix(n):
    """How many first shingles of a set of size n hold one of each linked set's first ones."""
    return n + (-4 * n // 5) + 1


def partner_sizes(n: int) -> range:
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the text's words in order: of up to 16 bytes by two numbers that hold them, of longer ones by their XXH64."""
    own = b" " + text.lower() + b" " * 17
    blank = BLANK[np.frombuffer(own, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(own) - 7, "<u8", own, strides=(1,))
    h = mix((eight[starts] & FIRST_BYTES[np.minimum(sizes, 8)]) + FACTOR * sizes.astype(np.uint64))
    h = mix(h + (eight[np.minimum(starts + 8, len(eight) - 1)] & FIRST_BYTES[np.clip(sizes - 8, 0, 8)]))
    for i in np.flatnonzero(sizes > 16).tolist():
        h[i] = xxhash.xxh64_intdigest(own[starts[i] : starts[i] + sizes[i]])
    return h


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles."""
    w = word_hashes(text)
    wide = min(WORDS, len(w))
    if not wide:
        return np.zeros(0, np.uint64)
    n = len(w) - wide + 1
    h = np.full(n, wide, np.uint64)
    for k in range(wide):
        h = h * FACTOR + w[k : k + n]
    h = np.sort(mix(h))
    return h[np.append(True, h[1:] != h[:-1])]


def parities(h: np.ndarray) -> bytes:
    """A bit for each of a power of two of buckets, 2 to 4 for each hash: whether it holds an odd number of them."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many parities of paired sets differ, which is at most how many members do. The longer one's halves are added up until both are of a length."""
    out = np.empty(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        out[k] = np.bitwise_count(x ^ y).sum()
    return out


def _sets(batches):
    """Rows of kind 0: doc_id, the set's 128-bit hash and size, and parities by bucket; of kind 1: shingles frequent in a stretch, and how often."""
    held, size, seen = [], 0, set()

    def frequent():
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.sort(np.concatenate(held))
        at = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
        counts = np.diff(np.append(at, len(h)))
        return h[at][counts >= LOCAL], counts[counts >= LOCAL]

    def rows(kind, ids, hi, lo, n, sketch):
        return pa.record_batch([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(np.asarray(n, np.int64)), pa.array(sketch, pa.binary())], names=["kind", "doc_id", "hi", "lo", "n", "sketch"])

    def reported():
        h, counts = frequent()
        return rows(1, pa.nulls(len(h), pa.int64()), h, np.zeros(len(h), np.uint64), counts, [None] * len(h))

    for b in batches:
        keys, n, sketch = [], [], []
        for t in binary_lists(b.column(1)):
            h = shingle_set(t)
            key = xxhash.xxh3_128_digest(h.tobytes())
            keys.append(key)
            n.append(len(h))
            sketch.append(parities(h))
            if key not in seen:
                seen.add(key)
                held.append(h)
                size += len(h)
            if size >= WINDOW:
                yield reported()
                held, size, seen = [], 0, set()
        named = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
        yield rows(0, b.column(0), named[:, 0].copy(), named[:, 1].copy(), n, sketch)
    yield reported()


def sets(docs: DataFrame) -> DataFrame:
    return save(_own(docs).mapInArrow(_sets, "kind int, doc_id long, hi long, lo long, n long, sketch binary"), "sets")


def _own(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))


def boundary(sizes: dict[int, int], shared: float) -> int:
    """The size up to which enumerating subsets costs least in total. sizes: sets by size; shared: the chance that two sets list a common frequent shingle."""
    best, least, light = 0, sum(_scan(n, sizes, shared) for n in sizes if n <= LIGHT_MOST), 0
    rest = least
    for n in range(1, LIGHT_MOST + 1):
        light += sizes.get(n, 0) * sum(comb(n, needed(n, b)) for b in partner_sizes(n))
        rest -= _scan(n, sizes, shared) if n in sizes else 0
        if light + rest <= least:
            best, least = n, light + rest
    return best


def _scan(n: int, sizes: dict[int, int], shared: float) -> float:
    """Rows for listing the sets of size n, and for testing those that share a list by chance."""
    return sizes[n] * (prefix(n) + TEST_ROWS * min(1.0, shared * prefix(n)) * sum(sizes.get(b, 0) for b in partner_sizes(n)))


@cache
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def subsets(h: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all subsets that a light set shares with its light partners: 64 bits, 31 bits more, and minus the partner's size."""
    n, out = len(h), []
    for b in partner_sizes(n):
        if b <= most:
            salt = np.uint64(min(n, b) * 64 + max(n, b))
            at = _choices(n, needed(n, b))
            one, two = (mix(mix(h + np.uint64(s))[at].sum(1, dtype=np.uint64) + salt) for s in (1, 2))
            out.append((one, two >> np.uint64(33), np.full(len(at), -b, np.int64)))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64) for k in range(3))


def _first(h: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's first shingles: those that aren't hot by hash, then the hot ones by number."""
    k = prefix(len(h))
    if not len(hot):
        return h[:k]
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    is_hot = hot[at] == h
    rare = h[~is_hot][:k]
    if len(rare) == k:
        return rare
    own = h[is_hot]
    return np.concatenate((rare, own[np.lexsort((own, counts[at[is_hot]]))][: k - len(rare)]))


def _listed(hot, most: int):
    """Whole texts to packed lists: doc_id, the set's hash, its first shingles and, for light sets, its subsets."""

    def run(batches):
        names, counts = hot.value
        for b in batches:
            keys, firsts, lights = [], [], []
            for t in binary_lists(b.column(1)):
                h = shingle_set(t)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                heavy = len(h) and 5 * len(h) // 4 > most
                firsts.append(_first(h, names, counts).tobytes() if heavy else b"")
                lights.append(np.stack(subsets(h, most)).astype("<u8").tobytes() if 0 < len(h) <= most else b"")
            named = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(named[:, 0].copy()), pa.array(named[:, 1].copy()), pa.array(firsts, pa.binary()), pa.array(lights, pa.binary())], names=["doc_id", "hi", "lo", "firsts", "lights"])

    return run


def _postings(hot):
    def run(batches):
        names, _ = hot.value
        for b in batches:
            nodes, sizes = b.column("node").to_numpy(), b.column("n").to_numpy()
            out = []
            for node, n, first, light in zip(nodes.tolist(), sizes.tolist(), b.column("firsts").to_pylist(), b.column("lights").to_pylist(), strict=True):
                f, s = np.frombuffer(first, np.uint64), np.frombuffer(light, "<u8").reshape(3, -1)
                m = len(f) + s.shape[1]
                part = np.zeros(len(f), np.int64)
                if len(names) and len(f):
                    is_hot = names[np.minimum(np.searchsorted(names, f), len(names) - 1)] == f
                    part[is_hot] = 1 + (node * 0x9E3779B1 >> 16) % 64
                out.append((np.concatenate((f, s[0])), np.concatenate((part, s[1].astype(np.int64))), np.full(m, node), np.full(m, n), np.concatenate((np.arange(1, len(f) + 1), s[2].view(np.int64)))))
            cols = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(5)]
            for a in range(0, len(cols[0]), 1 << 18):
                some = [x[a : a + (1 << 18)] for x in cols]
                yield pa.record_batch([pa.array(some[0].view(np.int64)), pa.array(some[1].astype(np.int32)), pa.array(some[2]), pa.array(some[3].astype(np.int32)), pa.array(some[4].astype(np.int32))], names=["token", "part", "node", "n", "pos"])

    return run


def _shared(batches):
    """Sorted by token and part: rows whose neighbour has the same token, and all of hot tokens (part over 0)."""
    last = None

    def kept(b, ahead):
        t, p, pos = (b.column(c).to_numpy() for c in ("token", "part", "pos"))
        same = (t[1:] == t[:-1]) & (p[1:] == p[:-1])
        near = np.append(same, ahead is not None and ahead == (t[-1], p[-1]))
        near |= np.append(before is not None and before == (t[0], p[0]), same)
        return b.filter(pa.array(near | ((p > 0) & (pos > 0))))

    before = None
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            yield kept(last, (b.column("token")[0].as_py(), b.column("part")[0].as_py()))
            before = (last.column("token")[-1].as_py(), last.column("part")[-1].as_py())
        last = b
    if last is not None:
        yield kept(last, None)


def _tested(batches):
    """Sorted by v, part and kind: a hub's text (kind 0), then the texts of its partners. Pairs that link."""
    own, hub = None, None
    for b in batches:
        us, vs = [], []
        for v, kind, u, t in zip(b.column("v").to_pylist(), b.column("kind").to_pylist(), b.column("u").to_pylist(), binary_lists(b.column("text")), strict=True):
            if kind == 0:
                own, hub = shingle_set(t), v
            elif hub == v:
                h = shingle_set(t)
                at = np.searchsorted(own, h)
                both = int((own[np.minimum(at, len(own) - 1)] == h).sum())
                if both >= needed(len(own), len(h)):
                    us.append(u)
                    vs.append(v)
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _likely(batches):
    """Pairs whose parities don't rule out a link."""
    for b in batches:
        if b.num_rows:
            s, t = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("su", "sv"))
            total = b.column("total").to_numpy()
            yield b.select(["u", "v"]).filter(pa.array(apart(s, t) <= total - 2 * needed(total, 0)))


class Joined:
    """The nodes, their lists, the pairs tested and the links found."""

    def __init__(self, docs: DataFrame, most: int | None = None):
        self.docs, self.spark = docs, docs.sparkSession
        self.sets = sets(docs)
        grouped = self.sets.filter("kind = 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("sketch").alias("sketch"))
        self.nodes = save(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
        # At most HOT rows, and a row for each small size.
        hot = self.sets.filter("kind = 1").groupBy("hi").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "hi").limit(HOT).toArrow()
        names, counts = hot.column("hi").to_numpy().view(np.uint64), hot.column("c").to_numpy()
        order = np.argsort(names)
        self.hot = self.spark.sparkContext.broadcast((names[order], counts[order]))
        total = self.nodes.count()
        if most is None:
            sizes = {r.n: r["count"] for r in self.nodes.filter(f"n between 1 and {5 * LIGHT_MOST // 4}").groupBy("n").count().collect()}
            most = boundary(sizes, float((counts / max(total, 1)) @ (counts / max(total, 1))) if total else 0.0)
        self.most = most
        self.lists = self._lists()
        self.links: DataFrame | None = None
        self.seen: DataFrame | None = None

    def _lists(self) -> DataFrame:
        packed = _own(self.docs).mapInArrow(_listed(self.hot, self.most), "doc_id long, hi long, lo long, firsts binary, lights binary")
        named = packed.join(self.nodes.select(F.col("first").alias("doc_id"), "hi", "lo", "n", "node").filter("n > 0"), ["doc_id", "hi", "lo"]).select("node", "n", "firsts", "lights")
        rows = named.mapInArrow(_postings(self.hot), "token long, part int, node long, n int, pos int")
        dealt = rows.repartition(partitions(self.spark), "token", "part").sortWithinPartitions("token", "part")
        shared = save(dealt.mapInArrow(_shared, "token long, part int, node long, n int, pos int"), "lists")
        # Of a light list the key is the token, the part and the partner's size; of a heavy one the token.
        return shared.withColumn("key", F.when(F.col("pos") > 0, F.col("token")).otherwise(F.xxhash64("token", "part")))

    def comps(self) -> DataFrame | None:
        return save(components(self.links), "comps") if self.links is not None else None

    def test(self, pairs: DataFrame, tag: str) -> int:
        """Tests new pairs (u, v, total of sizes) by their whole sets; the number of links found."""
        pairs = pairs.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"), "total").filter("u <> v").distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["u", "v"], "left_anti")
        pairs = save(pairs, f"{tag}-pairs")
        marks = self.nodes.select("node", "sketch")
        sides = pairs.join(marks.toDF("u", "su"), "u").join(marks.toDF("v", "sv"), "v")
        likely = save(sides.mapInArrow(_likely, "u long, v long"), f"{tag}-likely")
        self.seen = pairs.select("u", "v") if self.seen is None else self.seen.unionByName(pairs.select("u", "v"))
        asked = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
        asked = save(asked.join(self.nodes, "node").select("node", F.col("first").alias("doc_id"), "hi", "lo"), f"{tag}-asked")
        n = asked.count()
        if not n:
            return 0
        # Beyond that size both sides are shuffled by doc_id.
        named = _own(self.docs).join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, "doc_id")
        # A doc_id may have several texts, so the sets' hashes tell whose text it is.
        texts = named.mapInArrow(_matching, "node long, text binary").dropDuplicates(["node"]) if self._repeated() else named.select("node", "text")
        texts = save(texts, f"{tag}-texts")
        sizes = likely.groupBy("v").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
        sizes = save(sizes, f"{tag}-parts")
        partners = salted_join(likely, sizes, ["v"], deal="u").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
        partners = partners.join(texts.toDF("u", "text"), "u").select("v", "part", F.lit(1).alias("kind"), "u", "text")
        hubs = sizes.join(texts.toDF("v", "text"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("v").alias("u"), "text")
        dealt = partners.unionByName(hubs).repartition(partitions(self.spark), "v", "part").sortWithinPartitions("v", "part", "kind")
        found = save(dealt.mapInArrow(_tested, "u long, v long"), f"{tag}-links")
        discard(texts)
        n = found.count()
        if n:
            self.links = found if self.links is None else self.links.unionByName(found)
        return n

    def _repeated(self) -> bool:
        if not hasattr(self, "_again"):
            self._again = not self.sets.filter("kind = 0").groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty()
        return self._again

    def labelled(self) -> DataFrame:
        """The lists with each node's component so far."""
        comps = self.comps()
        rows = self.lists.join(comps.withColumnRenamed("u", "node"), "node", "left") if comps is not None else self.lists.withColumn("component", F.lit(None).cast("long"))
        return rows.withColumn("component", F.coalesce("component", "node"))

    def stars(self, turn: int) -> int:
        """One node of each component in a list's class of sizes, against the first of them: by number in turn 0, so that lists have the same first ones, and else by hashes that differ between lists and turns."""
        tag = f"stars{turn}"
        # In a class of a heavy list sizes are within 1.25 of each other; in a light list all of a size are in one class, and go with the other size's.
        level = F.when(F.col("pos") > 0, F.floor(F.log(F.col("n") + 0.5) / float(np.log(1.25)))).otherwise(-F.col("n"))
        rows = self.labelled().withColumn("level", level.cast("int"))
        rows = rows.groupBy("key", "level", "component").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("rank") if turn else F.col("node").alias("rank"), "node", "n", "pos")).alias("p"))
        rows = save(rows, f"{tag}-reps")
        heavy, light = rows.filter("level >= 0"), rows.filter("level < 0")
        hubs = save(heavy.groupBy("key", "level").agg(F.min("p").alias("hub"), F.count("*").alias("rows")).filter("rows > 1"), f"{tag}-hubs")
        pairs = hot_join(heavy, hubs, ["key", "level"]).select("p", "hub")
        tops = light.groupBy("key", F.col("p.n").alias("n"), F.col("p.pos").alias("pos")).agg(F.min("p").alias("hub"), F.count("*").alias("rows"))
        tops = save(tops, f"{tag}-tops")
        # Under a key of sizes a and b the sets of size a link with those of size b.
        other = light.select("key", F.col("component"), F.col("p"), (-F.col("p.pos")).cast("int").alias("n"), (-F.col("p.n")).cast("int").alias("pos"))
        pairs = pairs.unionByName(hot_join(other, tops, ["key", "n", "pos"]).select("p", "hub"))
        return self.test(pairs.filter(_near("p", "hub")).select(F.col("p.node").alias("u"), F.col("hub.node").alias("v"), (F.col("p.n") + F.col("hub.n")).cast("long").alias("total")), tag)

    def rest(self) -> int:
        """All pairs of different components that share a list and aren't ruled out."""
        rows = save(self.labelled().filter("pos > 0").select("token", "node", "n", "pos", "component"), "labelled")
        open_ = rows.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows")).filter("least <> most")
        open_ = save(open_.select("token", "rows", F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("cuts")), "open")
        rows = hot_join(rows, open_, ["token"]).join(self.nodes.select("node", "sketch"), "node")
        own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        rows = rows.withColumn("part", F.least("own", "other") * F.col("cuts") + F.greatest("own", "other"))
        rows = rows.select("token", "part", "node", "n", "pos", "component", "sketch")
        dealt = rows.repartition(partitions(self.spark), "token", "part").sortWithinPartitions("token", "part")
        return self.test(dealt.mapInArrow(_crossed, "u long, v long, total long"), "rest")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        named = self.nodes.select("node", "hi", "lo", "n", "first", "rows")
        comps = self.comps()
        if comps is not None:
            named = named.join(comps.withColumnRenamed("u", "node"), "node", "left")
            named = save(named.withColumn("component", F.coalesce("component", "node")), "named")
            least = save(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "least")
            named = hot_join(named.drop("first").withColumnRenamed("rows", "times"), least.withColumnRenamed("members", "rows"), ["component"]).withColumnRenamed("times", "rows")
        else:
            named = named.withColumnRenamed("first", "component_id")
        named = save(named.select("hi", "lo", "n", "component_id", "rows"), "ids")
        out = hot_join(self.sets.filter("kind = 0").select("doc_id", "hi", "lo", "n"), named, ["hi", "lo", "n"])
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _near(a: str, b: str):
    """Sizes and places in the order that a link allows; subsets (places under 0) always."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    return (p < 0) | ((4 * n <= 5 * m) & (4 * m <= 5 * n) & (9 * (F.least(p, q) + F.least(n - p, m - q)) >= 4 * (n + m)))


def _matching(batches):
    for b in batches:
        names = b.schema.names
        keep = []
        for i, (t, hi, lo) in enumerate(zip(binary_lists(b.column(names.index("text"))), b.column("hi").to_pylist(), b.column("lo").to_pylist(), strict=True)):
            key = np.frombuffer(xxhash.xxh3_128_digest(shingle_set(t).tobytes()), ">u8").astype(np.uint64).view(np.int64)
            if key.tolist() == [hi, lo]:
                keep.append(i)
        yield b.select(["node", "text"]).take(pa.array(keep, pa.int64()))


def crossed(g: dict[str, np.ndarray], step: int = 256):
    """u, v, total of the pairs of a list, of different components, that sizes, places and parities don't rule out."""
    order = np.argsort(g["n"], kind="stable")
    node, n, pos, comp = (g[c][order].astype(np.int64) for c in ("node", "n", "pos", "component"))
    marks = [np.frombuffer(x, np.uint64) for x in g["sketch"][order].tolist()]
    wide = np.array([len(x) for x in marks])
    by_width = {w: folded(marks, wide, w) for w in np.unique(wide).tolist()}
    for a in range(0, len(node), step):
        i = slice(a, a + step)
        end = int(np.searchsorted(n, 5 * n[i].max() // 4, side="right"))
        j = slice(a, end)
        a_n, b_n, p, q = n[i, None], n[None, j], pos[i, None], pos[None, j]
        ok = (comp[i, None] != comp[None, j]) & (4 * b_n <= 5 * a_n) & (np.arange(a, a + len(n[i]))[:, None] < np.arange(a, end)[None, :])
        ok &= 9 * (np.minimum(p, q) + np.minimum(a_n - p, b_n - q)) >= 4 * (a_n + b_n)
        left, right = np.nonzero(ok)
        for w in np.unique(wide[i]).tolist():  # sizes grow along the list, so the left one's parities are the shorter
            own = np.nonzero(wide[left + a] == w)[0]
            at, same = by_width[w]
            block = max(1, (4 << 20) // (8 * w))
            for k in range(0, len(own), block):
                u, v = left[own[k : k + block]] + a, right[own[k : k + block]] + a
                total = n[u] + n[v]
                keep = np.bitwise_count(same[at[u]] ^ same[at[v]]).sum(1, dtype=np.int64) <= total - 2 * needed(total, 0)
                if keep.any():
                    yield node[u[keep]], node[v[keep]], total[keep]


def folded(marks: list[np.ndarray], wide: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The parities of width w, or of the next two widths brought to it, as rows of one array, and each one's row."""
    own = np.nonzero((wide >= w) & (wide <= 4 * w))[0]
    out = np.empty((len(own), w), np.uint64)
    for k, i in enumerate(own.tolist()):
        out[k] = np.bitwise_xor.reduce(marks[i].reshape(-1, w), axis=0)
    at = np.full(len(marks), -1)
    at[own] = np.arange(len(own))
    return at, out


def _crossed(batches):
    for g in _groups(batches, ["token", "part"]):
        for u, v, total in crossed(g):
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(total)], names=["u", "v", "total"])


def jaccard_components(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row with a doc_id. most: the boundary between light and heavy sets, by default that of least cost."""
    join = Joined(docs, most)
    found, turn = [], 0
    while not turn or found[-1] * LAST_SHARE > sum(found):
        found.append(join.stars(turn))
        turn += 1
    join.rest()
    return join.result()


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS n, CAST(doc_id AS BIGINT) AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT n, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])) END AS own
  FROM w),
c AS (SELECT md5(array_to_string(own, chr(10))) AS id, any_value(own) AS own, any_value(len(own)) AS size, min(doc_id) AS first FROM s WHERE len(own) > 0 GROUP BY 1),
t AS (SELECT id, size, hash(unnest(own)) AS g FROM c),
links AS MATERIALIZED (
  SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON a.g = b.g AND a.id < b.id AND 4 * a.size <= 5 * b.size AND 4 * b.size <= 5 * a.size
  GROUP BY a.id, b.id, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT id, id AS top FROM c
  UNION
  SELECT b.v, r.top FROM reach r JOIN both_ways b ON b.u = r.id),
comp AS (SELECT r.id, min(c.first) AS component_id FROM reach r JOIN c ON c.id = r.top GROUP BY r.id)
SELECT s.doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN comp ON len(s.own) > 0 AND comp.id = md5(array_to_string(s.own, chr(10)))
"""
