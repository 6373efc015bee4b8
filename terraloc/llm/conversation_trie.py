"""Prefix trie of conversations by radix partitioning of dictionary-encoded turns.

Turns get ids from a dictionary of distinct (role, text), so that later steps move numbers. Conversations with equal
sequences are one class, with its smallest conversation and its number; the trie is built over classes. A bucket is the
classes below one node. While a bucket holds more than LOCAL_TURNS turns it is cut by the id of the first turn at which
its classes differ (most significant first; turns that all share are skipped at once and are a chain of nodes). Other
buckets are dealt to tasks, where a multikey quicksort over the rest of their turns emits nodes. A class alone in its
bucket needs no sorting: its nodes are its turns, row by row. At last the cut buckets are summed up from below.

Nodes are named by their smallest member and depth, which no two share. Counts below a node go upwards level by level:
in tasks for local buckets, by aggregation for cut ones.

Bounded: a task buffers a bucket of LOCAL_TURNS turns at most. Steps on keys that may hold a third of all rows (a
conversation, a turn, a node) are partial aggregations or joins whose hot keys are dealt to several tasks; places of
turns, sums along a class and the hash of a node's ends follow one order each and stream through sorted tasks. A round
of jobs per branching level is made while a bucket is larger than LOCAL_TURNS.

Defined cases: rows without a conv_id take no part; a null role or text is empty; turns are ordered by turn, null first,
and equal turns by role, the first 64 characters of the text and a hash; repeated rows are turns of their own; remainders take the sign of the conv_id, so that
conv_id - conv_id % 100 goes towards zero, and a conversation that is its own base isn't changed; without conversations
there is no root, and the result is empty; columns other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.llm.common import hot_join, partitions, salted_join, save, table

LOCAL_TURNS = 1 << 14
#: Turns of buckets that a task sorts at once.
CHUNK_TURNS = 1 << 16
BASE = 100
SHARED = 6
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_cls long"
NAMES = [x.split()[0] for x in NODE.split(", ")]


def encoded(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), id, cp (code points of the text), saved."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role tells where it ends; the hash stands for the turn from here on.
    key = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256)), 1, 16)
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.char_length(text).alias("cp"), role.alias("role"), F.substring(text, 1, 64).alias("head"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "key")
    placed = save(own.select("conv", F.row_number().over(order).cast("long").alias("pos"), "key", "cp"), "placed")
    terms = save(placed.groupBy("key").agg(F.count("*").alias("rows")).select("key", "rows", F.monotonically_increasing_id().alias("id")), "terms")
    return save(hot_join(placed, terms, ["key"]).select("conv", "pos", "id", "cp"), "encoded")


def rebuilt(turns: DataFrame, base: int = BASE, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """The sequences (conv, pos, id, cp) in which the first h turns are those of the conversation's base, and all conversations with their numbers of turns; both saved."""
    own = save(turns.groupBy("conv").agg(F.count("*").alias("n")), "own")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    convs = own.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % base).alias("base"))
    tops = own.filter(F.col("conv") % base == 0).select(F.col("conv").alias("base"), F.least("n", F.lit(shared - 1)).alias("first"))
    convs = save(convs.join(tops, "base", "left").select("conv", "base", "n", "h", F.least("h", F.coalesce("first", F.lit(0))).alias("taken")), "convs")
    heads = convs.filter("taken > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken").cast("long"))).alias("pos"))
    firsts = turns.filter(F.col("pos") < shared).filter(F.col("conv") % base == 0).withColumnRenamed("conv", "base")
    heads = heads.join(firsts, ["base", "pos"]).select("conv", "pos", "id", "cp")
    tails = salted_join(turns.filter(F.col("pos") > h), convs.select("conv", "h", "taken"), ["conv"], deal="pos")
    tails = tails.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "cp")
    lengths = convs.select("conv", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("taken")).alias("len"))
    return save(heads.unionByName(tails), "rebuilt"), save(lengths, "lengths")


def _ends(batches):
    """Sorted by class and conversation: the hash of each class's conversations, carried on from row to row."""
    held, state = None, hashlib.sha256()
    for b in batches:
        cls, conv = b.column("cls").to_numpy(), b.column("conv").to_numpy()
        cuts = np.append(np.nonzero(np.append(True, cls[1:] != cls[:-1]))[0], len(cls)) if len(cls) else [0]
        done: list[tuple[int, str]] = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            names = ",".join(map(str, conv[i:j].tolist())).encode()
            if held is not None and held == cls[i]:
                state.update(b"," + names)
                continue
            if held is not None:
                done.append((held, state.hexdigest()))
            held, state = int(cls[i]), hashlib.sha256(names)
        yield pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["cls", "ends"])
    if held is not None:
        yield pa.record_batch([pa.array([held], pa.int64()), pa.array([state.hexdigest()])], names=["cls", "ends"])


def classes(seqs: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cls (smallest conversation), len, w (conversations) of each distinct sequence; and cls, ends. Both saved."""
    spark = seqs.sparkSession
    # Turns of a conversation differ in pos, so that no two of these hashes cancel out.
    marks = seqs.groupBy("conv").agg(F.bit_xor(F.xxhash64("pos", "id")).alias("d1"), F.bit_xor(F.xxhash64("id", "pos", F.lit(7))).alias("d2"))
    known = save(lengths.join(marks, "conv", "left").na.fill(0, ["d1", "d2"]), "marks")
    own = save(known.groupBy("len", "d1", "d2").agg(F.min("conv").alias("cls"), F.count("*").alias("rows")), "classes")
    members = hot_join(known, own, ["len", "d1", "d2"]).select("cls", "conv")
    ends = members.repartition(partitions(spark), "cls").sortWithinPartitions("cls", "conv").mapInArrow(_ends, "cls long, ends string")
    return own.select("cls", "len", F.col("rows").alias("w")), save(ends, "ends")


class Trie:
    """Nodes below the tops of local buckets, in lists."""

    def __init__(self):
        self.node: list[list[int]] = []  # conv, depth, parent's place (or -1 - top), members, children, leaves, saved, class that ends here
        self.tops: list[list[int]] = []

    def bucket(self, top: tuple[int, int], seqs: list[tuple[list[int], list[int], int, int]]) -> None:
        """seqs: ids and code points after the top, smallest conversation and weight of each class; distinct, none empty."""
        self.tops.append([*top, 0, 0, 0])
        here = -len(self.tops)
        stack = [(seqs, 0, here)]
        while stack:
            own, d, parent = stack.pop()
            pivot = own[len(own) // 2][0][d]
            less, more = [s for s in own if s[0][d] < pivot], [s for s in own if s[0][d] > pivot]
            for side in (less, more):
                if side:
                    stack.append((side, d, parent))
            same = [s for s in own if s[0][d] == pivot]
            conv, w, cp = min(s[2] for s in same), sum(s[3] for s in same), same[0][1][d]
            self.node.append([conv, top[1] + d + 1, parent, w, 0, 0, (w - 1) * cp, next((s[2] for s in same if len(s[0]) == d + 1), None)])
            rest = [s for s in same if len(s[0]) > d + 1]
            if rest:
                stack.append((rest, d + 1, len(self.node) - 1))

    def rows(self) -> list[list]:
        """Nodes as [0, ...] and tops as [1, ...], in the order of NODE."""
        parents = []
        for x in reversed(self.node):  # what is below a node comes after it
            x[5] = x[5] or 1
            up = self.node[x[2]] if x[2] >= 0 else None
            if up:
                up[4] += 1
                up[5] += x[5]
                up[6] += x[6]
                parents.append(up[0])
            else:
                top = self.tops[-1 - x[2]]
                top[2] += 1
                top[3] += x[5]
                top[4] += x[6]
                parents.append(top[0])
        nodes = [[0, x[0], x[1], p, *x[3:]] for x, p in zip(self.node, reversed(parents), strict=True)]
        return nodes + [[1, t[0], t[1], 0, 0, *t[2:], None] for t in self.tops]


def _sorted_buckets(batches):
    """Rows sorted by top_conv, top_depth, cls and pos; buckets end where the top changes."""
    names = ["top_conv", "top_depth", "cls", "w", "id", "cp"]
    held: list[np.ndarray] = []
    size = 0

    def solved(x: np.ndarray):
        trie = Trie()
        tops = np.append(np.nonzero(np.append(True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])))[0], x.shape[1])
        for i, j in zip(tops[:-1].tolist(), tops[1:].tolist(), strict=True):
            y = x[:, i:j]
            cuts = np.append(np.nonzero(np.append(True, y[2, 1:] != y[2, :-1]))[0], j - i).tolist()
            ids, cps = y[4].tolist(), y[5].tolist()
            trie.bucket((int(y[0, 0]), int(y[1, 0])), [(ids[a:b], cps[a:b], int(y[2, a]), int(y[3, a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*trie.rows(), strict=True)], names=["kind", *NAMES])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(np.stack([b.column(c).to_numpy() for c in names]))
        size += b.num_rows
        if size >= CHUNK_TURNS:
            x = np.hstack(held)
            other = np.nonzero((x[0] != x[0, -1]) | (x[1] != x[1, -1]))[0]  # the last bucket may go on
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield solved(x[:, :cut])
            held, size = [x[:, cut:]], x.shape[1] - cut
    if held:
        yield solved(np.hstack(held))


def _split(active: DataFrame, seqs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """active: cls, w, len, top_conv, top_depth of large buckets, saved. Shared chains, nodes after the branch, and the classes that go on below these."""
    tops = ["top_conv", "top_depth"]
    rows = salted_join(seqs, active, ["cls"], deal="pos").filter("pos > top_depth")
    rows = save(rows.select(*tops, "cls", "w", "len", "pos", "id", "cp"), f"{tag}-rows")
    level = rows.groupBy(*tops, "pos").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), F.first("cp").alias("cp"))
    # All of a bucket's classes have a turn after the top, as those that end there have left it.
    sizes = active.groupBy(*tops).agg(F.count("*").alias("all"), F.sum("w").alias("n_convs"), F.min("cls").alias("conv"))
    level = save(level.join(sizes, tops), f"{tag}-level")
    branch = level.filter("least <> most or n < all").groupBy(*tops).agg(F.min("pos").alias("at"))
    branch = save(branch.join(sizes, tops).select(*tops, "at", "n_convs", "conv"), f"{tag}-branch")
    chain = level.join(branch.select(*tops, "at"), tops).filter("pos < at").select(*tops, "at", "pos", "cp", "n_convs", "conv")
    # At most one class ends before the branch, as the others there are distinct from it.
    over = active.groupBy(*tops, F.col("len").alias("pos")).agg(F.min("cls").alias("end_cls"))
    chain = chain.join(over, [*tops, "pos"], "left")
    # A bucket is large, so there are few of them; its rows at the branch are dealt by class.
    at = salted_join(rows, branch.select(*tops, "at"), tops, deal="cls").filter("pos = at").select(*tops, "cls", "w", "len", "at", "id", "cp")
    at = save(at, f"{tag}-at")
    kids = at.groupBy(*tops, "at", "id").agg(F.min("cls").alias("conv"), F.sum("w").alias("n_convs"), F.first("cp").alias("cp"), F.count("*").alias("rows"), F.max(F.when(F.col("len") == F.col("at"), F.col("cls"))).alias("end_cls"))
    kids = save(kids, f"{tag}-kids")
    below = hot_join(at.filter("len > at"), kids.select(*tops, "id", "conv", "rows"), [*tops, "id"])
    below = below.select("cls", "w", "len", F.col("conv").alias("top_conv"), F.col("at").alias("top_depth"))
    return save(chain, f"{tag}-chain"), kids.drop("rows", "id"), save(below, f"{tag}-below")


def build(seqs: DataFrame, own: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie of classes `own` (cls, len, w) with sequences `seqs` (conv, pos, id, cp)."""
    spark = seqs.sparkSession
    root = own.agg(F.min("cls").alias("conv"), F.sum("w").alias("n_convs")).first()
    if root.conv is None:
        return spark.createDataFrame([], NODE)
    seqs = save(seqs.withColumnRenamed("conv", "cls").join(own.filter("len > 0").select("cls"), "cls", "left_semi"), "sequences")
    tops = ["top_conv", "top_depth"]
    active = own.filter("len > 0").select("cls", "w", "len", F.lit(root.conv).cast("long").alias("top_conv"), F.lit(0).cast("long").alias("top_depth"))
    rounds, settled = [], []
    while True:
        active = save(active, "active")
        sizes = save(active.groupBy(*tops).agg(F.count("*").alias("rows"), F.sum(F.col("len") - F.col("top_depth")).alias("turns")), "sizes")
        sized = save(hot_join(active, sizes.select(*tops, "rows", F.col("rows").alias("n"), "turns"), tops), "sized")
        large = (F.col("n") > 1) & (F.col("turns") > local_turns)
        settled.append(sized.filter(~large))
        big = sized.filter(large).drop("n", "turns")
        if big.isEmpty():
            break
        chain, kids, active = _split(save(big, "big"), seqs, f"radix{len(rounds)}")
        rounds.append((chain, kids))
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    every = save(every, "settled")

    # Classes alone in their bucket: nodes are their turns.
    alone = salted_join(seqs, every.select("cls", "w", "len", *tops, "n"), ["cls"], deal="pos").filter("n is not null and pos > top_depth")
    alone = save(alone, "rest")
    onward = Window.partitionBy("cls").orderBy(F.desc("pos"))
    single = alone.filter("n = 1").withColumn("saved", F.when(F.col("w") > 1, (F.col("w") - 1) * F.sum("cp").over(onward)).otherwise(F.lit(0)).cast("long"))
    single = save(single, "single")
    parent = F.when(F.col("pos") == F.col("top_depth") + 1, F.col("top_conv")).otherwise(F.col("cls"))
    one = F.lit(1).cast("long")
    nodes = single.select(F.col("cls"), F.col("pos"), parent, "w", (F.col("pos") < F.col("len")).cast("long"), one, "saved", F.when(F.col("pos") == F.col("len"), F.col("cls"))).toDF(*NAMES)
    below = single.filter("pos = top_depth + 1").select(*tops, one.alias("n_children"), one.alias("n_leaves"), F.col("saved").alias("saved_below"))

    local = alone.filter("n > 1").select(*tops, "cls", "w", "pos", "id", F.col("cp").cast("long").alias("cp"))
    local = local.repartition(partitions(spark), *tops).sortWithinPartitions(*tops, "cls", "pos")
    local = save(local.mapInArrow(_sorted_buckets, f"kind long, {NODE}"), "local")
    nodes = nodes.unionByName(local.filter("kind = 0").drop("kind"))
    below = below.unionByName(local.filter("kind = 1").select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"), "n_children", "n_leaves", F.col("saved_tokens").alias("saved_below")))

    for k, (chain, kids) in reversed(list(enumerate(rounds))):
        below = save(below, f"below{k}")
        under = below.withColumnsRenamed({"top_conv": "conv", "top_depth": "at"})
        full = kids.join(under, ["conv", "at"], "left").na.fill(0, ["n_children", "saved_below"]).na.fill(1, ["n_leaves"])
        full = save(full.withColumn("saved", (F.col("n_convs") - 1) * F.col("cp") + F.col("saved_below")), f"full{k}")
        sums = save(full.groupBy(*tops, "at").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("kept")), f"sums{k}")
        onward = Window.partitionBy(*tops).orderBy(F.desc("pos"))
        links = chain.join(sums, [*tops, "at"]).withColumn("saved", F.col("kept") + (F.col("n_convs") - 1) * F.sum("cp").over(onward))
        links = save(links, f"links{k}")
        last = F.col("pos") == F.col("at") - 1
        first = F.col("pos") == F.col("top_depth") + 1
        nodes = nodes.unionByName(links.select("conv", "pos", F.when(first, F.col("top_conv")).otherwise(F.col("conv")), "n_convs", F.when(last, F.col("kids")).otherwise(1), "leaves", "saved", "end_cls").toDF(*NAMES))
        bucket_conv = links.filter(last).select(*tops, F.col("conv").alias("via"))
        nodes = nodes.unionByName(full.join(bucket_conv, tops, "left").select("conv", "at", F.coalesce("via", "top_conv"), "n_convs", "n_children", "n_leaves", "saved", "end_cls").toDF(*NAMES))
        straight = sums.join(links.select(*tops).distinct(), tops, "left_anti").select(*tops, F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("kept").alias("saved_below"))
        chained = links.filter(first).select(*tops, one.alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_below"))
        below = below.unionByName(straight).unionByName(chained)
    of_root = below.filter((F.col("top_conv") == root.conv) & (F.col("top_depth") == 0)).agg(F.coalesce(F.sum("n_children"), F.lit(0)), F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_below"), F.lit(0)))
    zero = F.lit(0).cast("long")
    end = F.lit(own.filter("len = 0").agg(F.min("cls")).first()[0]).cast("long")
    return nodes.unionByName(of_root.toDF(*NAMES[4:7]).select(F.lit(root.conv).cast("long"), zero, F.lit(None).cast("long"), F.lit(root.n_convs).cast("long"), *NAMES[4:7], end).toDF(*NAMES))


def prefix_trie(conversations: DataFrame, base: int = BASE, shared: int = SHARED, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations, each with the hash of the conversations that end there."""
    seqs, lengths = rebuilt(encoded(conversations), base, shared)
    own, ends = classes(seqs, lengths)
    nodes = save(build(seqs, own, local_turns), "nodes")
    named = nodes.join(ends.withColumnRenamed("cls", "end_cls"), "end_cls", "left")
    return named.select(*NAMES[:7], F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# CRC-32 by its eight steps for each byte, as DuckDB has no function for it; conv_ids are digits and a sign.
OP13_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, count(*) AS n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')],
    lambda a, b: list_reduce([xor(a, b)] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 6 AS h
  FROM t GROUP BY c),
own AS (
  SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100),
r AS (
  SELECT own.c, t.pos, role, text FROM own JOIN t ON t.c = own.c - own.c % 100 AND t.pos <= own.taken
  UNION ALL
  SELECT own.c, t.pos - own.h + own.taken, role, text FROM own JOIN t ON t.c = own.c AND t.pos > own.h),
s AS (SELECT own.c, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq FROM own LEFT JOIN r ON r.c = own.c GROUP BY own.c),
m AS (SELECT c, d, seq[:d] AS path, len(seq) AS n FROM s, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)),
node AS (
  SELECT min(c) AS conv_id, d AS depth, path, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY d, path),
child AS (SELECT p.conv_id AS parent, n.* FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM child WHERE depth > 0 GROUP BY ALL),
every AS (SELECT child.*, coalesce(kids.n, 0) AS n_children FROM child LEFT JOIN kids ON kids.parent = child.conv_id AND kids.depth = child.depth),
below AS (SELECT path[:d] AS top, d, n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END AS saved FROM every, LATERAL (SELECT unnest(range(0, depth + 1)) AS d)),
sums AS (SELECT top, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM below GROUP BY top, d)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM every JOIN sums ON sums.d = every.depth AND sums.top = every.path
"""
