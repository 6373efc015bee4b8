"""Repeated 50-byte strings by suffix arrays, with the difference cover modulo 3.

Suffixes are sorted bucket by bucket. A bucket holds all strings with the same minimizer: of the K-byte strings inside
a 50-byte window the one with the smallest hash, so that equal windows have equal minimizers wherever they stand. A
stretch of neighbouring windows with one minimizer travels as one string of 50 to 50 + W - 1 bytes. Equal strings of a
bucket are first made one, with the smallest doc_id that has it. The rest of a bucket is laid end to end and its suffix
array is built by the difference cover: sampled triples are sorted and named, the names' string is sorted by recursion,
the other suffixes are sorted by first symbol and sampled rank and merged in; then prefixes of neighbouring suffixes
are compared.

Rounds, each a shuffle by group of documents or by bucket:
1. each group of documents tells the minimizers' buckets which minimizers it has (6 bytes each), in how many documents
   and strings;
2. the buckets answer which of them occur in two documents or more: no other window can repeat;
3. the groups send the strings of these minimizers, each distinct string once, with its smallest doc_id;
4. the buckets sort suffixes and answer, for each string, the smallest doc_id that has all of it, and which of its
   windows occur in a document with a smaller id still;
5. the groups mark the bytes.
A minimizer of over HOT strings, counted in all documents, is dealt by window instead, so that its windows spread over
all buckets and the strings of any other fit one suffix array.

Defined cases: null texts are empty; texts under 50 bytes lose nothing; documents with equal ids don't count as smaller
than one another; an empty table gives an empty result; rows without a doc_id have no result in `removed` and stay as
they are in `dedup`; all other columns pass through `dedup` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import give_back, partitions, splits, table

WINDOW = 50
K = 20
W = WINDOW - K + 1
LONGEST = WINDOW + W - 1
WIDE = 88
#: Bytes of text that one group of documents has, about.
GROUP_BYTES = 16 << 20
MOST_BUCKETS = 4096
HOT = 4000
#: Bytes that one pass over minimizers takes, and symbols of one suffix array; HOT strings have fewer.
CHUNK = 1 << 19
SORTED = 1 << 20
H48 = np.uint64((1 << 48) - 1)


def hashes(buf: np.ndarray) -> np.ndarray:
    """48-bit hash of the K bytes from each place of a byte array that ends in WIDE more bytes."""
    n = len(buf) - WIDE
    word = lambda k: np.ndarray((n,), "<u8", buf.data, k, (1,))
    with np.errstate(over="ignore"):
        h = word(0) * np.uint64(0x9E3779B97F4A7C15) ^ word(8) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h += word(K - 8)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(16)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of a matrix of WIDE bytes a row."""
    odd = np.random.default_rng(20240229).integers(1, 1 << 63, WIDE // 8, np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        x = rows.view("<u8") * odd
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x = np.add.reduce(x ^ (x >> np.uint64(27)), axis=1) * odd[0]
        return x ^ (x >> np.uint64(32))


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct one, and for each row the number of its distinct one. Equal hashes are checked."""
    _, first, inverse = np.unique(row_hashes(rows), return_index=True, return_inverse=True)
    words = rows.view("<u8")
    if not (words == words[first[inverse]]).all():
        _, first, inverse = np.unique(rows.view(f"V{WIDE}").ravel(), return_index=True, return_inverse=True)
    return first, inverse


class Strings:
    """The strings of one chunk of documents: where each starts in the chunk, its length, document row and minimizer."""

    def __init__(self, texts: list[tuple[int, int, bytes]]):
        self.segments = texts
        self.at = splits(np.array([len(t) for _, _, t in texts]))
        n = self.at[-1]
        self.buf = np.zeros(n + WIDE, np.uint8)
        self.buf[:n] = np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)
        self.starts = self.lengths = self.rows = np.zeros(0, np.int64)
        self.h = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        h = hashes(self.buf)
        key = (h << np.uint64(20))  # the smallest hash, and of equal ones the first
        key &= ~np.uint64((1 << 20) - 1)
        key |= np.arange(n, dtype=np.uint64)
        low, span = key, 1
        while span * 2 <= W:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < W:
            low = np.minimum(low[: len(low) - (W - span)], low[W - span :])
        low = (low[: n - WINDOW + 1] & np.uint64((1 << 20) - 1)).astype(np.int64)
        valid = np.zeros(n - WINDOW + 1, bool)
        for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            if b - a >= WINDOW:
                valid[a : b - WINDOW + 1] = True
        new = valid.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (low[1:] != low[:-1]) | ~valid[1:]
        self.starts = np.nonzero(new)[0]
        self.lengths = np.nonzero(last)[0] - self.starts + WINDOW
        self.rows = np.searchsorted(self.at, self.starts, side="right") - 1
        self.h = h[low[self.starts]]

    def matrix(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each string's bytes, filled up with zeros, and its length in the last byte."""
        out = np.lib.stride_tricks.sliding_window_view(self.buf, WIDE)[starts]
        out[np.arange(WIDE) >= lengths[:, None]] = 0
        out[:, -1] = lengths
        return out


def chunks(texts: list[bytes]):
    """Strings over chunks of the texts; a long text's pieces share WINDOW - 1 bytes, so that each window is in one."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WINDOW + 1), CHUNK):
            cut = t[a : a + CHUNK + WINDOW - 1]
            if len(cut) < WINDOW:
                continue
            if held and size + len(cut) > CHUNK:
                yield Strings(held)
                held, size = [], 0
            held.append((i, a, cut))
            size += len(cut)
    if held:
        yield Strings(held)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, whose symbols are over 0, by the difference cover modulo 3."""
    n = len(t)
    if n < 16:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    m = n + 1 + (-(n + 1)) % 3  # ends in a 0 at least, and is a multiple of 3
    s = np.zeros(m + 3, np.uint64)
    s[:n] = t
    bits = np.uint64(max(m, int(s.max())).bit_length())  # of a symbol, name or rank
    if bits > 31:
        raise ValueError(f"{n} symbols are too many for one suffix array")

    def triples(i: np.ndarray, third: np.ndarray) -> np.ndarray:
        pair = s[i] << bits | s[i + 1]
        if bits > 21:  # three don't fit, so that pairs are ranked first
            pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        return pair << bits | third

    sample = np.concatenate((np.arange(1, m, 3), np.arange(2, m, 3)))
    key = triples(sample, s[sample + 2])
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) > 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(m + 3, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    mixed = sample[order]
    zero = np.arange(0, m, 3)
    short = lambda i: s[i] << bits | rank[i + 1]  # noqa: E731  comparable between classes 0 and 1
    zero = zero[np.argsort(short(zero))]
    ones, twos = mixed[mixed % 3 == 1], mixed[mixed % 3 == 2]
    both = np.concatenate((twos, zero))
    long = triples(both, rank[both + 2])  # comparable between classes 0 and 2
    place = np.arange(len(zero)) + np.searchsorted(short(ones), short(zero)) + np.searchsorted(long[: len(twos)], long[len(twos) :])
    out = np.empty(m, np.int64)
    rest = np.ones(m, bool)
    rest[place] = False
    out[place] = zero
    out[rest] = mixed
    return out[out < n]


def smaller_sources(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For distinct strings (rows of `matrix`) and the smallest document of each: bits of the windows that also occur in a string with a smaller document."""
    lengths = rows[:, -1].astype(np.int64)
    at = splits(lengths + 1)
    body = np.arange(WIDE) < lengths[:, None]
    t = np.empty(at[-1], np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    t[inside] = rows[body].astype(np.int64) + 1
    t[~inside] = 257 + np.arange(len(rows))  # no two ends are equal, so common prefixes stop there
    order = suffix_array(t)
    owner = np.repeat(np.arange(len(rows)), lengths + 1)
    window = np.arange(at[-1]) - at[owner]
    order = order[(window <= lengths[owner] - WINDOW)[order]]
    text = np.append(t.astype(np.uint16), np.zeros(WINDOW, np.uint16))
    view = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    same = np.ones(max(0, len(order) - 1), bool)
    for a in range(0, len(same), 1 << 17):
        b = min(len(same), a + (1 << 17))
        same[a:b] = (view[order[a:b]] == view[order[a + 1 : b + 1]]).all(1)
    heads = np.nonzero(np.append(True, ~same))[0]
    least = np.minimum.reduceat(docs[owner[order]], heads) if len(order) else docs[:0]
    least = np.repeat(least, np.diff(np.append(heads, len(order))))
    hit = order[least < docs[owner[order]]]
    mask = np.zeros(len(rows), np.uint64)
    np.bitwise_or.at(mask, owner[hit], np.uint64(1) << window[hit].astype(np.uint64))
    return mask


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def stretch(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def narrow(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def widen(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sorted(t: pa.Table) -> pa.Table:
    """A group's rows by doc_id and text: shuffles deliver them in any order, and each round must cut the same chunks."""
    texts, ids = _rows(t)
    return t.take(pa.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))))


def _rows(t: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts as UTF-8 and doc_ids of the column `row`."""
    row = t.column("row").combine_chunks()
    row = row if isinstance(row, pa.StructArray) else pa.concat_arrays(row.chunks)
    texts = row.field(row.type.get_field_index("text")).cast(pa.binary()).to_pylist()
    return [x or b"" for x in texts], row.field(row.type.get_field_index("doc_id")).cast(pa.int64()).to_numpy(zero_copy_only=False)


TOLD = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("strings", pa.binary())])


def freed(out: pa.Table) -> pa.Table:
    """The group's result, after what its arrays took is given back."""
    give_back()
    return out


def _tell(buckets: int):
    def run(key, t):
        texts, _ = _rows(t)
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for c in chunks(texts):
            rows = np.array([i for i, _, _ in c.segments], np.uint64)[c.rows]
            found.append(np.unique((c.h << np.uint64(16)) | (rows & np.uint64(0xFFFF)), return_counts=True) if len(texts) <= 1 << 16 else _by_row(c.h, rows))
        h, strings = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(texts) <= 1 << 16:  # a text in several chunks is told once; else a row has one chunk
            h, strings = _summed(h, strings)
            h >>= np.uint64(16)
        n = _summed(h, np.ones(len(h), np.int64))[1]
        h, strings = _summed(h, strings)
        b = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        at = np.searchsorted(b[order], np.arange(buckets + 1))
        out = [(k, narrow(h[o]), squeeze(np.minimum(n[o], 255).astype(np.uint8)), squeeze(strings[o].astype(np.uint32))) for k in range(buckets) if len(o := order[at[k] : at[k + 1]])]
        return pa.table([pa.array([k for k, *_ in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), *(pa.array([x[j] for x in out], pa.binary()) for j in (1, 2, 3))], schema=TOLD)

    return run


def _by_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimizers, each once for each row that has it, and in how many strings."""
    order = np.lexsort((rows, h))
    h, rows = h[order], rows[order]
    heads = np.nonzero(np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))[: len(h)])[0]
    return h[heads], np.diff(np.append(heads, len(h)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.nonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])[0]
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


ASKED = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _answer(t):
    """Which of a bucket's minimizers two documents have; flags those that are hot."""
    hs = [widen(x) for x in t.column("h").to_pylist()]
    ns = [stretch(x, np.uint8).astype(np.int64) for x in t.column("n").to_pylist()]
    h = np.concatenate([*hs, np.zeros(0, np.uint64)])
    known, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([*ns, np.zeros(0, np.int64)]), len(known)).astype(np.int64)
    strings = np.bincount(inverse, np.concatenate([*(stretch(x, np.uint32) for x in t.column("strings").to_pylist()), np.zeros(0, np.uint32)]), len(known))
    keep, hot, at, out = (total >= 2)[inverse], (strings > HOT)[inverse], 0, []
    for g, x in zip(t.column("g").to_pylist(), hs, strict=True):
        k = keep[at : at + len(x)]
        if k.any():
            out.append((g, narrow(x[k]), squeeze(np.packbits(hot[at : at + len(x)][k]))))
        at += len(x)
    return pa.table([pa.array([g for g, _, _ in out], pa.int32()), pa.array([0] * len(out), pa.int32()), pa.array([-1] * len(out), pa.int32()), pa.array([x for _, x, _ in out], pa.binary()), pa.array([x for _, _, x in out], pa.binary())], schema=ASKED)


def _repeated(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The minimizers of the answers of kind 0, sorted, and whether they are hot."""
    hs, hots = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for kind, a, b in zip(*(t.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
        if kind == 0:
            hs.append(widen(a))
            hots.append(np.unpackbits(stretch(b, np.uint8), count=len(hs[-1])).astype(bool))
    h, hot = np.concatenate(hs), np.concatenate(hots)
    order = np.argsort(h)
    return h[order], hot[order]


def _candidates(texts: list[bytes], t: pa.Table):
    """For each chunk: the chunk, and starts, lengths, document rows and bucket hashes of the strings that may repeat."""
    known, hot = _repeated(t)
    for c in chunks(texts):
        if not len(known) or not len(c.h):
            continue
        at = np.minimum(np.searchsorted(known, c.h), len(known) - 1)
        keep = known[at] == c.h
        starts, lengths, h, warm = c.starts[keep], c.lengths[keep], c.h[keep], hot[at[keep]]
        if warm.any():  # a string for each window
            n = lengths[warm] - WINDOW + 1
            step = np.arange(n.sum()) - np.repeat(splits(n)[:-1], n)
            single = np.repeat(starts[warm], n) + step
            own = row_hashes(c.matrix(single, np.full(len(single), WINDOW))) >> np.uint64(16)
            starts, lengths, h = np.concatenate((starts[~warm], single)), np.concatenate((lengths[~warm], np.full(len(single), WINDOW))), np.concatenate((h[~warm], own))
        if len(starts):
            segment = np.searchsorted(c.at, starts, side="right") - 1
            yield c, starts, lengths, np.array([i for i, _, _ in c.segments])[segment], h, segment


SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("part", pa.int32()), ("rows", pa.binary()), ("h", pa.binary()), ("doc", pa.binary())])


def _by_bucket(h: np.ndarray, buckets: int):
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], np.arange(buckets + 1))
    return ((k, order[at[k] : at[k + 1]]) for k in range(buckets) if at[k] < at[k + 1])


def _send(buckets: int):
    def run(key, left, right):
        texts, ids = _rows(_sorted(left))
        out = []
        for part, (c, starts, lengths, rows, h, _) in enumerate(_candidates(texts, right)):
            m = c.matrix(starts, lengths)
            first, inverse = distinct(m)
            doc = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(doc, inverse, ids[rows])
            for k, o in _by_bucket(h[first], buckets):
                out.append((k, key[0].as_py(), part, squeeze(m[first[o]]), narrow(h[first[o]]), squeeze(doc[o])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return freed(pa.table([pa.array(c, f.type) for c, f in zip(cols, SENT, strict=True)], schema=SENT))

    return run


def _solve(t):
    """For each sent string the smallest document that has it, and its windows that a smaller one has."""
    blocks = [stretch(x, np.uint8).reshape(-1, WIDE) for x in t.column("rows").to_pylist()]
    rows = np.concatenate([*blocks, np.zeros((0, WIDE), np.uint8)])
    h = np.concatenate([*(widen(x) for x in t.column("h").to_pylist()), np.zeros(0, np.uint64)])
    docs = np.concatenate([*(stretch(x, np.int64) for x in t.column("doc").to_pylist()), np.zeros(0, np.int64)])
    first, inverse = distinct(rows)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, docs)
    # Suffix arrays over whole minimizers, of which each is of at most HOT strings or of one window.
    order = np.argsort(h[first], kind="stable")
    sizes = rows[first[order], -1].astype(np.int64) + 1
    ends, heads = np.cumsum(sizes), np.nonzero(np.append(True, np.diff(h[first][order]) > 0))[0] if len(order) else np.zeros(0, np.int64)
    mask, a = np.zeros(len(first), np.uint64), 0
    cuts = np.append(heads[1:], len(order))
    while a < len(order):
        base = ends[a] - sizes[a]
        fits = cuts[(cuts > a) & (ends[cuts - 1] - base <= SORTED)]
        b = int(fits[-1]) if len(fits) else int(cuts[cuts > a][0])
        o = order[a:b]
        mask[o] = smaller_sources(rows[first[o]], least[o])
        a = b
    out, at = [], 0
    for b, g, part, x in zip(*(t.column(c).to_pylist() for c in ("bucket", "g", "part")), blocks, strict=True):
        own = inverse[at : at + len(x)]
        out.append((g, part + 1, b, squeeze(least[own]), squeeze(mask[own])))
        at += len(x)
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return freed(pa.table([pa.array(c, f.type) for c, f in zip(cols, ASKED, strict=True)], schema=ASKED))


def _spans(texts: list[bytes], ids: np.ndarray, answers: pa.Table, buckets: int) -> list[np.ndarray]:
    """Starts and ends of the removed runs of each text, as rows of two."""
    told: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    for kind, b, x, y in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "a", "b")), strict=True):
        if kind:
            told[kind - 1, b] = (x, y)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for part, (c, starts, lengths, rows, h, segment) in enumerate(_candidates(texts, answers)):
        m = c.matrix(starts, lengths)
        first, inverse = distinct(m)
        least, mask = np.zeros(len(first), np.int64), np.zeros(len(first), np.uint64)
        for k, o in _by_bucket(h[first], buckets):
            x, y = told[part, k]
            least[o], mask[o] = stretch(x, np.int64), stretch(y, np.uint64)
        least, mask = least[inverse], mask[inverse]
        all_of = ids[rows] > least
        edge = np.zeros(len(c.buf) + 1, np.int32)
        np.add.at(edge, starts[all_of], 1)
        np.add.at(edge, (starts + lengths)[all_of], -1)
        some = np.nonzero((ids[rows] == least) & (mask > 0))[0]
        for j in range(W):
            s = starts[some[(mask[some] >> np.uint64(j)) & np.uint64(1) > 0]] + j
            np.add.at(edge, s, 1)
            np.add.at(edge, s + WINDOW, -1)
        covered = np.cumsum(edge) > 0
        for s in np.unique(segment).tolist():
            i, offset, t = c.segments[s]
            a = c.at[s]
            turn = np.diff(np.concatenate(([0], covered[a : a + len(t)].astype(np.int8), [0])))
            runs = np.stack((np.nonzero(turn > 0)[0], np.nonzero(turn < 0)[0]), 1) + offset
            if len(runs):
                out[i].append(runs)
    return [_joined(np.concatenate(x)) if x else np.zeros((0, 2), np.int64) for x in out]


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs without overlaps or touches, which pieces of a long text can leave."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.append(True, runs[1:, 0] > reach[:-1])
    return np.stack((runs[new, 0], reach[np.append(np.nonzero(new)[0][1:] - 1, len(runs) - 1)]), 1)


def _marked(docs: DataFrame, finish, schema: str) -> DataFrame:
    """finish(the table of a group of documents, texts, spans) over all documents."""
    # Rows are dealt by id, text and the partition that they are read in, so that no repeated id or row fills one group.
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions(spark), -(-total // GROUP_BYTES))
    buckets = int(min(groups, MOST_BUCKETS))
    dealt = docs.select(F.struct("*").alias("row"), F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).cast("int").alias("g"))
    told = dealt.groupBy("g").applyInArrow(_tell(buckets), "bucket int, g int, h binary, n binary, strings binary")
    asked = told.groupBy("bucket").applyInArrow(_answer, "g int, kind int, bucket int, a binary, b binary")
    sent = dealt.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_send(buckets), "bucket int, g int, part int, rows binary, h binary, doc binary")
    solved = sent.groupBy("bucket").applyInArrow(_solve, "g int, kind int, bucket int, a binary, b binary")

    def run(key, left, right):
        left = _sorted(left)
        texts, ids = _rows(left)
        return freed(finish(left, texts, ids, _spans(texts, ids, right, buckets)))

    return dealt.groupBy("g").cogroup(asked.unionByName(solved).groupBy("g")).applyInArrow(run, schema)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    at = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def removed(docs: DataFrame) -> DataFrame:
    """REMOVED for each document; spans are starts and ends in turn, in bytes."""

    def finish(_, texts, ids, spans):
        cut = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
        digests = [hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
        return pa.table([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(cut, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(digests, pa.string()), pa.array([s.ravel().tolist() for s in spans], pa.list_(pa.int64()))], names=[x.split()[0] for x in REMOVED.split(", ")])

    return _marked(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), finish, REMOVED)


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without the bytes of characters that they only partly cover."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the removed bytes taken out of text, in whole characters, and n_chars, where there is one, counted anew. All rows and columns stay."""
    fields = docs.schema.names

    def finish(t, texts, ids, spans):
        kept = [kept_bytes(x, whole_characters(x, s)).decode("utf-8", "replace") for x, s in zip(texts, spans, strict=True)]
        row = pa.concat_arrays(t.column("row").chunks)
        cut = np.array([len(s) > 0 for s in spans])
        cols = [row.field(k) for k in range(len(fields))]
        old = cols[fields.index("text")].to_pylist()
        cols[fields.index("text")] = pa.array([k if c else o for k, o, c in zip(kept, old, cut.tolist(), strict=True)], pa.string())
        if "n_chars" in fields and pa.types.is_integer(cols[fields.index("n_chars")].type):
            k = fields.index("n_chars")
            cols[k] = pa.array([len(x) if c else o for x, o, c in zip(kept, cols[k].to_pylist(), cut.tolist(), strict=True)], cols[k].type)
        return pa.table(cols, names=fields)

    known = docs.filter("doc_id is not null")
    return _marked(known, finish, docs.schema).unionByName(docs.filter("doc_id is null"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("spans")


OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, encode(coalesce(text, '')) AS b FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT r, unnest(range(1, CAST(octet_length(b) AS BIGINT) - {WINDOW - 2})) AS k FROM d),
w AS (SELECT r, doc_id, k, b[k:k + {WINDOW - 1}] AS s FROM p JOIN d USING (r)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE least < doc_id),
n AS (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS run FROM h),
s AS (SELECT r, min(k) AS a, max(k) + {WINDOW} AS e FROM n GROUP BY r, run),
t AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans, list(a - 1 ORDER BY a) AS ends, list(e ORDER BY a) AS starts FROM s GROUP BY r),
u AS (SELECT doc_id, b, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([1], coalesce(starts, [])) AS starts, list_concat(coalesce(ends, []), [CAST(octet_length(b) AS BIGINT)]) AS ends FROM d LEFT JOIN t USING (r))
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string([CASE WHEN ends[i] >= starts[i] THEN hex(b[starts[i]:ends[i]]) ELSE '' END FOR i IN range(1, len(starts) + 1)], ''))) AS kept_sha256
FROM u
"""
