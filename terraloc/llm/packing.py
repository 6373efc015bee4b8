"""Packing by shortest-pack-first over the length histogram.

Each document's ids, closed by id END, are cut into whole sequences and a remainder. The histogram of piece lengths
(at most SEQUENCE rows, whatever the input) is packed on the driver: lengths from the longest, each into the packs that
are shortest so far, where the state is a count for each pattern of lengths. A pattern's slots are then ranges of ranks
among the pieces of a length, so that pieces find their sequence by (length, rank) alone. Ranks are counted in each
task and completed by sums over (length, task), so that no length's pieces need to meet in one task.

Middling lengths leave packs half empty (three of 700 don't fit in 2,048). While padding takes over WASTE of all tokens,
the emptiest packs are given up and the ids of their pieces are poured, longest first, into the gaps of the others, which
cuts these pieces anew. Where each falls follows from its length and rank, as all of one length lie side by side.

Ids are those of the tokenizers library: texts of a plain range of characters are normalised and split here, and each
distinct word is encoded once by the library's model; other texts go to the library whole. A vocabulary file that states other
steps than these is refused.

Defined cases: null texts are empty and give the one id END; repeated rows and equal texts are packed each for itself;
an empty table gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.llm.common import by_size, give_back, save, table

SEQUENCE = 2048
END = 1
#: Share of padding up to which no document is cut to fill gaps.
WASTE = 0.01
CACHED_WORDS = 200_000
#: The word pattern that the vocabulary file states.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Bytes that byte-level vocabularies write as characters from 256 on, in their order.
BYTES = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Beyond these, composition, lower case or white space may differ between the libraries.
USUAL = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x100)])
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\xa0-įı-ɏ‐-‧€]")


def usual(text: str) -> bool:
    """Whether all characters are of the plain range, and none belongs to a special token."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, USUAL)
    except UnicodeEncodeError:
        return not UNUSUAL.search(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        parts = [(spec[k] or {}).get(of, []) for k, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if [p["type"] for x in parts for p in x] != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or parts[1][0]["pattern"].get("Regex") != WORD.pattern or parts[1][1]["add_prefix_space"] or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path} normalizes or cuts texts in another way than WORD")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}  # by the pattern's words
        self.tokens: dict[str, bytes] = {}  # by what stands between white space

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """A word's ids by the model alone: nothing before it changes a word of a usual text but for its bytes' characters."""
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        ids = [t.id for t in self.model.tokenize(plain)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, tokens: set[str]) -> None:
        tokens = list(tokens)
        parts = [(t,) if t.isalpha() else WORD.findall(t) for t in tokens]  # letters alone are one word
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = {w for p in parts for w in p}.difference(self.words)
        self.words.update((w, self.word(w)) for w in new)
        get = self.words.__getitem__
        self.tokens.update(zip(tokens, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """No word of the pattern spans white space, so ids are kept by what stands between it."""
        cut = [t.lower().split() if usual(t) else None for t in texts]
        new = set().union(*(c for c in cut if c)).difference(self.tokens)
        if len(self.tokens) + len(new) > CACHED_WORDS:
            self.tokens.clear()
            new = set().union(*(c for c in cut if c))
        self.learn(new)
        get = self.tokens.__getitem__
        return [self.whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long, ids binary"


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """PIECES of all documents; place is a piece's number among those of its length in its task, ids are those of pieces shorter than a sequence."""
    path = vocabulary or default_vocabulary()
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encoder, seen, part = Encoder(path), Counter(), TaskContext.get().partitionId()
        for b in batches:
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, ids in zip(b.column(0).to_pylist(), (x + end for some in by_size(texts) for x in encoder.encode(some)), strict=True):
                n = len(ids) // 4
                for a in range(0, n, sequence):
                    cut = ids[4 * a : 4 * (a + sequence)]
                    size = len(cut) // 4
                    out.append((i, a, size, zlib.crc32(cut), n, part, seen[size], cut if size < sequence else None))
                    seen[size] += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.record_batch([pa.array(c, {5: pa.int32(), 7: pa.binary()}.get(k, pa.int64())) for k, c in enumerate(cols)], names=[x.split()[0] for x in PIECES.split(", ")])
        del encoder
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Lengths and how many pieces have them, to patterns of lengths and how many sequences have them."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(sequence + 1)]  # by space left
    for length in sorted(counts, reverse=True):
        left, top = counts[length], sequence
        while left:
            while top >= length and not room[top]:
                top -= 1
            if top < length:  # new sequences, each filled before the next is opened
                full, rest = divmod(left, sequence // length)
                for size, n in ((sequence // length, full), (rest, 1)):
                    if size and n:
                        room[sequence - size * length].append(((length,) * size, n))
                break
            pattern, n = room[top].pop()
            used = min(n, left)
            if n > used:
                room[top].append((pattern, n - used))
            room[top - length].append(((*pattern, length), used))
            left -= used
    return [p for packs in room for p in packs]


def given_up(patterns: list[tuple[tuple[int, ...], int]], sequence: int = SEQUENCE, waste: float = WASTE) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """The patterns that stay, fullest last, and how many pieces of each length are left to pour into their gaps: as many of the emptiest sequences go as bring padding down to `waste`."""
    tokens, packs = sum(sum(p) * n for p, n in patterns), sum(n for _, n in patterns)
    over = packs - max(-(-tokens // sequence), int(tokens / (sequence * (1 - waste))))
    kept, loose = [], Counter()
    for pattern, n in sorted(patterns, key=lambda p: (sum(p[0]), p[0])):
        gone = min(n, max(over, 0))
        over -= gone
        for length in pattern:
            loose[length] += gone
        if n > gone:
            kept.append((pattern, n - gone))
    return kept, +loose


class Gaps:
    """What the patterns leave empty, widest first, as one run of places."""

    def __init__(self, kept: list[tuple[tuple[int, ...], int]], sequence: int = SEQUENCE):
        base, rows = 0, []
        for pattern, n in kept:
            rows.append((sequence - sum(pattern), base, n, sum(pattern)))
            base += n
        self.rows = sorted((r for r in rows if r[0]), reverse=True)
        self.starts = np.cumsum([0, *(r[0] * r[2] for r in self.rows)])

    def spans(self, at: int, length: int):
        """Sequence, offset and length of each part of what lies at these places."""
        k = int(np.searchsorted(self.starts, at, side="right")) - 1
        while length:
            room, base, n, used = self.rows[k]
            copy, inside = divmod(at - int(self.starts[k]), room)
            if copy == n:
                k += 1
                continue
            size = min(length, room - inside)
            yield base + copy, used + inside, size
            at, length = at + size, length - size


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) by length and rank."""
    rank, base, out = Counter(), 0, []
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, rank[length], base, offset))
            rank[length] += n
            offset += length
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    cut = save(pieces(docs, vocabulary, sequence), "pieces")
    per = save(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `sequence` rows
    kept, loose = given_up(pack_histogram(counts, sequence), sequence)
    found, gaps = slots(kept), Gaps(kept, sequence)
    placed = np.zeros(sequence + 1, np.int64)  # pieces of each length that stay in a pattern
    poured, at = {}, 0
    for length in sorted(counts, reverse=True):
        placed[length] = counts[length] - loose[length]
        poured[length], at = at, at + length * loose[length]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    names = [*own, "sequence_id", "offset"]
    schema = ", ".join(f"{c} long" for c in names)
    rank = (F.col("first") + F.col("place")).alias("rank")

    def run(batches):
        keys = found[:, 0] << 44 | found[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = found[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if len(found) else found
            yield pa.record_batch([*(b.column(k) for k in range(5)), pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=names).filter(pa.array(rank < placed[length]))

    def pour(batches):
        for b in batches:
            out = []
            for doc, start, length, ids, n, rank in zip(*(c.to_pylist() for c in b.columns), strict=True):
                done = 0
                if rank >= placed[length]:
                    for seq, offset, size in gaps.spans(poured[length] + (rank - int(placed[length])) * length, length):
                        out.append((doc, start + done, size, zlib.crc32(ids[4 * done : 4 * (done + size)]), n, seq, offset))
                        done += size
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    packed = cut.join(first, ["length", "part"]).select(*own, rank).mapInArrow(run, schema)
    if not loose:
        return packed
    rest = cut.filter(F.col("length").isin(sorted(loose))).join(first, ["length", "part"])  # at most `sequence` lengths
    return packed.unionByName(rest.select("doc_id", "start", "length", "ids", "doc_tokens", rank).mapInArrow(pour, schema))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
