"""Byte-level BPE encoding in batched numpy merge rounds, and decoding.

The symbols of many words lie in one flat array. In a round, the ranks of all neighbouring pairs are found by binary
search over the sorted pair keys; each word's lowest rank is taken by a segmented minimum, and all pairs of that rank
are merged, the first ones where they overlap. A word that has no ranked pair is done and leaves the array.

Words come from the pattern that the vocabulary's pre-tokenizer states; a vocabulary that states another, or a
normalizer, is refused. Each task keeps the ids of at most
CACHED_WORDS words. A special token's text in a document is that token.

Defined cases: null texts are empty; empty texts have no ids, and decode to the empty text; columns other than doc_id
and text aren't read; rows without a doc_id keep their null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import by_size, splits, table

CACHED_WORDS = 300_000
#: White space as Unicode has it; the word pattern is the vocabulary's own.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path} cuts texts in another way than WORD")
        ids, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        self.first = np.zeros(256, np.int64)
        for token, i in ids.items():
            self.bytes[i] = bytes(symbols[c] for c in token)
            if len(token) == 1:
                self.first[symbols[token]] = i
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.digits = [b"%d," % i for i in range(size)]
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        none = len(self.merged)
        while len(sym):
            key = sym[:-1] << 20 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            heads = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
            done = least == none
            if done.any():
                own, ids = word[done], sym[done]
                at = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
                for k, x in zip(own[at].tolist(), np.split(ids, at[1:]), strict=True):
                    out[k] = x
                sym, word, rank, least = sym[~done], word[~done], rank[~done], least[~done]
                if not len(sym):
                    break
            hit = np.nonzero(rank == least)[0]
            # In a run of neighbours, as in "aaa", every second pair is merged.
            start = np.append(True, np.diff(hit) > 1)
            step = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[step % 2 == 0]
            sym = sym.copy()
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 1 << 16):
            some = words[a : a + (1 << 16)]
            for w, ids in zip(some, self.merge([w.encode("utf-8", "surrogatepass") for w in some]), strict=True):
                self.words[w] = (ids.astype("<u4").tobytes(), b"".join([self.digits[i] for i in ids.tolist()]))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """For each text its ids, and their decimal forms with a comma after each."""
        cut = [[p if p in self.special else WORD.findall(p) for p in self.cut.split(t)] if any(x in t for x in self.special) else [WORD.findall(t)] for t in texts]
        lists = [p for parts in cut for p in parts if not isinstance(p, str)]
        new = set().union(*lists).difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = set().union(*lists)
        self.learn(list(new))
        get, out = self.words.__getitem__, []
        for parts in cut:
            found = []
            for p in parts:
                if isinstance(p, str):
                    found.append((np.array([self.special[p]], "<u4").tobytes(), self.digits[self.special[p]]))
                else:
                    found += map(get, p)
            out.append((np.frombuffer(b"".join([x for x, _ in found]), "<u4"), b"".join([x for _, x in found])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of each text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        codec = Codec(path)
        for b in batches:
            ids = [x for some in by_size([t or "" for t in b.column(1).to_pylist()]) for x, _ in codec.encode(some)]
            at = pa.array(splits(np.array([len(x) for x in ids], np.int64)).astype(np.int32))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """DIGESTS of what encoding and then decoding gives."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        codec, sha = Codec(path), hashlib.sha256
        for b in batches:
            out = []
            for ids, digits in (x for some in by_size([t or "" for t in b.column(1).to_pylist()]) for x in codec.encode(some)):
                out.append((len(ids), sha(digits[:-1]).hexdigest(), sha(codec.decode(ids).encode()).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
