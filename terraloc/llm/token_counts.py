"""Unigram token counts by dynamic programming over a trie.

A batch's distinct words that aren't known yet are walked in order, which is a walk of their trie: a word goes on from
the deepest node that it shares with the word before it, where the forward scores of that prefix are kept, so that each
node's score is computed once. A node holds the best forward score of its prefix and the number of pieces of that
segmentation; a word's are stored at its terminal node. Pieces that end at a node are found by a walk backwards in a
trie of the vocabulary's reversed pieces, so that no step is taken that leads to no piece. Words have any length.

The vocabulary is a piece file whose order is by frequency. Nothing is trained: the unigram distribution is Zipf's over
that order, the 256 bytes being the last ranks: p(r) = 1 / (r + 2), divided by the sum of all. A character that is no
piece counts as its UTF-8 bytes.

Bounded: a task keeps the counts of words of CACHED_CHARACTERS together.

Defined cases: null and empty texts have no words and no tokens; of segmentations with equal scores the one whose last
piece is shorter counts; rows without a doc_id keep their null; columns other than doc_id and text aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import by_size, table

CACHED_CHARACTERS = 4 << 20
MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_scores(path: str) -> tuple[dict[str, float], float]:
    """The log probability of each piece, and that of each of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    weight, byte = [1 / (r + 2) for r in range(len(pieces))], 1 / (len(pieces) + 2)
    total = math.fsum(weight) + 256 * byte
    return {p: math.log(w / total) for p, w in zip(pieces, weight, strict=True)}, math.log(byte / total)


class Counter:
    def __init__(self, scores: dict[str, float], byte: float):
        self.byte = byte
        self.known: dict[str, tuple[int, float]] = {}
        self.size = 0
        self.ends: dict = {}  # reversed pieces: a node's children by character, and under "" the log of the piece that is whole there
        for piece, log in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = log

    def count(self, words) -> None:
        """Stores pieces and score of each word."""
        best, pieces, before = [0.0], [0], ""
        ends, byte, known = self.ends.get, self.byte, self.known
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):  # noqa: B905  up to the shorter's end
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for d in range(shared, len(word)):
                c = word[d]
                width = 1 + (c >= "\x80") + (c >= "\u0800") + (c >= "\U00010000")
                score, count = best[d] + byte * width, pieces[d] + width
                at, node = d, ends(c)
                while node is not None:
                    log = node.get("")
                    if log is not None and best[at] + log > score:
                        score, count = best[at] + log, pieces[at] + 1
                    if not at:
                        break
                    at -= 1
                    node = node.get(word[at])
                best.append(score)
                pieces.append(count)
            known[word] = pieces[-1], best[-1]
            before = word

    def texts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """Words, tokens and score of each text."""
        cut = [[MARK + w for w in t.split()] for t in texts]
        words = set().union(*cut)
        new = words.difference(self.known)
        if self.size + sum(map(len, new)) > CACHED_CHARACTERS:
            self.known.clear()
            self.size, new = 0, words
        self.count(new)
        self.size += sum(map(len, new))
        out, get = [], self.known.__getitem__
        for some in cut:
            found = list(map(get, some))
            out.append((len(some), sum(n for n, _ in found), math.fsum(s for _, s in found)))
        return out


COUNTS = "doc_id long, n_words long, n_tokens long, score double"


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """COUNTS of each document; score is the log probability of its best segmentations."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        counter = Counter(*vocabulary_scores(path))
        for b in batches:
            rows = [x for some in by_size([t or "" for t in b.column(1).to_pylist()]) for x in counter.texts(some)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
