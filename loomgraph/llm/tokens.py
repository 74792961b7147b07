"""Token counts of a unigram tokenizer without making the tokens.

White space becomes the space mark, and no piece continues over the start of a space mark,
so a text falls into chunks that can be counted on their own. Within a chunk an
Aho-Corasick automaton lists the vocabulary pieces that end at each character, and the
Viterbi recurrence carries two numbers per position: the best score and the pieces on its
path. Of equal scores the one found first counts, that is the longer last piece. A
character that no single piece covers may be an unknown one, which costs ten more than the
worst piece and is written as its UTF-8 bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``bytes`` says that all 256 byte pieces exist."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes: bool

    @property
    def unknown_score(self) -> float:
        return min(self.scores) - UNKNOWN_PENALTY


def load_vocabulary(path: str) -> Vocabulary:
    """Normal pieces and scores of a sentencepiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    pieces = tuple(model.id_to_piece(i) for i in normal)
    for piece in pieces:
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"a piece goes over a space mark: {piece!r}")
    return Vocabulary(pieces, tuple(model.get_score(i) for i in normal), sum(model.is_byte(i) for i in ids) == 256)


class Counter:
    """Counts chunks; keeps the answers for short ones, of which texts have few kinds."""

    CACHED = 400_000
    CACHED_LENGTH = 40
    _CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.bytes = vocabulary.unknown_score, vocabulary.bytes
        self.cache: dict[str, tuple[float, int]] = {}

    def chunk(self, chunk: str) -> tuple[float, int]:
        """(best score, pieces on its path)."""
        known = self.cache.get(chunk)
        if known is not None:
            return known
        n, unknown, none = len(chunk), self.unknown, -math.inf
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        # ``at`` is the position being settled; matches come in the order of their ends
        # and the longest first, so a later equal score never wins.
        at, single, best, count = 1, False, none, 0
        for end, (length, value) in itertools.chain(self.automaton.iter(chunk), ((n, (1, none)),)):
            while at <= end:
                if not single:
                    worst = score[at - 1] + unknown
                    if worst > best:
                        best, count = worst, pieces[at - 1] + (len(chunk[at - 1].encode()) if self.bytes else 1)
                score[at], pieces[at] = best, count
                at, single, best = at + 1, False, none
            if length == 1:
                single = True
            total = score[at - length] + value
            if total > best:
                best, count = total, pieces[at - length] + 1
        found = score[n], pieces[n]
        if n <= self.CACHED_LENGTH:
            if len(self.cache) >= self.CACHED:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def text(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        score, pieces = 0.0, 0
        cache = self.cache
        for chunk in self._CHUNK.findall(MARK + text.replace(" ", MARK)):
            s, p = cache.get(chunk) or self.chunk(chunk)
            score += s
            pieces += p
        return score, pieces


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, best_score.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text has no
    tokens and score 0. A space is put before every other text. Memory per task is the
    vocabulary's automaton, a bounded cache and a few numbers per character of the longest
    chunk. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            tokens, scores = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, text in enumerate(batch.column("text")):
                scores[row], tokens[row] = counter.text(text.as_py() or "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.array(scores)], ["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long, best_score double")
