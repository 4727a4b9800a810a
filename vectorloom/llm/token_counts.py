"""Count-only Viterbi segmentation under a unigram vocabulary.

An Aho-Corasick automaton enumerates, for every end position, the vocabulary pieces that end there,
longest first. Dynamic programming keeps two numbers per position: the best score and the number of
pieces on the path that has it. No path is stored, as only the count is wanted.

The tie rule is that of the ``Unigram`` model of the public ``tokenizers`` library: candidates for
one end are met by ascending start (so the longest piece comes first) and a later one wins only if
its score is strictly higher; a character that no one-character piece covers is an unknown of score
``min - 10``; unknowns are spelled in bytes. The normaliser puts U+2581 before the text and in place
of spaces.

Cuts: if no piece of the vocabulary holds U+2581 after another character, then no piece can cross
from a word into the next U+2581, and segments between such places are independent. Scores of the
vocabulary used are integers, so sums do not depend on where they start. Segments are memoised in a
table of bounded size. The cut is switched off for vocabularies that do not have the property.

Edge cases: null and empty texts have 0 tokens and score 0; repeated rows are counted once each; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
COUNTS = "doc_id long, n_chars long, n_tokens long, score double"


class UnigramCounter:
    """Counts pieces of the best segmentation. ``vocabulary``: (piece, score) in id order."""

    def __init__(self, vocabulary: list[tuple[str, float]], memo: int = 1 << 18):
        self.memo_size, self.memo = memo, {}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        crosses = any(BLANK in piece.lstrip(BLANK) for piece, _ in vocabulary)
        self.segments = re.compile("(?s).+" if crosses else f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall

    def _viterbi(self, segment: str) -> tuple[int, float]:
        size = len(segment)
        best: list[float | None] = [None] * (size + 1)
        pieces = [0] * (size + 1)
        best[0] = 0.0
        matches = self.automaton.iter(segment)
        last, (length, score) = next(matches, (size, (0, 0.0)))
        for end in range(1, size + 1):
            top, count, single = None, 0, False
            while last == end - 1:
                candidate = best[end - length] + score
                if top is None or candidate > top:
                    top, count = candidate, pieces[end - length] + 1
                single = single or length == 1
                last, (length, score) = next(matches, (size, (0, 0.0)))
            if not single:  # an unknown character, spelled in bytes; the latest start, so it must be strictly better
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, count = candidate, pieces[end - 1] + len(segment[end - 1].encode("utf-8", "replace"))
            best[end], pieces[end] = top, count
        return pieces[size], best[size]

    def count(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation."""
        if not text:
            return 0, 0.0
        memo, tokens, total = self.memo, 0, 0.0
        for segment in self.segments(BLANK + text.replace(" ", BLANK)):
            known = memo.get(segment)
            if known is None:
                known = self._viterbi(segment)
                if len(segment) <= 64:
                    if len(memo) >= self.memo_size:
                        memo.clear()
                    memo[segment] = known
            tokens += known[0]
            total += known[1]
        return tokens, total


def load_vocabulary(model: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file of the tokenizers folder."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    return [(processor.id_to_piece(i), processor.get_score(i)) for i in range(processor.get_piece_size())]


@functools.lru_cache(maxsize=2)
def _counter(model: str) -> UnigramCounter:
    return UnigramCounter(load_vocabulary(model))


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_chars, n_tokens and score of every whole text, without any shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            sizes, results = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text))
                results.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([r[0] for r in results], pa.int64()), pa.array([r[1] for r in results], pa.float64())],
                names=["doc_id", "n_chars", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counted, COUNTS)
