"""Token counts under a unigram vocabulary by a count-only Viterbi search.

A text is cut before every space; each cut piece starts with one space mark, as the Metaspace rule has it
(a mark is put in front unless the text starts with one). Inside a piece an Aho-Corasick automaton
enumerates the vocabulary's matches by their ends, and dynamic programming carries the best score
and how many tokens reach it; no segmentation is built. The tie rules are the tokenizer's: of equal scores
the match that starts first wins; a character that is no token of its own may be unknown, at the worst score
less ten, and an unknown run falls back to one token a byte. Distinct pieces of a batch are searched once.

Scores that are integers add up exactly, so cutting changes nothing; for other scores sums are in double
precision within a piece, as in a tokenizer that splits at spaces.

Defined results: null and empty texts have no tokens; repeated rows are counted each; columns other than id
and text are not read, whatever their names; a very long text without spaces is one piece, of which a few scores are
kept at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import large_text, map_texts, named

#: Fixed value: the mark that stands for a space.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Searched pieces that a task remembers.
REMEMBERED = 300_000


class Counter:
    """Counts tokens of pieces; ``vocabulary`` holds (token, score), ordinary tokens only."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for token, score in vocabulary:
            self._automaton.add_word(token, (len(token), score))
        self._automaton.make_automaton()
        self._longest = max((len(token) for token, _ in vocabulary), default=1)
        self._unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._memory: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of one piece, its mark included. Scores and counts of the longest token's length back are all that is kept."""
        size = self._longest + 1
        score, count = [0.0] * size, [0] * size
        matches = self._automaton.iter(piece)  # by their ends, of equal ends the longer first
        end, match = next(matches, (-1, None))
        for e in range(1, len(piece) + 1):
            best, width, single = None, 0, False
            while end == e - 1:
                length, own = match
                s = score[(e - length) % size] + own
                if best is None or s > best or (s == best and length > width):
                    best, width = s, length
                single |= length == 1
                end, match = next(matches, (-1, None))
            last, here = (e - 1) % size, e % size
            if not single and (best is None or score[last] + self._unknown > best):
                score[here] = score[last] + self._unknown
                count[here] = count[last] + len(piece[e - 1].encode())
                continue
            score[here], count[here] = best, count[(e - width) % size] + 1
        return count[len(piece) % size]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        spaced = pc.replace_substring(texts, MARK, " ")
        starts = pc.starts_with(spaced, " ").to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(spaced), 0).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(spaced, " ")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        of = np.fromiter((self._remember(p) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        per_piece = of[coded.indices.to_numpy(zero_copy_only=False)]
        total = np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=per_piece, minlength=len(texts)).astype(np.int64)
        mark = self._remember("")  # what stands before a leading space is no piece
        return np.where(empty, 0, total - mark * starts)

    def _remember(self, part: str) -> int:
        known = self._memory.get(part)
        if known is None:
            if len(self._memory) >= REMEMBERED:
                self._memory.clear()
            known = self._memory[part] = self.piece(MARK + part)
        return known


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary tokens and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every row."""

    def setup():
        counter = Counter(sentencepiece_vocabulary(vocabulary_path))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(counter(large_text(batch.column(0))))], ["doc_id", "n_tokens"])

        return work

    key = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, text_col, [named(id_col).alias("doc_id")], f"doc_id {key}, n_tokens long", setup)
