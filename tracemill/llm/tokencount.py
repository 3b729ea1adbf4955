"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over the word's characters
carries the best score and its number of pieces. Ties are a tokenizer's: starts are tried from left to right, and a later
path must score strictly more. A character without a piece of its own costs the lowest score less 10 and is spelt in
byte pieces; neighbouring ones are spelt together. Words begin at each space, which is kept as a lower block mark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

SPACE = "▁"
PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, control and unknown pieces and unused padding included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of texts under a unigram vocabulary with byte pieces, with a bounded cache of words."""

    def __init__(self, pieces: list[tuple[str, float]], entries: int = 400_000):
        import ahocorasick

        self.entries = entries
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.automaton for b in range(256))
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        if self.single.issuperset(word):  # matches come by end, the longest first: a later one must score strictly more
            best, pieces = [0.0] + [-1e300] * n, [0] * (n + 1)
            for end, (length, score) in self.automaton.iter(word):
                start = end + 1 - length
                value = best[start] + score
                if value > best[end + 1]:
                    best[end + 1], pieces[end + 1] = value, pieces[start] + 1
            return pieces[n]
        ending: list[list] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(word):
            ending[end + 1].append((length, score))
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            options = ending[end]
            if word[end - 1] not in self.single:
                options.append((1, self.unknown))
            top, length = None, 0
            for size, score in sorted(options, reverse=True):  # the longest starts first
                value = best[end - size] + score
                if top is None or value > top:
                    top, length = value, size
            best[end], back[end] = top, length
        count, at, fused = 0, n, False
        while at:
            size = back[at]
            if size == 1 and word[at - 1] not in self.single:
                count += len(word[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else not fused
                fused = True
            else:
                count += 1
                fused = False
            at -= size
        return count

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = (marked[1:] if marked[0] == SPACE else marked).split(SPACE)
        try:
            return sum(map(self.cache.__getitem__, words))
        except KeyError:
            pass
        if len(self.cache) > self.entries:
            self.old, self.cache = self.cache, {}
        for w in set(words).difference(self.cache):
            self.cache[w] = self.old[w] if w in self.old else self.word(SPACE + w)
        return sum(map(self.cache.__getitem__, words))


@lru_cache(1)
def _counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(list(pieces))


def count(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and n_tokens for every row, by its whole text.

    The text is taken as it is, a space put before it unless it begins with one; each space begins a word. Null and empty
    texts have no tokens. Repeated rows are each counted, a null doc_id like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(read_pieces(vocabulary_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            n = [counter.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long")
