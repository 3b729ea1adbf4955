"""Sum-of-squares online packing.

Each partition packs its own rows as they come. `counts[l]` is the number of open windows whose fill is in level l, a range
of `window / levels` tokens. A document's tail (what is left after whole windows) goes to the level, or to a new window,
that makes the sum of the squared counts smallest; ties take the fullest. A level may be up to one range too full: then the
tail is cut at the window's end, and what remains is placed like another. A window that lacks less than a range is topped up
by the next document's beginning. At the end of a partition the few windows still open are poured into each other, cutting
documents at the seams; the last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents

WINDOW = 4096
END = 2
#: Ranges of fill that the rule tells apart. Fewer leave fewer windows open; more cut fewer documents.
LEVELS = 32
#: Windows held open at most, which bounds the memory of a task. The rule keeps far fewer open unless hardly any two
#: documents complement each other; beyond it all open windows are poured into each other, as at the end of a partition.
OPEN = 1024
#: Fixed value: the pattern of tokenizers that drop white space and never merge a letter with a mark or a digit.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space that str.split takes but that the tokenizer might see otherwise: all but space, tab and line ends.
_ODD_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r") + "]")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, with a bounded cache of the ids of words.

    A tokenizer with the pattern above drops white space and never merges across it, so a text's ids are those of its words
    in turn; a word's letters and one mark after them are apart as well, and ASCII case is dropped, so that words are kept
    as lower-cased bytes. That letters and mark
    are apart is tried out on the tokenizer for each letter once (`İ`, for one, becomes a letter and an accent, which joins
    the mark). Texts with unusual white space or with the strings of special tokens, and all texts of other tokenizers, go
    to the tokenizer whole. The cache has two generations of `entries` words.
    """

    MARKS = ".,;:!?"

    def __init__(self, tokenizer_json: str, entries: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        #: The same model without a normalizer, which has nothing to do on lower-cased ASCII letters.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.entries = entries
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = {m.encode(): self._ids([m])[0] for m in self.MARKS}
        self.letters: dict[str, bool] = {}
        self.apart: set[str] = set()
        parts = json.loads(tokenizer_json)
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        drops = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        model = parts.get("model") or {}
        last = model.get("end_of_word_suffix")
        vocabulary = model.get("vocab") if last and isinstance(model.get("vocab"), dict) else {}
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1 + len(parts.get("added_tokens") or []), dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(last)]] = True
        self.by_words = bool(vocabulary) and split.get("pattern") == {"Regex": _PATTERN} and bool(split.get("invert")) and parts.get("normalizer") == drops

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str], tokenizer=None) -> list[bytes]:
        """As `_ids` for words of letters alone: as one text, cut after each id that ends a word."""
        ids = np.array((tokenizer or self.tokenizer).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
        if len(ends) != len(words):
            return self._ids(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _apart(self, stem: bytes) -> bool:
        """True if the stem's ids and those of a mark after it are the ids of both together."""
        if stem.isalpha():  # of bytes: ASCII letters alone
            return True
        stem = stem.decode()
        if not stem.isalpha():
            return False
        if self.apart.issuperset(stem):
            return True
        for c in set(stem).difference(self.letters):
            found = self._ids([c, *(c + m.decode() for m in self.marks)])
            self.letters[c] = all(both == found[0] + mark for mark, both in zip(self.marks.values(), found[1:], strict=True))
            if self.letters[c]:
                self.apart.add(c)
        return all(map(self.letters.__getitem__, stem))

    def _learn(self, words: set[bytes]) -> None:
        cache, old, marks = self.cache, self.old, self.marks
        again = old.keys() & words
        cache.update(zip(again, map(old.__getitem__, again), strict=True))
        words = words.difference(again)
        letters = list(filter(bytes.isalpha, words))  # most words: they need no look at each
        stems: set[bytes] = set()
        marked, mixed, others = [], [], []
        for word in words.difference(letters):
            tail = marks.get(word[-1:])
            stem = word[:-1] if tail else word
            if not self._apart(stem):
                mixed.append(word)
            elif not tail:
                others.append(word)
            else:
                marked.append((word, stem, tail))
                stems.add(stem)
        stems = stems.difference(letters).difference(others).difference(cache).difference(old)  # one by one: several at once walk through the caches
        plain = list(filter(bytes.isalpha, stems))
        letters += plain
        others += stems.difference(plain)
        for new, ids_of in ((letters, lambda part: self._letters(part, self.plain)), (others, self._letters), (mixed, self._ids)):
            for at in range(0, len(new), 10_000):
                part = new[at : at + 10_000]
                cache.update(zip(part, ids_of(list(map(bytes.decode, part))), strict=True))
        for word, stem, tail in marked:
            ids = cache.get(stem)
            cache[word] = (old[stem] if ids is None else ids) + tail

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split: list[list[bytes] | None] = [t.encode().lower().split() if self.by_words and "<|" not in t and not _ODD_SPACE.search(t) else None for t in texts]
        if len(self.cache) > self.entries:
            self.old, self.cache = self.cache, {}
        missing = set(chain.from_iterable(filter(None, split))).difference(self.cache)
        if missing:
            self._learn(missing)
        ids = self.cache.__getitem__
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [whole(t) if words is None else b"".join(map(ids, words)) for t, words in zip(texts, split, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(1)
def encoder(tokenizer_json: str) -> Encoder:
    """One for each Python worker, so that its cache serves all tasks that the worker runs."""
    return Encoder(tokenizer_json)


def _chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters, at least one text each: their new words are learnt together."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Packer:
    """Packs (document, ids) into windows; closed windows come out as (pieces), a piece being (document, start, ids)."""

    def __init__(self, window: int = WINDOW, levels: int = LEVELS, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.step = max(1, window // levels)
        self.counts = np.zeros(-(-window // self.step), dtype=np.int64)
        self.open: dict[int, list[tuple[list, int]]] = defaultdict(list)
        #: A window that lacks less than a step.
        self.short: tuple[list, int] | None = None

    def add(self, doc, ids: bytes) -> Iterator[list]:
        w, at = self.window, 0
        while len(ids) // 4 - at >= w:
            yield [(doc, at, ids[4 * at : 4 * (at + w)])]
            at += w
        while at < len(ids) // 4:
            (pieces, filled), self.short = self.short or self._take(len(ids) // 4 - at), None
            n = min(len(ids) // 4 - at, w - filled)
            pieces.append((doc, at, ids[4 * at : 4 * (at + n)]))
            at, filled = at + n, filled + n
            if filled == w:
                yield pieces
            elif w - filled < self.step:
                self.short = pieces, filled
            else:
                self.open[filled // self.step].append((pieces, filled))
                self.counts[filled // self.step] += 1
        if self.counts.sum() > self.most_open:
            yield from self.pour(last=False)

    def _take(self, size: int) -> tuple[list, int]:
        """The open window, or a new one, to place `size` tokens in."""
        n, q = len(self.counts), (size + self.step // 2) // self.step
        at = np.nonzero(self.counts)[0]
        at = at[at * self.step + size < self.window + self.step]
        if len(at):
            to = at + q
            change = np.where(to < n, 2 * (self.counts[np.minimum(to, n - 1)] - self.counts[at]) + 2 * (q > 0), 1 - 2 * self.counts[at])
            best = len(at) - 1 - int(change[::-1].argmin())
            if change[best] <= 2 * self.counts[min(q, n - 1)] + 1:
                self.counts[at[best]] -= 1
                return self.open[int(at[best])].pop()
        return [], 0

    def pour(self, last: bool = True) -> Iterator[list]:
        """Close all open windows but at most one, which stays open unless it is the last: then cut it at powers of two."""
        windows = [self.short] * (self.short is not None) + [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        todo = [p for pieces, _ in windows for p in pieces]
        self.open.clear()
        self.counts[:] = 0
        self.short = None
        now, filled = [], 0
        for doc, start, ids in todo:
            while ids:
                part, ids = ids[: 4 * (self.window - filled)], ids[4 * (self.window - filled) :]
                now.append((doc, start, part))
                start += len(part) // 4
                filled += len(part) // 4
                if filled == self.window:
                    yield now
                    now, filled = [], 0
        if filled and not last:
            self.open[filled // self.step].append((now, filled))
            self.counts[filled // self.step] = 1
        elif filled:
            left = 1 << (filled.bit_length() - 1)
            out: list = []
            for doc, start, ids in now:
                while ids:
                    part, ids = ids[: 4 * left], ids[4 * left :]
                    out.append((doc, start, part))
                    start += len(part) // 4
                    filled -= len(part) // 4
                    left -= len(part) // 4
                    if not left:
                        yield out
                        out, left = [], 1 << max(0, filled.bit_length() - 1)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on request ids.

    A document's ids end with `end`; null text counts as empty and so is that one id. Every id lies in exactly one piece,
    pieces fill a sequence gapless from offset 0, and a sequence has at most `window` ids. Repeated rows are packed once
    each, a null doc_id like any other; an empty table gives an empty result; other columns are ignored. Sequence ids are
    made from the partition's number, so that a partition that runs again gives the same rows.
    """
    with open(tokenizer_path or vocabulary(), encoding="utf-8") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())
    stop = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, packer = encoder(vocab.value).encode_all, Packer(window)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def take(windows: Iterator[list]) -> None:
            nonlocal sequence
            for pieces in windows:
                at = 0
                for (doc, tokens), start, ids in pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), tokens, sequence, at, *([np.frombuffer(ids, "<u4")] * with_ids)))
                    at += n
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if i == 7 else pa.int64()) for i, c in enumerate(columns)], names)

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in _chunks(texts):
                for doc, ids in zip(docs[at:to], encode_all(texts[at:to]), strict=True):
                    ids += stop
                    take(packer.add((doc, len(ids) // 4), ids))
                    if len(rows) > (200 if with_ids else 20_000):
                        yield out()
        take(packer.pour())
        if rows:
            yield out()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return documents(docs).mapInArrow(run, ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names))
