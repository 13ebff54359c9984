"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text gets the sequence of pieces with the largest sum of the vocabulary's
scores.  No piece holds a space mark but at its start, so marked words are encoded
one by one, each distinct one once: the distinct words of a batch are sorted,
which is the depth-first order of their trie, and the best scores of the prefix
that a word shares with the one before it are kept and not computed again.  White
space that stands in no piece of more than one character is cut off too; that in
longer pieces, like the carriage return of ``;\\r``, stays in its word.

The normalisation is that of the model: spaces become marks, one mark is put in
front, nothing else changes.  A character that no piece covers becomes its UTF-8
bytes.  Equal sums go to the segmentation with the longer last piece.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, portions
from .pieces import MODEL, SPACE, Vocabulary, load

CACHE = 300_000             # words whose ids a task keeps
SLICE = 1 << 20             # characters in hand at once
NONE = object()


def units(pieces: Iterable[str]) -> re.Pattern[str]:
    """A marked word, a run of other characters, or a white-space character that no longer piece holds."""
    joined = {c for piece in pieces if len(piece) > 1 for c in piece}
    alone = re.escape("".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in joined))
    return re.compile(rf"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|(?s:.)")


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.units = units(vocabulary.pieces)
        # Every suffix of a piece, so that a search backwards knows where to end; None: no piece itself.
        self.suffixes: dict[str, tuple[float, int] | None] = {}
        for piece in vocabulary.pieces:
            for i in range(1, len(piece)):
                self.suffixes.setdefault(piece[i:], None)
        for piece, i, score in zip(vocabulary.pieces, vocabulary.ids, vocabulary.scores):
            self.suffixes[piece] = (score, i)
        self.byte_ids = vocabulary.bytes_
        self.bytes = [b""] * vocabulary.size
        for piece, i in zip(vocabulary.pieces, vocabulary.ids):
            self.bytes[i] = piece.replace(SPACE, " ").encode("utf-8")
        for b, i in enumerate(vocabulary.bytes_):
            self.bytes[i] = bytes([b])
        self.cache: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words in sorted order into the cache."""
        find, cache = self.suffixes.get, self.cache
        before, best, back = "", [0.0], [None]
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, step = None, None
                for start in range(end - 1, -1, -1):
                    found = find(word[start:end], NONE)
                    if found is NONE:
                        break
                    if found and (top is None or best[start] + found[0] >= top):
                        top, step = best[start] + found[0], (start, found[1])
                # An uncovered character stands alone: no piece reaches over it.
                best.append(best[end - 1] if top is None else top)
                back.append(step)
            ids, end = [], len(word)
            while end:
                if step := back[end]:
                    end = step[0]
                    ids.append(step[1])
                else:
                    end -= 1
                    ids += [self.byte_ids[b] for b in reversed(word[end].encode("utf-8", "surrogatepass"))]
            cache[word] = np.array(ids[::-1], "<i4").tobytes()
            before = word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null or empty text has none."""
        ids: list[list[bytes]] = [[] for _ in texts]
        for group in _groups(texts):
            cut = [(i, self.units.findall(part)) for i, part in group]
            new = {w for _, words in cut for w in words}
            if len(self.cache) + len(new) > CACHE:
                self.cache = {w: self.cache[w] for w in new if w in self.cache}
            self.learn(new.difference(self.cache))
            for i, words in cut:
                ids[i].append(b"".join(map(self.cache.__getitem__, words)))
        return [b"".join(x) for x in ids]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the mark put in front is taken away."""
        found = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return found.removeprefix(b" ").decode("utf-8", "replace")


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(index, part) of all texts in lists of about ``SLICE`` characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for part in _slices(text) if text else ():
            held.append((i, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    yield held


def _slices(text: str) -> Iterator[str]:
    """The marked text in parts that end before a mark."""
    marked = SPACE + text.replace(" ", SPACE)
    at = 0
    while at < len(marked):
        end = at + SLICE
        if end < len(marked):
            while end < len(marked) and not (marked[end] == SPACE and marked[end - 1] != SPACE):
                end += 1
        yield marked[at:end]
        at = end


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """(key, n_pieces, ids, decoded_sha256, round_trip): one row per row of ``docs``.

    ``ids`` is empty for a null or empty text, whose decoding is empty.
    ``decoded_sha256`` is that of the decoded text in UTF-8; ``round_trip`` says
    whether it is the text itself, which holds unless the text has the mark as a
    character of its own.
    """
    vocabulary = load(path)             # a file of bounded size, sent with the tasks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            for part in portions(batch, 1):
                texts = part["t"].to_pylist()
                ids = codec.encode(texts)
                back = [codec.decode(i) for i in ids]
                counts = np.array([len(i) // 4 for i in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                values = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(ids))])
                digests = [hashlib.sha256(b.encode("utf-8")).hexdigest() for b in back]
                same = [b == (t or "") for b, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(counts), pa.ListArray.from_arrays(offsets, values),
                                                  pa.array(digests), pa.array(same)],
                                                 ["key", "n_pieces", "ids", "decoded_sha256", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(
        lean(work), f"key {kind}, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")
    return found.withColumnRenamed("key", key)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = MODEL) -> DataFrame:
    """(key, text) of encoded rows; null ids give a null text."""
    vocabulary = load(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [None if i is None else codec.decode(np.array(i, "<i4").tobytes()) for i in batch["i"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(texts, pa.string())], ["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), F.col(ids).alias("i")).mapInArrow(lean(work), f"key {kind}, text string")
    return found.withColumnRenamed("key", key)
