"""Ids of whole texts by a tokenizer's file, word by word.

White space ends a word for the tokenizers read here, so the ids of a text are
those of its words.  Most words of a corpus are common and are encoded once; the
parts of new ones are merged many at a time.  Whatever the quick way doesn't
cover is encoded by the library: words with other letters than Latin ones, very
long words, names of special tokens, and files of another kind in whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

# The settings that the quick way follows (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "ignore_merges": False}

_SLICE = 1 << 20            # characters of a text that are cut into words at once
_KEPT = 600_000             # words, and parts of words, that are kept
_LONG = 64                  # longer words are not kept
_NONE = 1 << 30

# Printable ASCII and the letters of Latin-1: these are composed already, and each has one lower-case form.
_plain = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_space = re.compile("[ \t\r\n]").search
_parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^ a-zß-öø-ÿ0-9]+").findall


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Byte pairs in the order in which they merge."""

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.final = np.array([vocab[s + suffix] for s in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` (none empty) one after another, and how many each has.

        In each step every word merges its earliest pair wherever it stands; a
        later pair can't come before it, as it needs what the earlier one makes.
        """
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        token, last = self.inner[raw], np.cumsum(lengths) - 1
        token[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(token), _NONE)
        todo = np.flatnonzero(word[:-1] == word[1:])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            rank[todo] = self._ranks(token[todo], token[todo + 1])
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(word)))
            resting = best == _NONE
            if resting.any():
                done.append((word[resting], token[resting]))
                token, word, rank, best = token[~resting], word[~resting], rank[~resting], best[~resting]
            hit = rank == best
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0)) if len(hit) else place
            hit &= (place - run) % 2 == 0                   # of a run of equal symbols every second pair
            at = np.flatnonzero(hit)
            token[at] = self.made[rank[at]]
            stay = np.ones(len(hit), bool)
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1                    # their places when the second halves are gone
            token, word, rank = token[stay], word[stay], rank[stay]
            rank[at] = _NONE
            near = np.zeros(len(word) + 1, bool)
            near[at] = near[at - 1] = True                  # place -1 is the spare last one
            near[len(word) - 1:] = False
            todo = np.flatnonzero(near[:-1])
            todo = todo[word[todo] == word[todo + 1]]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, token = (np.concatenate(part) for part in zip(*done))
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Numbers(dict):
    """Numbers words as they are first asked for; the words that are still to be encoded are in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Kept:
    """Ids of the words seen so far, end to end."""

    def __init__(self) -> None:
        self.place = Numbers()
        self.ids = np.zeros(1 << 16, "<u4")
        self.ends = np.zeros(1 << 14, np.int64)             # word i has ids[ends[i]:ends[i + 1]]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; :meth:`add` must follow for those in ``place.new``."""
        if len(self.place) > _KEPT:
            self.__init__()
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the words in ``place.new``, in their order."""
        n, first = len(self.place), len(self.place) - len(lengths)
        while n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        np.cumsum(lengths, out=self.ends[first + 1:n + 1])
        self.ends[first + 1:n + 1] += self.ends[first]
        while self.ends[n] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.ends[first]:self.ends[n]] = ids
        self.place.new = []

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with the numbers ``at`` one after another, and where each word's begin and the last ends."""
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])], upto


class Encoder:
    """Ids of whole texts, without special tokens added, as the library gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec["added_tokens"] or []
        self.quick = (spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER and not spec["truncation"]
                      and not spec["padding"] and MODEL.items() <= spec["model"].items()
                      and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                                  for t in added))
        if self.quick:
            self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)").search
            self.merges = Merges(spec["model"])
            self.words, self.parts = Kept(), Kept()

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` one after another, and how many each has."""
        special = self.special if self.special(" ".join(words)) else lambda word: None
        quick = [bool((w.isascii() and w.isprintable() or _plain(w)) and not special(w)) if w else False for w in words]
        plain = [w for w, q in zip(words, quick) if q]
        # The parts of all plain words, each word's first one after a blank, which has no ids.
        flat = _parts(" " + " ".join(plain).lower()) if plain else []
        at = self.parts.numbers(flat)
        if new := self.parts.place.new:
            blank = [i for i, part in enumerate(new) if part == " "]
            ids, lengths = self.merges.encode([part.encode() for part in new if part != " "])
            self.parts.add(ids, np.insert(lengths, blank, 0))
        ids, upto = self.parts.get(at)
        firsts = np.flatnonzero(at == self.parts.place[" "]) if plain else np.zeros(0, int)
        if len(plain) == len(words):
            return ids, np.diff(upto[firsts], append=len(ids))
        found = iter(np.split(ids, upto[firsts][1:]))
        every = [next(found) if q else self._library(w) for w, q in zip(words, quick)]
        return np.concatenate(every), np.array([len(f) for f in every], np.int64)

    def __call__(self, text: str) -> np.ndarray:
        return next(self.encode([text]))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text in turn as unsigned 32-bit numbers; about ``_SLICE`` characters are in hand."""
        if not self.quick:
            yield from map(self._library, texts)
            return
        begun: list[np.ndarray] = []                        # ids of a text whose end is still to come
        group, held = [], 0
        for text in texts:
            for piece, ends in _slices(text):
                group.append((piece.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), ends))
                held += len(piece)
                if held >= _SLICE:
                    yield from self._settled(group, begun)
                    group, held = [], 0
        yield from self._settled(group, begun)

    def _settled(self, group: list[tuple[list[str], bool]], begun: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Ids of the texts that end in ``group``, a list of words for each slice."""
        long = []
        for words, _ in group:
            many = max(map(len, words)) > _LONG
            long.append([(i, self._library(word)) for i, word in enumerate(words) if len(word) > _LONG] if many else [])
            for i, _ in long[-1]:
                words[i] = ""                               # put in below
        places = self.words.numbers(list(chain.from_iterable(words for words, _ in group)))
        if self.words.place.new:
            self.words.add(*self._learn(self.words.place.new))
        (ids, upto), at = self.words.get(places), 0
        for (words, ends), placed in zip(group, long):
            done = at
            for i, found in placed:
                begun += [ids[upto[done]:upto[at + i]], found]
                done = at + i
            at += len(words)
            begun.append(ids[upto[done]:upto[at]])
            if ends:
                yield np.concatenate(begun)
                begun.clear()


def _slices(text: str) -> Iterator[tuple[str, bool]]:
    """Slices of about ``_SLICE`` characters that end with words, and whether the text ends there."""
    at = 0
    while True:
        found = _space(text, at + _SLICE)
        end = found.start() if found else len(text)
        yield text[at:end], found is None
        if found is None:
            return
        at = end
