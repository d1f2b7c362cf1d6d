"""Token ids of whole texts from a public tokenizer, with a cache of words that a worker keeps."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: A word that may stand on its own: no other white space at either end, after its line break if it has one.
_SAFE = re.compile(r"\n?\S(?:.*\S)?", re.S)
#: Marks that are, as many as stand there, a piece of their own after a letter.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Rows of marks that a worker keeps, and new words that are encoded as one text: the library is slower with more.
TAILS, TOGETHER = 4096, 256
#: Words that each of a worker's two caches keeps; the older is dropped when the newer is full.
CACHE = 800_000
_ENCODERS: dict[tuple, WordEncoder] = {}


class WordEncoder:
    """Byte-level BPE of whole texts.

    The pre-tokenizer's pieces never reach over a space or line break that stands between other
    characters, so a text's ids are those of its words, each with the space or break before it. New
    words are encoded many as one text; a word's ids begin where a token begins with a space or break. Texts with other runs of white space, or with the string of a special token, are
    encoded in one go. Words of a batch are looked up once each, and their ids dealt out by numpy.
    """

    def __init__(self, path: str, plain: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token[0] in "\u0120\u010a"]] = True  # a space, a line break
        special = [] if plain else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tails: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _raw(self, found: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Puts words in the cache; a word that ends in marks is its letters and the marks."""
        if len(self.words) > CACHE:
            self.words, self.older = {}, self.words
        if len(self.tails) > TAILS:
            self.tails = {}
        words, older, tails = self.words, self.older, self.tails
        fresh, marked = {}, []
        for w in new:
            if (ids := older.get(w)) is not None:
                words[w] = ids
            elif (core := w.rstrip(_MARKS)) != w and core.removeprefix("\n").isalpha():
                tail = w[len(core) :]
                if tail not in tails:
                    tails[tail] = self._raw([tail])[0]
                marked.append((w, core, tail))
                if core not in words:
                    if (ids := older.get(core)) is not None:
                        words[core] = ids
                    else:
                        fresh[core] = None
            elif _SAFE.fullmatch(w):
                fresh[w] = None
        if fresh:
            behind = [w if w[0] == "\n" else " " + w for w in fresh]
            data, size = b"".join(self._raw(["".join(behind[k : k + TOGETHER]) for k in range(0, len(behind), TOGETHER)])), self.dtype.itemsize
            ids = np.frombuffer(data, self.dtype)
            at = (np.flatnonzero(self.begins[ids]) * size).tolist()
            if len(at) != len(fresh):
                raise ValueError("words and the places where they begin differ")
            words.update(zip(fresh, map(data.__getitem__, map(slice, at, [*at[1:], len(data)])), strict=True))
        for w, core, tail in marked:
            words[w] = words[core] + tails[tail]

    def __call__(self, found: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of self.dtype."""
        out: list[bytes | None] = [None] * len(found)
        split = [i for i, text in enumerate(found) if not (self.special and self.special.search(text))]
        if split:
            # the first word behind a break, which is cut off below; nothing stands before the break
            lists = pc.split_pattern(pa.array([f"\n{found[i]}".replace("\n", " \n") for i in split], pa.large_string()), " ")
            ends = lists.offsets.to_numpy()
            every = lists.values.dictionary_encode()
            ws, at = every.dictionary.to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy()
            ids = list(map(self.words.get, ws))
            if new := [w for w, x in zip(ws, ids, strict=True) if x is None]:
                self._learn(new)
                late = iter(map(self.words.get, new))
                ids = [next(late) if x is None else x for x in ids]
            lack = np.array([x is None for x in ids], bool)[at]
            lack[ends[:-1]] = False  # what stands before the break
            odd = np.add.reduceat(lack, ends[:-1], dtype=np.int64) > 0
            ids = [x or b"" for x in ids]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
            n, last = size[at], np.cumsum(size[at])
            place = np.repeat((np.cumsum(size) - size)[at] - last + n, n)
            place += np.arange(len(place))
            data = np.frombuffer(b"".join(ids), self.dtype)[place].tobytes()
            last = np.concatenate([[0], last])[ends] * self.dtype.itemsize
            for i, start, end, is_odd in zip(split, last[:-1].tolist(), last[1:].tolist(), odd.tolist(), strict=True):
                if not is_odd:
                    out[i] = data[start + self.dtype.itemsize : end]
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._raw([found[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(path: str, plain: bool = False) -> WordEncoder:
    """plain: strings of special tokens are ordinary text."""
    key = (path, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, plain)
    return _ENCODERS[key]
