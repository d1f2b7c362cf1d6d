"""SentencePiece encoding by an Aho-Corasick automaton that drives a single-pass Viterbi.

The automaton holds the UTF-8 bytes of all pieces of a model. A text is read once; at each byte the
state's output links list the pieces that end there, and each relaxes the best score of its end.

* In a unigram model a path scores the sum of its pieces. Of equal scores the longer last piece wins.
* In a model of merges (BPE) scores only say which merge comes first, so their sum means nothing. What
  merging leaves of a text is the one path on which every two neighbours stand: merging their joined
  text leaves just these two. So a step scores 0 if it stands with the best piece before it, and is
  none otherwise, and of the pieces that end at a place exactly one is relaxed. Whether two pieces
  stand is found by merging them once, and kept.

Characters that no piece covers become byte pieces, at a score under all others. New words of a batch
of texts go through the automaton side by side, a byte of each at a time. Pieces hold the space mark
only in front, and no line break, so the path of a text is that of its words, each with the spaces or
break before it; a worker keeps the paths of words it has seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from advisium.llm.common import ready, texts

MODEL, SPACE = "piece_bpe_32k.model", "▁"
#: Words that each of a worker's two caches keeps; the older is dropped when the newer is full.
CACHE = 220_000
#: How far a character without a piece is under the worst piece, as in the public library.
UNKNOWN = 10.0
#: Bytes of words that go through the automaton side by side, padding included.
CELLS = 1 << 19
_WORD = re.compile("\n[^ \n]*| +[^ \n]*")
_MODELS: dict[str, Pieces] = {}


class Automaton:
    """Aho-Corasick over the bytes of pieces; state 0 is the root."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float, int]] = {}
        levels: list[list[tuple[int, int, int]]] = []
        for piece, (i, score) in pieces.items():
            at = 0
            data = piece.encode()
            for depth, b in enumerate(data):
                nxt = tree[at].get(b)
                if nxt is None:
                    nxt = tree[at][b] = len(tree)
                    tree.append({})
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((at, b, nxt))
                at = nxt
            ends[at] = (len(data), score, i)
        n = len(tree)
        self.go = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        self.size, self.score, self.piece = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1, np.int64)
        for at, (size, score, i) in ends.items():
            self.size[at], self.score[at], self.piece[at] = size, score, i
        fail = np.zeros(n, np.int64)
        #: The nearest state on the fail path, itself first, at which a piece ends, and the next one; 0 is none.
        self.out, self.next = np.zeros(n, np.int64), np.zeros(n, np.int64)
        _, b, node = np.array(levels[0]).T
        self.go[0, b] = node
        for depth, level in enumerate(levels):
            parent, b, node = np.array(level).T
            if depth:
                fail[node] = self.go[fail[parent], b]
            self.go[node] = self.go[fail[node]]
            self.next[node] = self.out[fail[node]]
            self.out[node] = np.where(self.piece[node] >= 0, node, self.next[node])
            if depth + 1 < len(levels):  # a state's children take the place of what its fail state would do
                up, c, down = np.array(levels[depth + 1]).T
                self.go[up, c] = down

    def best(self, words: np.ndarray, sizes: np.ndarray, unknown: float, merges: Merges | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each word and each of its ends the size and id of the best last piece; -1 is a character without one.

        words: bytes, a row each, padded with zeros. With merges the steps that stand are the only ones.
        """
        n, longest = words.shape
        rows = np.arange(n)
        score = np.full((n, longest + 1), -np.inf)
        score[:, 0] = 0
        last, piece = np.zeros((n, longest + 1), np.int64), np.full((n, longest + 1), -1, np.int64)
        begins = (words & 0xC0) != 0x80
        start, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for end in range(1, longest + 1):
            start = np.where(begins[:, end - 1], end - 1, start)
            state = self.go[state, words[:, end - 1]]
            whole = begins[:, end] | (sizes == end) if end < longest else np.ones(n, bool)
            top = np.where(whole, score[rows, start] + unknown, -np.inf)
            took, which = end - start, np.full(n, -1, np.int64)
            at = self.out[state]
            some = np.flatnonzero(at)
            at = at[some]
            while len(some):
                size = self.size[at]
                if merges is not None:
                    better = whole[some] & merges.stand(piece[some, end - size], self.piece[at])
                    value = np.zeros(len(some))
                else:
                    value = score[some, end - size] + self.score[at]
                    better = value > top[some]
                won = some[better]
                top[won], took[won], which[won] = value[better], size[better], self.piece[at[better]]
                at = self.next[at]
                more = (at > 0) & ~better if merges is not None else at > 0
                some, at = some[more], at[more]
            score[:, end], last[:, end], piece[:, end] = top, took, which
        return last, piece

    def paths(self, words: list[bytes], unknown: float, merges: Merges | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of words of about one length: pieces and their sizes in bytes, joined, and where each word's begin."""
        sizes = np.array([len(w) for w in words])
        longest = int(sizes.max())
        table = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(-1, longest)
        last, piece = self.best(table, sizes, unknown, merges)
        ids, took = [], []
        at, rows = sizes.copy(), np.arange(len(words))
        while at.any():
            size = np.where(at > 0, last[rows, at], 0)
            ids.append(np.where(at > 0, piece[rows, at], -2))
            took.append(size)
            at = at - size
        ids, took = np.array(ids[::-1]).T, np.array(took[::-1]).T
        real = ids != -2
        return ids[real], took[real], np.concatenate([[0], np.cumsum(real.sum(axis=1))])


class Merges(dict):
    """Which pieces stand behind which, by their numbers; of pairs that were asked for."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.order = {p: -score for p, (_, score) in pieces.items()}
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.wide = max(self.text) + 2

    def left(self, text: str) -> list[str]:
        """What merging leaves of a text: the pair of the first order is merged, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            orders = [self.order.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(orders)), key=orders.__getitem__)
            if orders[k] == np.inf:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def __missing__(self, key: int) -> bool:
        if len(self) >= CACHE:
            self.clear()
        before, after = divmod(key, self.wide)
        pair = [self.text[x] for x in (before - 1, after) if x >= 0]
        out = self[key] = self.left("".join(pair)) == pair
        return out

    def stand(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """before: -1 is the start of a word, or a character without a piece, which nothing merges with."""
        return np.fromiter(map(self.__getitem__, ((before + 1) * self.wide + after).tolist()), bool, len(after))


class Pieces:
    """A model file's pieces, with encoding and decoding."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.unk = model.unk_id()
        self.bytes_at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.fallback = self.unk not in self.bytes_at
        self.automaton = Automaton(plain)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        self.merges = Merges(plain) if spec.model_type == spec.BPE else None
        self.unknown = min(score for _, score in plain.values()) - UNKNOWN
        #: Whether words can be encoded on their own.
        self.parted = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain)
        data = [b""] * n
        for piece, (i, _) in plain.items():
            data[i] = piece.replace(SPACE, " ").encode()
        if self.fallback:
            for b, i in enumerate(self.bytes_at):
                data[i] = bytes([b])
        data[self.unk] = " ⁇ ".encode()
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.long = np.array([len(x) for x in data])
        self.at = np.cumsum(self.long) - self.long
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of texts whose spaces are to become marks, each by itself."""
        data = [w.replace(" ", SPACE).encode() for w in words]
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        out = [b""] * len(data)
        k = 0
        while k < len(order) and not data[order[k]]:
            k += 1
        while k < len(order):
            end = k + 1
            while end < len(order) and (end - k + 1) * len(data[order[end]]) <= CELLS:
                end += 1
            ids, took, starts = self.automaton.paths([data[i] for i in order[k:end]], self.unknown, self.merges)
            odd = np.flatnonzero(ids < 0)
            if len(odd):
                ids, starts = self._fallback(ids, took, starts, b"".join(data[i] for i in order[k:end]))
            packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            places = (starts * width).tolist()
            for i, a, b in zip(order[k:end], places, places[1:], strict=False):
                out[i] = packed[a:b]
            k = end
        return out

    def _fallback(self, ids: np.ndarray, took: np.ndarray, starts: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids with byte pieces, or the unknown piece, for characters without a piece."""
        odd = ids < 0
        wide = np.where(odd & self.fallback, took, 1)
        out = np.repeat(ids, wide)
        if self.fallback:
            covered = np.repeat(odd, took)
            out[np.repeat(odd, wide)] = self.bytes_at[np.frombuffer(data, np.uint8)[covered]]
        else:
            out[np.repeat(odd, wide)] = self.unk
        return out, np.concatenate([[0], np.cumsum(wide)])[starts]

    def _learn(self, new: dict[str, None]) -> None:
        if len(self.words) > CACHE:
            self.words, self.older = {}, self.words
        fresh = []
        for w in new:
            ids = self.older.get(w)
            if ids is None:
                fresh.append(w)
            else:
                self.words[w] = ids
        self.words.update(zip(fresh, self.encode_words([w if w[:1] == "\n" else " " + w for w in fresh]), strict=True))

    def encode(self, found: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers; a space is put before a text that is not empty."""
        out: list[bytes] = [b""] * len(found)
        late, whole, new = [], [], {}
        get = self.words.get
        for i, text in enumerate(found):
            if not text:
                continue
            if not self.parted:
                whole.append(i)
                continue
            ws = text.replace("\n", " \n").split(" ")
            if "" in ws or SPACE in text:  # spaces beside spaces stay with the word behind them
                ws = [w.removeprefix(" ") for w in _WORD.findall(" " + text.replace(SPACE, " "))]
            parts = list(map(get, ws))
            k, holes = -1, []
            for _ in range(parts.count(None)):
                k = parts.index(None, k + 1)
                holes.append(k)
                new[ws[k]] = None
            if holes:
                late.append((i, parts, holes, ws))
            else:
                out[i] = b"".join(parts)
        if new:
            self._learn(new)
        words = self.words
        for i, parts, holes, ws in late:
            for k in holes:
                parts[k] = words[ws[k]]
            out[i] = b"".join(parts)
        for i, ids in zip(whole, self.encode_words([" " + found[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of some ids, without the space that encoding puts in front."""
        flat = np.frombuffer(b"".join(ids), self.dtype)
        wide = self.long[flat]
        ends = np.cumsum(wide)
        data = self.data[np.repeat(self.at[flat] - ends + wide, wide) + np.arange(int(wide.sum()))].tobytes()
        last = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // self.dtype.itemsize for x in ids)])].tolist()
        return [data[a:b].decode(errors="replace")[1:] for a, b in zip(last, last[1:], strict=False)]


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, ids, decoded) of whole texts, one row per row.

    ids: little-endian numbers, of 16 bits for up to 65,536 pieces. ids_crc32: their unsigned crc32
    as 32-bit numbers. decoded: the text that the ids give back; it equals the text, but that the
    mark U+2581 comes back as a space. Null texts are empty and have no ids; null doc_ids stay
    null; repeated rows give repeated rows; other columns are not read.
    """
    ready(docs.sparkSession)
    path = public_tokenizers.path(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in parts:
            ids = p.encode(texts(part))
            wide = [np.frombuffer(x, p.dtype).astype("<u4") for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in wide], pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64()), pa.array(ids, pa.binary()), pa.array(p.decode(ids), pa.string())],
                ["doc_id", "n_pieces", "ids_crc32", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, ids binary, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_chars, round_trip) from the ids and the text they give back.

    round_trip: the decoded text equals the text with U+2581 as a space. Edge cases as in encode().
    """
    ready(docs.sparkSession)
    path = public_tokenizers.path(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in parts:
            found = texts(part)
            ids = p.encode(found)
            back = p.decode(ids)
            wide = [np.frombuffer(x, p.dtype).astype("<u4") for x in ids]
            same = [a.replace(SPACE, " ") == b for a, b in zip(found, back, strict=True)]
            cols = ([len(x) for x in wide], [zlib.crc32(x) for x in wide], [len(x) for x in back])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "n_chars", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, round_trip boolean")
