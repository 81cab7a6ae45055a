"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All new words of a batch lie in one flat numpy array of symbols. Each round finds the best pair rank of every word (a
segmented minimum), merges the leftmost occurrences of that pair in all words at once, compacts the array, and goes on
with the words that still have a pair. Ids equal those of the sentencepiece library for BPE models with the identity
normaliser, with or without byte fallback.

Defined results: a null text is the empty text; an empty text has only the begin and end ids and decodes to "". Rows
are independent of each other, so repeated rows, ties and any order give the same rows; an empty table gives an empty
table. Columns other than the id and text columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words that a worker keeps; then it starts anew. A bound on memory only.
CACHE_WORDS = 300_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of one level of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return n, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif wire == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        elif wire == 1:
            value, i = struct.unpack("<d", data[i : i + 8])[0], i + 8
        else:
            raise ValueError("not a sentencepiece model")
        yield tag >> 3, value


class Model:
    """A BPE model file as lookup arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, kinds, scores, trainer, normal = [], [], [], {}, {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                pieces.append(p[1].decode())
                scores.append(p.get(2, 0.0))
                kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3, 1) != 2 or normal.get(2) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24, 0):
            raise ValueError("only BPE models with the identity normaliser and no user-defined pieces are read")
        if normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("a model that removes white space or does not escape it is not read")
        self.prefix = bool(normal.get(3, 1))
        self.pieces, self.size = pieces, len(pieces)
        self.kinds = np.array(kinds)
        self.unk = kinds.index(UNKNOWN)
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.fallback = bool(trainer.get(35, 0))
        self.bytes0 = pieces.index("<0x00>") if self.fallback else -1
        own = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.char = {p: i for p, i in own.items() if len(p) == 1}
        self.chars = np.array(sorted(map(ord, self.char)), dtype=np.int64)
        self.char_ids = np.array([self.char[chr(c)] for c in self.chars], dtype=np.int64)
        # The best score has rank 0; equal scores share a rank, among them the leftmost pair goes first.
        order = {s: r for r, s in enumerate(sorted({np.float32(s) for s in scores}, reverse=True))}
        self.rank = np.array([order[np.float32(s)] for s in scores], dtype=np.int64)
        left, right, made, near = [], [], [], set()
        self.alone = np.zeros(self.size, dtype=bool)
        for z, i in own.items():
            for k in range(1, len(z)):
                near.add((ord(z[k - 1]) << 21) | ord(z[k]))
                x, y = own.get(z[:k]), own.get(z[k:])
                if x is None or y is None:
                    continue
                left.append(x)
                right.append(y)
                made.append(i)
                # A pair whose result may at once take part in a better pair is merged one occurrence at a time.
                for c in (x, y):
                    if self.rank[c] >= self.rank[i] and len(pieces[c]) > 1:
                        self.alone[c] = True
        self.near = np.array(sorted(near), dtype=np.int64)
        self.table(np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64), np.array(made, dtype=np.int64))
        out = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([i - self.bytes0]) if k == BYTE else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_len = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.whole = any(p[k] == SPACE and p[k - 1] != SPACE for p in own for k in range(1, len(p)))

    def table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing, so that a lookup costs a few gathers."""
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_made = np.full(1 << self.bits, -1, dtype=np.int64)
        at, todo = self.spot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slots[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.slots[at[put]], self.slot_made[at[put]] = keys[put], made[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, keys: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        at = self.spot(keys)
        found = self.slots[at]
        made = np.where(found == keys, self.slot_made[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[todo]]
            hit = found == keys[todo]
            made[todo[hit]] = self.slot_made[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return made

    def merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains. ``sym``: piece ids, negative for characters without a piece; ``seg``: ascending."""
        done_sym, done_seg, far = [], [], np.iinfo(np.int64).max
        while len(sym):
            same = (seg[1:] == seg[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0)
            made = np.full(len(sym), -1, dtype=np.int64)
            at = np.flatnonzero(same)
            made[at] = self.pair(sym[at] * self.size + sym[at + 1])
            rank = np.where(made >= 0, self.rank[made], far)
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            length = np.diff(np.append(first, len(seg)))
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, length)
            going = best < far
            if not going.all():
                done_sym.append(sym[~going])
                done_seg.append(seg[~going])
                sym, seg, made, rank, best = sym[going], seg[going], made[going], rank[going], best[going]
                if not len(sym):
                    break
            take = rank == best
            pos = np.flatnonzero(take)
            # Of pairs that overlap in a row, every second one counting from the left.
            row = np.flatnonzero(np.concatenate(([True], np.diff(pos) != 1)))
            take[pos[(np.arange(len(pos)) - np.repeat(row, np.diff(np.append(row, len(pos))))) % 2 == 1]] = False
            pos = np.flatnonzero(take)
            lone = np.concatenate(([True], seg[pos][1:] != seg[pos][:-1]))  # the leftmost of its word
            careful = np.repeat(np.logical_or.reduceat(self.alone[made[pos]], np.flatnonzero(lone)), np.diff(np.append(np.flatnonzero(lone), len(pos))))
            pos = pos[lone | ~careful]
            sym = sym.copy()
            sym[pos] = made[pos]
            keep = np.ones(len(sym), dtype=bool)
            keep[pos + 1] = False
            sym, seg = sym[keep], seg[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has. Every word has a character at least."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), length)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        sym = np.where(self.chars[at] == code, self.char_ids[at], -1 - code)
        # Neighbours that no piece holds side by side can't ever be merged: a word ends there for our purpose.
        key = (code[:-1] << 21) | code[1:]
        near = self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] == key if len(self.near) else np.zeros(len(key), bool)
        seg = np.concatenate(([0], np.cumsum((word[1:] != word[:-1]) | ~near)))
        owner = word[np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))]
        sym, seg = self.merge(sym, seg)
        word = owner[seg]
        if (sym < 0).any():
            lost = [[self.bytes0 + b for b in chr(-1 - s).encode("utf-8", "replace")] if self.fallback else [self.unk] for s in sym[sym < 0]]
            times = np.ones(len(sym), dtype=np.int64)
            times[sym < 0] = [len(x) for x in lost]
            missing = np.repeat(sym < 0, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[missing] = np.concatenate(lost)
        return sym, np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode(ids) returns."""
        n = self.out_len[ids]
        total = int(n.sum())
        at = np.repeat(self.out_at[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        raw = self.out[at].tobytes()
        if self.prefix:
            shown = np.flatnonzero(self.kinds[ids] != CONTROL)
            if len(shown) and self.pieces[ids[shown[0]]].startswith(SPACE):
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(self._bytes(raw))

    @staticmethod
    def _bytes(raw: bytes) -> Iterator[str]:
        """Each byte that starts no valid character becomes one replacement character."""
        i = 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    yield raw[i : i + n].decode()
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                yield "�"
                i += 1


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


class Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """A model with the words met so far."""

    def __init__(self, model: Model, cache: int = CACHE_WORDS):
        self.model, self.cache = model, cache
        self.clear()

    def clear(self) -> None:
        self.words, self.known = Words(), 0
        self.pool, self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        m = self.model
        if len(self.words) > self.cache:
            self.clear()
        per, flat = [], []
        for t in texts:
            t = (SPACE if m.prefix and t else "") + t.replace(" ", SPACE)
            w = ([t] if t else []) if m.whole else m.cut.findall(t)
            per.append(len(w))
            flat += w
        index = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        if len(self.words) > self.known:
            new = list(self.words)[self.known :]
            ids, n = m.encode_words(new)
            self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(n) - n))
            self.len = np.concatenate((self.len, n))
            self.pool = np.concatenate((self.pool, ids))
            self.known = len(self.words)
        n = self.len[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.at[index] - (ends - n), n) + np.arange(total)]
        stops = np.concatenate(([0], ends))[np.cumsum(per)] if per else np.zeros(0, np.int64)
        return np.split(ids, stops[:-1]) if per else []


def tokenise(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded string): ids with begin and end, and their decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(load(model_path))
        m = enc.model
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts):
                ids = [np.concatenate(([m.bos], x, [m.eos])) for x in enc.encode(texts[a:b])]
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].array, "ids": [x.astype(np.int32) for x in ids], "decoded": [m.decode(x) for x in ids]})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what ``tokenise`` gives, in a few bytes a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(load(model_path))
        m = enc.model
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts):
                ids = [np.concatenate(([m.bos], x, [m.eos])) for x in enc.encode(texts[a:b])]
                yield pd.DataFrame({
                    "id": pdf["id"].iloc[a:b].array, "n_tokens": np.array([len(x) for x in ids], dtype=np.int64),
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(m.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids],
                })

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
