"""Token ids of whole batches of texts for lower-casing byte-pair tokenizers with an end-of-word mark.

The tokenizer's words are found in NumPy over the code points of a batch: runs of letters, single digits and runs of symbols.  Each distinct word is
merged once by a byte-pair encoder over the same merges, in which a zero byte stands for the end of a word, and kept in a table by its hash; ids
of a batch are gathered from there.  Chunks between white space that hold anything else - apostrophes, combining marks, letters whose lower
case or normal form depends on their neighbours, characters newer than Unicode 3.2 - go to the tokenizers library as they are, and so do
whole texts with the string of a special token.  Ids equal those of the library, which a test holds on odd texts.

The table is emptied when it is full.  A word costs about a microsecond to learn again, no more than to look up a few times, so a
corpus with more distinct words than the table holds is slower by little.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .textnum import mix

#: What a tokenizer file must say for its words to be found here.  Fixed value: its pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
_BASE = 0x9E3779B97F4A7C15
_tables: dict = {}
_powers: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below 65536."""
    if "classes" not in _tables:
        kind, low = np.full(1 << 16, OTHER, np.uint8), np.arange(1 << 16, dtype=np.uint32)
        joins = {int(d.split()[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and len(d.split()) == 2}
        for c in range(1 << 16):
            x = chr(c)
            was = unicodedata.category(x)
            if c in (9, 10, 11, 12, 13, 32):
                kind[c] = SPACE
            elif "0" <= x <= "9":
                kind[c] = DIGIT
            elif x == "'" or c in joins or 0x1100 <= c < 0x1200 or unicodedata.combining(x) or was != unicodedata.ucd_3_2_0.category(x) or unicodedata.normalize("NFC", x) != x:
                continue
            elif was[0] == "L":
                y = x.lower()
                if len(y) == 1 and y not in "σς" and unicodedata.normalize("NFC", y) == y and ord(y) not in joins:
                    kind[c], low[c] = LETTER, ord(y)
            elif was[0] in "PS" and x.lower() == x:
                kind[c] = SYMBOL
        _tables["classes"] = kind, low
    return _tables["classes"]


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 19), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 21:
            _powers[inverse] = have
    return have[:n]


class WordMerges:
    """Ids of many words at once: a byte-pair encoder whose ranks are the merges in order, with "\\0" for the end-of-word mark."""

    def __init__(self, vocab: dict[str, int], merges: list):
        import tiktoken

        letters = _byte_letters()

        def raw(piece: str) -> bytes:
            end = piece.endswith("</w>")
            return bytes(letters[c] for c in (piece[:-4] if end else piece)) + b"\0" * end

        written = {b: c for c, b in letters.items()}
        order = [(bytes([b]), vocab.get(written[b], 0)) for b in range(256)] + [(bytes([b, 0]), vocab[written[b] + "</w>"]) for b in range(1, 256)]
        order += [(raw(a + b), vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        ranks: dict[bytes, int] = {}
        ids = []
        for piece, i in order:
            if piece not in ranks:
                ranks[piece] = len(ids)
                ids.append(i)
        self.ids = np.array(ids, np.uint32)
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for piece, r in ranks.items() if piece.endswith(b"\0")]] = True
        self.encode = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def __call__(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each ended by "\\0", and the place after each word's last one."""
        ranks = np.frombuffer(self.encode(words, set()), np.uint32)
        return self.ids[ranks], np.flatnonzero(self.ends[ranks]) + 1


class Pool:
    """Ids of words by the hash of the word, in an open-addressed table of fixed size."""

    def __init__(self, bits: int):
        self.bits, self.most = bits, 1 << (bits - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.start, self.size = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        self.ids, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        out, left, step = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        while len(left):
            slot = ((h[left] >> np.uint64(64 - self.bits)).astype(np.int64) + step) & (len(self.keys) - 1)
            held = self.keys[slot]
            hit = held == h[left]
            out[left[hit]] = slot[hit]
            left, step = left[~hit & (held != 0)], step + 1
        return out

    def put(self, h: np.ndarray, ids: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Slots of new, distinct hashes, whose ids end at ``stop``."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        start = np.r_[0, stop[:-1]] + self.used
        self.used, self.held = self.used + len(ids), self.held + len(h)
        slot, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = h[left[free]]  # of several, the last one stays
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.start[slot], self.size[slot] = start, np.diff(np.r_[0, stop])
        return slot


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pool = Tokenizer.from_file(path), Pool(bits)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"].encode() for t in told["added_tokens"]]
        model, split = told["model"], json.dumps(told["pre_tokenizer"])
        fits = model.get("end_of_word_suffix") == "</w>" and json.dumps(PATTERN) in split and '"Lowercase"' in json.dumps(told["normalizer"])
        self.merges = WordMerges(model["vocab"], model["merges"]) if fits else None

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (bytes and n + 1 offsets), one text after another, and n + 1 offsets of them."""
        raw = data.tobytes()
        texts = None
        if self.merges is None or any(s in raw for s in self.special):
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        if self.merges is None:
            ids = self.whole(texts)
        elif texts is not None:  # those with a special token apart
            apart = [any(s in raw[a:b] for s in self.special) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            ids = [self.whole([t])[0] if x else self._words(t.encode(), np.array([0, len(t.encode())]))[0] for t, x in zip(texts, apart, strict=True)]
        else:
            return self._words(raw, off)
        return np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32), np.cumsum([0, *map(len, ids)])

    def _words(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=leads[1:])
        doc = leads[off]
        if doc[-1] != len(codes):  # not UTF-8: decode one by one
            parts = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            codes, doc = np.frombuffer(b"".join(parts), np.uint32), np.cumsum([0, *(len(p) // 4 for p in parts)])
        n = len(codes)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(doc), np.int64)
        kinds, lower = classes()
        small = np.minimum(codes, 0xFFFF)
        kind, low = kinds[small], lower[small]
        if codes.max() > 0xFFFF:
            kind, low = np.where(codes > 0xFFFF, np.uint8(OTHER), kind), np.where(codes > 0xFFFF, codes, low)
        solid, cut = kind != SPACE, np.zeros(n + 1, bool)
        cut[doc] = True
        chunk = solid.copy()  # where a chunk between white space begins
        chunk[1:] &= ~solid[:-1] | cut[1:n]
        begin = chunk | (solid & ((kind == DIGIT) | np.r_[True, kind[1:] != kind[:-1]] | np.r_[True, kind[:-1] == DIGIT]))
        odd_at = np.flatnonzero(kind == OTHER)
        first = np.flatnonzero(chunk)
        odd = np.zeros(len(first), bool)
        if len(odd_at):
            odd[np.searchsorted(first, odd_at, "right") - 1] = True
            inside = solid & np.repeat(np.r_[False, odd], np.diff(np.r_[0, first, n]))
            begin &= ~inside | chunk
            low = np.where(inside, codes, low)
        end = np.ones(n, bool)
        end[:-1] = begin[1:] | ~solid[1:] | cut[1:n]
        end &= solid
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(n, False), out=total[1:])
        h = (total[e] - total[b]) * _power(n, True)[b] + (e - b).astype(np.uint64)
        if len(odd_at):
            h ^= np.where(odd[np.searchsorted(first, b, "right") - 1], np.uint64(0xA0761D6478BD642F), np.uint64(0))
        h = mix(h) | np.uint64(1)
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]  # a word of each hash
        slot = self.pool.find(h[one])
        if self.pool.held + int((slot < 0).sum()) > self.pool.most:
            if len(one) > self.pool.most:  # a batch with more distinct words than the table holds
                self.pool = Pool(len(one).bit_length() + 1)
            self.pool.clear()
            slot[:] = -1
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            slot[miss] = self._learn(h[one[miss]], codes, low, b[one[miss]], e[one[miss]], odd[np.searchsorted(first, b[one[miss]], "right") - 1])
        slot = slot[which]
        size, start = self.pool.size[slot].astype(np.int64), self.pool.start[slot]
        ends = np.cumsum(size)
        ids = self.pool.ids[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.r_[0, ends][np.searchsorted(b, doc)]

    def _learn(self, h: np.ndarray, codes: np.ndarray, low: np.ndarray, b: np.ndarray, e: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Slots of new words, which stand at ``b`` to ``e``."""
        slots = np.empty(len(h), np.int64)
        plain = np.flatnonzero(~odd)
        if len(plain):
            size = (e - b)[plain] + 1
            ends = np.cumsum(size)
            at = np.repeat(b[plain] - ends + size, size) + np.arange(int(ends[-1]))
            words = low[np.minimum(at, len(low) - 1)]
            words[ends - 1] = 0
            ids, stop = self.merges(words.astype("<u4").tobytes().decode("utf-32-le"))
            if len(stop) != len(plain):
                raise AssertionError("words and their ends differ")
            slots[plain] = self.pool.put(h[plain], ids, stop)
        rest = np.flatnonzero(odd)
        for i in range(0, len(rest), 1000):
            some = rest[i : i + 1000]
            ids = self.whole([codes[x:y].tobytes().decode("utf-32-le") for x, y in zip(b[some].tolist(), e[some].tolist(), strict=True)])
            slots[some] = self.pool.put(h[some], np.concatenate(ids), np.cumsum([len(x) for x in ids]))
        return slots
