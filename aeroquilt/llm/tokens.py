"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

Aho-Corasick lists every vocabulary piece inside a word with its end; dynamic programming keeps, for each end, the best score and the
number of pieces.  Ties follow the tokenizers library's unigram model: a later candidate wins only if its score is strictly greater,
and candidates for one end come by ascending start.  A character that no one-character piece covers may be an unknown node, ten under the
least score; runs of unknown nodes fuse and fall back to bytes.  Words are split at the space, each led by the word mark, so counts are cached by word.

Defined cases: a null or empty text has no tokens; a leading space is not doubled by the word mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textnum import buffers

CACHED = 750_000  # words in each of two generations of the cache
MARK = "▁"
_counters: dict = {}


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the unknown piece's index, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class ViterbiCounter:
    """Number of pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.cache: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.byte_fallback = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.least = min(s for _, s in pieces) - 10.0
        self.automaton = ahocorasick.Automaton()
        seen = {}
        for k, (piece, score) in enumerate(pieces):
            if piece and k != unknown:
                seen[piece] = score
        for piece, score in seen.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in seen if len(p) == 1)

    def count(self, word: str) -> int:
        n = len(word)
        if self.singles.issuperset(word):  # no unknown node can occur, and every end can be reached
            best, pieces, at = [0.0] * (n + 1), [0] * (n + 1), 0
            for end, (length, score) in self.automaton.iter(word):  # the longest match of an end comes first
                start = end + 1 - length
                score += best[start]
                if end >= at:
                    at = end + 1
                    best[at], pieces[at] = score, pieces[start] + 1
                elif score > best[at]:
                    best[at], pieces[at] = score, pieces[start] + 1
            return pieces[n]
        ends: list[list] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(word):
            ends[end].append((length, score))
        best: list = [0.0] + [None] * n  # score
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)  # whether the last node is an unknown one
        least = self.least
        for end in range(n):
            top = None
            for length, score in sorted(ends[end], reverse=True):
                start = end + 1 - length
                if best[start] is not None and (top is None or score + best[start] > top):
                    top, count, last = score + best[start], pieces[start] + 1, False
            if not any(length == 1 for length, _ in ends[end]) and best[end] is not None and (top is None or least + best[end] > top):
                top, last = least + best[end], True
                if self.byte_fallback:
                    count = pieces[end] + len(word[end].encode("utf-8", "replace"))
                else:
                    count = pieces[end] + (0 if unknown[end] else 1)
            if top is not None:
                best[end + 1], pieces[end + 1], unknown[end + 1] = top, count, last
        return pieces[n]

    def counts(self, texts: list[bytes]) -> list[int]:
        out = []
        for t in texts:
            if not t:
                out.append(0)
                continue
            words = t.split(b" ")
            if not words[0] and len(words) > 1:
                words = words[1:]
            if len(self.cache) > CACHED:  # words of the generation before that are used again move on
                self.cache, self.old = {}, self.cache
            cache, old = self.cache, self.old
            try:
                out.append(sum(map(cache.__getitem__, words)))
            except KeyError:
                for w in set(words).difference(cache):
                    n = old.get(w)
                    cache[w] = self.count(MARK + w.decode("utf-8", "replace")) if n is None else n
                out.append(sum(map(cache.__getitem__, words)))
        return out


def counter(path: str) -> ViterbiCounter:
    if path not in _counters:
        _counters[path] = ViterbiCounter(*vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            data, off = buffers(batch.column(1))
            data = data.tobytes()
            for i in range(0, batch.num_rows, 256):
                j = min(batch.num_rows, i + 256)
                n = c.counts([data[off[k] : off[k + 1]] for k in range(i, j)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
