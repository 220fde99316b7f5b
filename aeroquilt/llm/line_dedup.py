"""Line dedup: lines that several documents share stay only in the smallest document that holds them.

A line's key is a 128-bit digest of the normalised line.  Blocks of documents ask ranges of digests about their distinct keys
(``blocks.exchange``), each with its least document ids, as many as ``min_docs``: that is enough to tell whether so many
documents hold the line, and a line that every document holds costs a few questions for each block.  The smallest holder of each shared key goes back to
the blocks, which take out its lines by position.  Texts are split and hashed twice, in Arrow batches; lines are never rows.

Defined cases: a null or empty text is one empty line; a null id counts as larger than every other id; rows of one id are one
document when holders of a line are counted; extra columns pass through unchanged, but columns of the names that are added are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .blocks import exchange, range_count, to_blocks, with_answers
from .common import table

SPACES = b" \t\n\x0b\f\r"
_LAST_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased (other letters stay)."""
    return line.strip(SPACES).lower()  # of bytes, lower() changes A-Z alone


def line_keys(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, as rows of two 64-bit numbers, of the lines with long enough keys, with their document and position."""
    raw, doc, position, digest = [], [], [], hashlib.blake2b
    for d, text in enumerate(texts):
        if len(text) < min_chars:
            continue
        for i, line in enumerate(text.split(b"\n")):
            key = line.strip(SPACES).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                raw.append(digest(key, digest_size=16).digest())
                doc.append(d)
                position.append(i)
    return np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), 2), np.array(doc, np.int64), np.array(position, np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def asker(text_col: str, min_chars: int, min_docs: int):
    """Keys of a block, each with its ``min_docs`` (at least two) least distinct documents in a row of its own; with ``state``, its lines and their keys too."""
    most = max(2, min_docs)

    def ask(rows: pa.Table, state: bool = False):
        texts = [x or b"" for x in rows.column(text_col).cast(pa.binary()).to_pylist()]
        keys, doc, position = line_keys(texts, min_chars)
        ids = rows.column("__doc").to_numpy()[doc]
        order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
        h, g, ids = keys[order, 0], keys[order, 1], ids[order]
        new = _changes(h, g)
        one = _changes(h, g, ids)  # the lines of one document with one key are one question
        first = np.flatnonzero(new)
        nth = np.cumsum(one) - np.repeat(np.cumsum(one)[first], np.diff(np.append(first, len(h))))
        asked = np.flatnonzero(one & (nth < most))
        out = h[asked], [g[asked], ids[asked]]
        if not state:
            return out
        line_of = np.empty(len(h), np.int64)
        line_of[order] = np.cumsum(new) - 1  # each line's key, by number
        return out[0], (texts, doc, position, line_of, (np.cumsum(new) - 1)[asked])

    return ask


def folder(min_docs: int):
    """The smallest document of each key that at least ``min_docs`` documents hold, told to the blocks with a larger one: at the first question of the key."""

    def fold(h: np.ndarray, columns: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, ids = columns
        order = np.lexsort((ids, g, h))
        new = _changes(h[order], g[order])
        one = _changes(h[order], g[order], ids[order])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        shared = np.repeat(np.add.reduceat(one.astype(np.int64), first) >= min_docs, size) if len(first) else new
        least = np.empty(len(h), np.int64)
        least[order] = np.where(shared, np.repeat(ids[order][first], size), _LAST_ID)
        lead = _changes(block, h, g)  # questions of a block come together, by key and document
        most = np.maximum.reduceat(ids, np.flatnonzero(lead)) if len(h) else ids
        at = np.flatnonzero(lead)[most > least[lead]]
        return at, least[at]

    return fold


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text_col`` (null: empty), and ``n_lines``, ``n_dropped`` (long) added."""
    docs = docs.drop("n_lines", "n_dropped")
    given = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)))
    blocks = to_blocks(given, "line-blocks")
    ranges, ask = range_count(blocks), asker(text_col, min_chars, min_docs)
    answered = exchange(blocks, lambda rows: ask(rows), [np.uint64, np.int64], folder(min_docs), np.int64, ranges, "line-holders")
    place = docs.columns.index(text_col)

    def use(rows: pa.Table, state, at: np.ndarray, values: np.ndarray) -> pa.Table:
        texts, doc, position, key, asked = state
        least = np.full(int(key.max()) + 1 if len(key) else 0, _LAST_ID)
        least[asked[at]] = values
        gone = np.flatnonzero(rows.column("__doc").to_numpy()[doc] > least[key])
        drop: dict[int, set[int]] = {}
        for d, i in zip(doc[gone].tolist(), position[gone].tolist(), strict=True):
            drop.setdefault(d, set()).add(i)
        lines = [1 + t.count(b"\n") for t in texts]
        for d, some in drop.items():
            texts[d] = b"\n".join([x for i, x in enumerate(texts[d].split(b"\n")) if i not in some])
        kept = pa.array(texts, pa.binary()).cast(rows.column(text_col).type)
        rows = rows.drop_columns("__doc").set_column(place, text_col, kept)
        return rows.append_column("n_lines", pa.array(lines, pa.int64())).append_column("n_dropped", pa.array([len(drop.get(d, ())) for d in range(len(texts))], pa.int64()))

    schema = StructType([*[StructField(f.name, f.dataType, True) for f in docs.schema.fields], StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return with_answers(blocks, answered, ask, use, np.int64, ranges, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
d as (select k.doc_id, k.pos, k.line, (s.key is not null and k.doc_id <> s.first) as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from d group by doc_id
"""
