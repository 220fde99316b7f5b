"""Personal data: four base kinds by pattern, and unseen identifiers by bootstrapped contexts.

Base spans seed the bootstrap, and so do credentials of one fixed format (``_SECRET``), the seeds of a fifth kind.  A lexical pattern is the words beside
a span with the punctuation between; an instance is the string of a span or of an identifier-like token (three digits or an at sign) that no
seed covers.  Spark scores the pattern-instance graph in rounds: a pattern's confidence for a kind is the score of the known instances it touches over
all instances it touches; an instance's score is the chance that at least one accepted pattern is right about it; accepted instances seed the next
round, until neither instances nor scores change (an instance keeps every kind it has, so scores only rise and settle).  Only small rows (hashes) are shuffled, the graph is
pre-aggregated to distinct edges, a pattern or an instance with many edges is joined in several tasks, and texts never move.

Defined cases: a null or empty text has no spans; rows of one id are searched one by one; extra columns are not read; an instance that two kinds claim goes
to the one of the higher score, of equal ones to the first kind as listed; words beside a span are looked for within 80 characters before and 40 after.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialise, table

# The four kinds and their order.
KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans, in order.
ALL_KINDS = (*KINDS, "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NOT_DIGIT = re.compile("[^0-9]+")
_SECRET = re.compile(r'[=:] ?"([0-9a-f]{32,64})"')
_EDGES = "\"'()[]{}<>,;:.!?|=*#%&$"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted; every scan is linear in the text."""
    spans, floor, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > floor and text[low - 1] in _LOCAL:
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            spans.append((low, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in _DOTTED.finditer(text):
        parts, place = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p) < 1000 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in four)):
                spans.append((place, 1, end))
            place = end + 1
    for m in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def seed_secrets(text: str) -> list[tuple[int, int, int]]:
    """Spans of the seeds of the kind secret: 32 to 64 lower-case hexadecimal digits in quotes, after an equals sign or a colon."""
    return [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _word(w: str) -> str:
    return re.sub("[0-9]+", "0", w.strip(_EDGES).lower()) or w[:8]


def contexts(text: str, start: int, end: int) -> list[int]:
    """Pattern ids: the word before with what stands between, the two words before, and the words on either side (as far as 80 and 40 characters)."""
    head = text[max(0, start - 80) : start]
    words = [m for m in re.finditer(r"\w[^\s=:]*", head)][-2:]
    if not words:
        return []
    between = re.sub(r"\s+", " ", head[words[-1].end() :])[:8]
    left = [_word(m[0]) for m in words]
    right = [_word(w) for w in text[end : end + 40].split()[:1]]
    out = [_hash(f"1 {left[-1]}{between}")]
    if len(left) == 2:
        out.append(_hash(f"2 {left[0]} {left[1]}{between}"))
    if right:
        out.append(_hash(f"b {left[-1]}{between}_ {right[0]}"))
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Every base span, and every identifier-like token outside them, with its instance and patterns."""
    out = [{"kind": k, "start": a, "end": b, "instance": _hash(text[a:b]), "patterns": contexts(text, a, b)} for a, k, b in spans]
    taken, i = sorted((a, b) for a, _, b in spans), 0
    reach = 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        lead = len(token) - len(token.lstrip(_EDGES))
        token = token.strip(_EDGES)
        a = m.start() + lead
        b = a + len(token)
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > a or not token or ("@" not in token and len(_NOT_DIGIT.sub("", token)) < 3):
            continue
        out.append({"kind": -1, "start": a, "end": b, "instance": _hash(token), "patterns": contexts(text, a, b)})
    return out


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("mentions", pa.list_(_MENTION))])


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and spans of the base kinds, and the mentions for the bootstrap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                counts, base, found = ([], [], [], []), [], []
                for value in part.column(2):
                    text = value.as_py() or ""
                    spans = base_spans(text) if _ANY.search(text) else []
                    for k, c in enumerate(counts):
                        c.append(sum(s[1] == k for s in spans))
                    base.append(written(spans))
                    found.append(mentions(text, sorted(spans + seed_secrets(text))) if spans or _ANY.search(text) else [])
                columns = [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(found, _SCHEMA.field("mentions").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return given.mapInArrow(run, f"doc_id long, row_key long, {kinds}, base string, mentions array<struct<kind int, start long, end long, instance long, patterns array<long>>>")


def bootstrap(edges: DataFrame, least_support: float = 5.0, least_confidence: float = 0.8) -> DataFrame:
    """(instance, kind, score) of the discovered instances.  ``edges``: distinct (pattern, instance, kind), kind -1 where unknown."""
    sizes = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"), F.count("*").alias("edges"))
    sizes = materialise(sizes, "pii-patterns")
    pairs = materialise(edges.select("pattern", "instance").distinct(), "pii-pairs")
    held = pairs.groupBy("instance").agg(F.count("*").alias("edges"))
    seeds = edges.where("kind >= 0").groupBy("instance").agg(F.transform(F.collect_set("kind"), lambda k: F.struct(k.alias("kind"), F.lit(1.0).alias("score"))).alias("known"))  # at most one of each kind
    seeds = materialise(seeds.join(held, "instance"), "pii-seeds")
    unknown = materialise(edges.where("kind < 0").select("pattern", "instance"), "pii-unknown")
    known, found, before = seeds, None, None
    while True:
        touched = join_unique(pairs, known, "instance", "edges", ["pattern"], "inner").select("pattern", F.explode("known").alias("k")).select("pattern", "k.*")
        positive = touched.groupBy("pattern", "kind").agg(F.sum("score").alias("positive")).where(F.col("positive") >= least_support)
        accepted = positive.join(sizes, "pattern").withColumn("confidence", F.col("positive") / F.col("n")).where(F.col("confidence") >= least_confidence)
        accepted = accepted.groupBy("pattern").agg(F.collect_list(F.struct("kind", "confidence")).alias("kinds"), F.max("edges").alias("edges"))  # at most one of each kind
        votes = join_unique(unknown, accepted, "pattern", "edges", ["instance"], "inner").select("instance", F.explode("kinds").alias("k")).select("instance", "k.*")
        chance = F.log(1 - F.least("confidence", F.lit(0.99)))
        scores = votes.groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(chance)), 6).alias("score")).where(F.col("score") >= least_confidence)
        found = materialise(scores.join(seeds.select("instance"), "instance", "left_anti"), "pii-found")
        after = tuple(found.agg(F.count("*"), F.bit_xor(F.xxhash64("instance", "kind", "score"))).first())
        if after == before or not after[0]:
            return found.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b")).select("instance", "b.kind", "b.score")
        before = after
        again = found.groupBy("instance").agg(F.collect_list(F.struct("kind", "score")).alias("known"))  # all its kinds, so that no support is ever withdrawn
        known = seeds.unionByName(again.join(held, "instance").select("instance", "known", "edges"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Per row: counts of the base kinds, ``base`` and ``spans`` (base and added ones) as kind:start:end, and the number of ``spans``, ``n_spans``."""
    base = materialise(find_base(docs, id_col, text_col), "pii")
    each = base.select("doc_id", "row_key", F.explode("mentions").alias("m")).select("doc_id", "row_key", "m.*")
    edges = materialise(each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "pii-edges")
    found = bootstrap(edges, **limits)
    order = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(i), F.lit(k))])
    open_yet = each.where("kind < 0").drop("kind", "patterns").distinct()
    times = open_yet.groupBy("instance").agg(F.count("*").alias("times"))
    new = join_unique(open_yet, found.select("instance", "kind").join(times, "instance"), "instance", "times", ["doc_id", "start"], "inner")
    new = new.select("doc_id", "row_key", "start", "kind", "end").unionByName(each.where(F.col("kind") >= len(KINDS)).select("doc_id", "row_key", "start", "kind", "end").distinct())
    new = new.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    out = base.drop("mentions").join(new, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__row")), "left").drop("__id", "__row")
    known = F.filter(F.split("base", ","), lambda s: s != "")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    known = F.transform(known, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), rank[F.split(s, ":")[0]].cast("int").alias("kind"), F.split(s, ":")[2].cast("long").alias("end")))
    every = F.array_sort(F.concat(known, F.col("new")))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", order[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = out.withColumn("spans", F.when(F.col("new").isNull(), F.col("base")).otherwise(text))
    n = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return out.withColumn("n_spans", n).drop("new", "row_key")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")
