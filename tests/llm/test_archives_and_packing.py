"""WARC archives and packed sequences: round trips, repeated rows, termination, the library's ids."""

import base64
import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from aeroquilt.llm import packing, warc, wordpieces


def archived(spark, rows, path, **options):
    resolved = warc.resolve_revisits(spark.createDataFrame(rows, "page_id long, url string, html string, html_2 string"), **options)
    token = warc.write_archives(resolved, path, "2020-02-02T00:00:00Z")
    assert rows == [] or warc.archive_token(spark, path) == token
    return warc.resolve(warc.read_archives(spark, path)).collect()


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a b", "same", None), (5, None, "same", ""), (3, "http://c", None, None), (4, "http://d", "", None), (2, "u", "a\r\n\r\nWARC/1.1\r\nArchive-Token: b é\r\n", None)]
    got = {r.page_id: r for r in archived(spark, rows, f"file://{tmp_path}/w")}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, _, t, _ in rows:
        assert got[i].payload_digest == digest(t) and got[i].payload_bytes == len((t or "").encode())
    assert (got[1].record_type, got[1].refers_to, got[5].record_type) == ("revisit", 5, "response")
    assert (got[3].record_type, got[3].refers_to) == ("revisit", 4)
    assert bytes(got[2].payload).decode() == rows[4][2] and got[2].intact


def test_warc_repeated_rows_keep_their_number(spark, tmp_path):
    rows = [(1, "u", "same", None), (5, "u", "same", None), (5, "u", "same", None), (5, "v", "same", None), (None, None, "same", None), (7, "w", "x", None), (7, "w", "x", None), (8, "w", "x", None)]
    got = archived(spark, rows, f"file://{tmp_path}/w")
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    same = [r for r in got if r.payload_bytes == 4]
    assert [(r.page_id, r.target_uri) for r in same if r.record_type == "response"] == [(5, "v")] and all(r.refers_to == 5 for r in same if r.record_type == "revisit")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 1) == [(7, "revisit", 8), (7, "revisit", 8), (8, "response", None)]
    assert archived(spark, [], f"file://{tmp_path}/none") == []


def test_warc_is_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "u", "".join(rng.choice(list("ab\r\nW"), int(rng.integers(0, 400)))) + "\r\n\r\nWARC/1.1\r\n" * (i % 3), None) for i in range(120)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.page_id: bytes(r.payload).decode() for r in archived(spark, rows, f"file://{tmp_path}/w") if r.record_type == "response" and r.intact}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got.values()) == {r[2] for r in rows} and all(got[i] == rows[i][2] for i in got)


def test_warc_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert sorted((r.page, r.nth, r.record_type) for r in warc.resolve_revisits(df, min_bytes=3).collect()) == [(1, 0, "response"), (2, 0, "response"), (2, 1, "response")]


def payload_shuffles(df):
    """Exchanges of payloads in the plan that Spark starts with."""

    def found(plan):
        below = [x for i in range(plan.children().length()) for x in found(plan.children().apply(i))]
        return [plan.toString()] * (plan.nodeName() == "Exchange" and "payload#" in plan.output().mkString(" ")) + below

    before = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return found(df._jdf.queryExecution().executedPlan().initialPlan())
    finally:
        df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_warc_payloads_are_shuffled_once_and_by_slices(spark, tmp_path):
    """The window over equal heads takes the payloads where the join has brought them, and a slice shuffles its own payloads only."""
    rows = [(i if i % 5 else None, f"u{i % 3}", f"text {i % 7}") for i in range(60)] + [(7, "u1", "text 0")] * 3
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    resolved = warc.resolve_revisits(spark.read.parquet(f"{tmp_path}/pages"))
    assert len(payload_shuffles(resolved)) == 1
    (shuffle,) = payload_shuffles(warc.sliced(resolved, 1, 4))
    assert "pmod(xxhash64(page_id" in shuffle.split("FileScan")[0]
    key = lambda r: (r.page, r.url, r.nth, r.payload_digest, r.record_type, r.payload)
    parts = [sorted(map(key, warc.sliced(resolved, k, 4).collect()), key=str) for k in range(4)]
    assert sorted(sum(parts, []), key=str) == sorted(map(key, resolved.collect()), key=str) and len(sum(parts, [])) == len(rows) and max(map(len, parts)) < len(rows)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def test_packing_over_several_levels(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 100, 3000))]
    got = packing.pack(spark.createDataFrame(rows, _PIECES), 100, 8, shard_fills=4).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id").length.sum().max() <= 100
    assert got.sequence_id.nunique() < 1.12 * got.length.sum() / 100


@pytest.mark.parametrize("length", [1, 7, 13, (8, 16)])
def test_packing_of_short_documents_ends(spark, length):
    n, rng = 30_000, np.random.default_rng(1)
    sizes = rng.integers(*length, n) if isinstance(length, tuple) else np.full(n, length)
    rows = pd.DataFrame({"doc_id": np.arange(n), "piece": np.zeros(n, np.int32), "start": 0, "length": sizes, "ids_crc32": np.arange(n)})
    df = spark.createDataFrame(rows, _PIECES)
    full = 256 if isinstance(length, tuple) else 256 - 256 % length
    for fills in (2, 16):
        got = packing.pack(df, 256, 16, fills).toPandas()
        assert len(got) == n and got.sequence_id.notna().all()
        in_each = got.groupby("sequence_id").length.sum()
        assert in_each.max() <= 256 and len(in_each) <= 1.02 * sizes.sum() / full + 1


def test_bins_against_a_plain_list():
    """Every piece goes to a bin that leaves the least room, and the fullest of the open bins closes first."""
    rng = np.random.default_rng(2)
    for most in (1, 3, 8):
        best, used, open_bins = packing.BestFit(64, most), {}, set()
        for x in rng.integers(1, 65, 600).tolist():
            fits = {b: 64 - used[b] for b in open_bins if 64 - used[b] >= x}
            b, offset = best.place(x)
            if fits:
                assert fits[b] == min(fits.values()) and offset == used[b]
            else:
                assert b not in used and offset == 0
                if len(open_bins) == most:
                    gone = open_bins - best.unfinished() - {b}
                    assert len(gone) == 1 and used[gone.copy().pop()] == max(used[o] for o in open_bins)
                    open_bins -= gone
            used[b] = offset + x
            open_bins = open_bins | {b} if used[b] < 64 else open_bins - {b}
            assert open_bins == best.unfinished() and len(open_bins) <= most


def test_encoder_equals_the_library():
    enc = wordpieces.Encoder(public_tokenizers.path("word_bpe_49k.json"), bits=8)  # so small a table is emptied and enlarged
    assert enc.merges is not None
    rng = np.random.default_rng(3)
    letters = list("abcdefgzABCZ'’.,;:!?-_ \t\n0129éÉßñçüÜœ中文字カタかЖжωΩςσΣİıǅ" + "́̀½²٣“”…—\x00\x1c \xa0𝒜😀<|>&$Ⓐ가" + "가")
    texts = ["", "A B", "ÀB́ J̌ ΣΑΣ, foo\x1cbar a\xa0b <|endoftext|>x", "don't it's,'s x's!? 12ab3", " a　b\x85c", "''s 'twas '", "x " * 9000]
    texts += ["".join(rng.choice(letters, int(rng.integers(0, 50)))) for _ in range(3000)]
    for some in (texts[:1], texts[:40], texts[40:], texts):
        raw = [x.encode() for x in some]
        ids, at = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for x, i, j in zip(some, at[:-1], at[1:], strict=True):
            assert ids[i:j].tolist() == enc.tokenizer.encode(x, add_special_tokens=False).ids, x


def test_encoder_and_bytes_that_are_no_text():
    enc = wordpieces.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    raw = [b"a\xff b", b"ok", b"\xe4\xb8"]
    ids, at = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for x, i, j in zip(raw, at[:-1], at[1:], strict=True):
        assert ids[i:j].tolist() == enc.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids
