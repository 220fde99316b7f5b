"""The pipeline on a small corpus: every decision takes effect, clean documents stay, the columns of the table come through."""

import numpy as np

from tests.llm.test_llm import prose


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    item = prose(900, 30)
    line = "This very line stands in two documents."
    clean = {i: ". ".join(prose(1000 * i + k, 9) for k in range(14)) + "." for i in range(1, 41)}
    docs = dict(clean)
    docs[41] = clean[1]
    docs[42] = clean[2].replace(clean[2].split()[30], "changed", 1)
    docs[43] = " ".join(w + "%%%" for w in prose(5).split())
    docs[44] = clean[3][:200] + " " + item + " " + prose(77, 80) + "."
    docs[45] = prose(78, 90) + ".\n" + line
    docs[46] = prose(79, 90) + ".\n" + line
    rows = [(i, t, "en", 9, i % 7, "x") for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, kept int, n_lines string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in df.collect()})
    assert ids[0] == set(docs) - {43} and ids[1] == ids[0]
    kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/lines").collect()}
    assert line in kept[45].text and line not in kept[46].text and kept[46].kept == 46 % 7 and kept[46].n_lines == "x" and kept[46].n_chars == len(kept[46].text)
    assert 42 not in ids[2] and set(clean) <= ids[2]
    assert 44 in ids[2] and 44 not in ids[3] and set(clean) <= ids[3]
    packed = cp.STAGES[-1][1](spark, df, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == ids[3] and packed.groupby("sequence_id").length.sum().max() <= 4096 and np.all(packed.offset >= 0)


def test_repeated_ids_and_rows(spark, tmp_path):
    """Rows of one id are decided by their own texts; of equal rows one stays."""
    import corpus_pipeline as cp

    text = lambda k: ". ".join(prose(1000 * k + i, 9) for i in range(14)) + "."
    item = prose(901, 30)
    rows = [(1, text(1), "a"), (1, text(2), "b"), (2, text(3), "c"), (2, text(3), "d"), (3, text(3), "e"), (None, text(4), "f"), (None, text(4), "g"), (4, text(5) + " " + item, "h"), (4, text(6), "i"), (5, None, "j"), (6, "", "k")]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = [(r.doc_id, r.text) for r in cp.near_stage(spark, df, str(tmp_path)).collect()]
    assert sorted(near, key=str) == sorted([(1, text(1)), (1, text(2)), (2, text(3)), (None, text(4)), (4, rows[7][1]), (4, text(6)), (5, None)], key=str)
    assert sorted(r.source for r in cp.leak_stage(spark, df, str(tmp_path)).collect()) == list("abcdefgijk")
    for name, stage in cp.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
