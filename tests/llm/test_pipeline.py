"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = raw, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), SF)
        if name != "packing":
            assert docs.columns == raw.columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or name == "language"
    before = {r["doc_id"]: r["text"] for r in raw.collect()}
    assert set(kept["language"]) <= set(before) and all(kept["language"][i] == before[i] for i in kept["language"])
    assert len(kept["language"]) >= 0.97 * len(before) and set(kept["line_dedup"]) <= set(kept["language"])
    # what the line stage drops has lost every line: each of them stands in an earlier document
    said = {}
    for i in sorted(kept["language"]):
        lines = set(kept["language"][i].split("\n"))
        assert i in kept["line_dedup"] or all(min(said.get(x, [i])) < i for x in lines)
        for x in lines:
            said.setdefault(x, []).append(i)
    assert all(kept["line_dedup"][i] or not kept["language"][i] for i in kept["line_dedup"])
    # near duplicates: by five-word shingles, all pairs
    sets = {}
    for i, t in kept["line_dedup"].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            shared = len(sets[i] & sets[j])
            if j < i and shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert set(kept["near_dedup"]) == {i for i in group if group[i] == i}
    # repeated windows: none is left but the first
    seen = {}
    for i, t in sorted(kept["near_dedup"].items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if x in seen:
                gone |= set(range(p, p + 20))
            seen.setdefault(x, i)
        assert re.findall(r"[^\x20\x09-\x0D]+", kept["substring_dedup"][i]) == [x for k, x in enumerate(w) if k not in gone]
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(kept["substring_dedup"])
    whole = corpus_pipeline.run(spark, SF)
    total = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert total(whole.collect()) == total(packed)
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_odd_rows_and_carried_columns(spark, tmp_path):
    prose = "the cat sat on the mat and then it ran away from the big old dog that lived next door to us all year long.\nIt was a fine day of the year.\nAnd so on it goes."
    rows = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (None, prose + " Unique end."), (None, None), (7, "12345 !!"), (8, "one"), (9, "word " * 3000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, Lang_Pred string, n_lines_before int, _made string, gone int, id long"
    df = spark.createDataFrame([(i, t, None if i == 2 else "en", None, None, 0.25, "kept", 7, "m", 8, 9) for i, t in rows], schema)
    for name, start in (("odd", df), ("empty", df.where("false"))):
        docs = start
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.parquet(f"{tmp_path}/{name}{k}")
            docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}{k}"), SF)
            if stage_name != "packing":
                assert docs.columns == df.columns
                assert all((r["score"], r["Lang_Pred"], r["n_lines_before"], r["_made"], r["gone"], r["id"]) == (0.25, "kept", 7, "m", 8, 9) for r in docs.collect()), stage_name
        assert (docs.count() > 0) == (name == "odd")
