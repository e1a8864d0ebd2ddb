"""The corpus pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline
from quarry.llm import omh


def test_stages_follow_each_other(spark, data):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        seen[name] = docs.collect()
    good = {r["doc_id"]: r["text"] for r in seen["quality"]}
    exact = {r["doc_id"]: r["text"] for r in seen["exact_dedup"]}
    groups = {}
    for i, t in good.items():
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    assert exact.keys() == {min(g)[1] for g in groups.values()}
    near = {r["doc_id"] for r in seen["near_dedup"]}
    lost = {i: omh.words_of(t) for i, t in exact.items() if i not in near}
    words = {i: omh.words_of(t) for i, t in exact.items()}
    for i, own in lost.items():  # whatever went has a near copy in its class
        assert any(j != i and omh.similar(own, words[j], 0.8) for j in words)
    for i in near:  # and no two documents that stay are near copies with a good part of common k-mers
        assert not any(j > i and omh.similar(words[i], words[j], 0.9) for j in near)
    repeats = Counter(r["doc_id"] for r in seen["mix"])
    assert set(repeats) <= near and max(repeats.values()) <= 3
    assert all(r["n_chars"] == len(r["text"]) for r in seen["mix"] if len(r["text"]) != len(exact[r["doc_id"]]))


def test_run_packs_what_the_mix_takes(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    windows = Counter()
    for r in rows:
        windows[r["sequence_id"]] += r["length"]
    assert rows and max(windows.values()) <= 2048


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, score string, predicted string, size string, taken string, target string, source_size string, cut string, __row long"


def odd_rows():
    words = " ".join(f"Plain sentence number {k} stands here." for k in range(60))
    own = (7, "mine", "p", "s", "t", "g", "z", "c", 5)
    return [
        (1, words, "en", "a", len(words), *own),
        (1, words, "en", "a", len(words), *own),  # a repeated row
        (2, None, None, None, None, None, *own[1:]),
        (3, "", "en", "b", 0, *own),
        (None, "No id but words. " * 30, "en", "b", 510, *own),
        (4, words.replace(" 7 ", " seven "), "en", None, len(words), *own),
        (5, "long text. " * 30_000, "en", "b", 330_000, *own),
    ]


def stages(spark, docs, data):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        yield name, stage(spark, docs, data)


def test_every_stage_takes_odd_rows_and_clashing_names(spark, data):
    docs = spark.createDataFrame(odd_rows(), ODD)
    every = Counter(map(tuple, docs.collect()))
    kept = {name: Counter(map(tuple, df.collect())) for name, df in stages(spark, docs, data)}
    for name, df in stages(spark, docs, data):
        assert df.columns == docs.columns, name
    assert kept["quality"] <= every
    # the second of two equal rows goes, and null and empty texts are equal
    assert sum(kept["exact_dedup"].values()) == 5 and kept["exact_dedup"] <= every
    assert {r[0] for r in kept["near_dedup"]} == {1, 2, None, 5} and sum(kept["near_dedup"].values()) == 4
    mixed = kept["mix"]
    assert {r[0] for r in mixed} <= {1, None, 4, 5} and all(r[5:] == (7, "mine", "p", "s", "t", "g", "z", "c", 5) for r in mixed)
    packed = corpus_pipeline.pack(spark, docs, data).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0 and r["doc_id"] in (2, 3)) == 2


def test_every_stage_takes_an_empty_table(spark, data):
    docs = spark.createDataFrame([], ODD)
    for name, df in stages(spark, docs, data):
        assert df.columns == docs.columns and df.count() == 0, name
    assert corpus_pipeline.pack(spark, docs, data).count() == 0
