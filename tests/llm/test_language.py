"""Language identification: automata and phrases against plain searches, held-out labels, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int, held_out int, id int, hash string, `a.b` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, "h", 4) for r in rows], SCHEMA)


def plain_phrases(text, pieces):
    """Greedy longest matches by substring search, block by block."""
    count = 0
    for at in range(0, len(text), language.BLOCK):
        block = text[at : at + language.BLOCK]
        i = 0
        while i < len(block):
            n = 0
            while i + n < len(block) and any(block[i : i + n + 1] in p for p in pieces):
                n += 1
            i += max(1, n)
            count += 1
    return count


def plain_identify(text, samples):
    if not text or not any(c.isalpha() for c in text) or not samples:
        return "und", 0.0
    plain = language.plain_bytes(text)
    bits = {k: plain_phrases(plain, v) * math.log2(max(2, sum(map(len, v)))) for k, v in samples.items()}
    best = min(sorted(bits), key=bits.get)
    return best, 1 / sum(2 ** max(-1000, bits[best] - b) for b in bits.values())


@pytest.mark.parametrize("seed", range(6))
def test_automaton_holds_exactly_the_substrings(seed):
    rng = random.Random(seed)
    sample = bytes(rng.choices(b"abc"[: 1 + seed % 3], k=rng.randint(1, 60)))
    nexts = language.suffix_automaton(sample)
    assert len(nexts) <= 2 * len(sample) + 1
    spelled = {b""}
    todo = [(0, b"")]
    while todo:
        state, word = todo.pop()
        for symbol, target in nexts[state].items():
            spelled.add(longer := word + bytes([symbol]))
            todo.append((target, longer))
    assert spelled == {sample[i:j] for i in range(len(sample) + 1) for j in range(i, len(sample) + 1)}


@pytest.mark.parametrize("seed", range(6))
def test_phrases_match_plain_search(seed):
    rng = random.Random(seed)
    samples = {k: [bytes(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(3)] for k, letters in {"x": b"ab ", "y": b"bcd ", "z": b"\xc3\xa4ab"}.items()}
    texts = [b"", *(bytes(rng.choices(b"abcde \xc3\xa4", k=rng.choice([1, 2, 30, 1023, 1024, 1025, 3000]))) for _ in range(12))]
    parser = language.CrossParser(samples)
    assert parser.languages == ["x", "y", "z"]
    assert parser.phrases(texts).tolist() == [[plain_phrases(t, samples[k]) for k in parser.languages] for t in texts]


def test_plain_bytes_and_letters():
    assert language.plain_bytes("  Ab,c\tÄß 12 d\x00") == "ab c äß d".encode()
    assert [language.has_letter(t) for t in (None, "", " 12_½²", "12 é", "字", "\U0001f600")] == [False, False, False, True, True, False]


def words(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


TONGUES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ge"], "cc": ["été", "oi", "eau", "ç"], "zh": ["的", "是", "不", "了"]}


def corpus(seed=1, each=60):
    rng = random.Random(seed)
    return [(k, words(rng, TONGUES[lang], rng.randint(3, 80)), lang) for k, lang in enumerate(sorted(TONGUES) * each)]


def test_operator_matches_plain_version_on_odd_rows(spark):
    rows = corpus()
    odd = [(None, "ka to mi"), (1, None), (1, None), (2, ""), (3, " \n\t"), (4, "123 !?"), (5, "x"), (6, "qqq www"), (7, "ka" * 40_000), (8, "\U0001f600"), (8, "Schein GEUNG")]
    rows += [(1_000 + k, t, "aa") for k, (_, t) in enumerate(odd)] + [(2_000, None, None), (2_001, "ka ka", None), (2_002, "ka", "dd")]
    rows += [(3_000 + k, "ein ungein schein", "bb") for k in range(120)]  # copies, a third of all
    docs = docs_of(spark, rows)
    samples = language.learn(docs, pieces=20, chars=40)
    assert set(samples) == {*TONGUES, "dd"} and all(len(v) <= 20 and all(len(p) <= 160 for p in v) for v in samples.values())
    assert samples["bb"].count(b"ein ungein schein") <= 1
    found = language.identify_language(docs_of(spark, [(i, t, "-") for i, t in odd]), samples)
    assert found.columns == ["doc_id", "lang_pred", "score"]
    got = sorted(((r[0], r[1], round(r[2], 9)) for r in found.collect()), key=str)
    assert got == sorted(((i, a, round(s, 9)) for i, t in odd for a, s in [plain_identify(t, samples)]), key=str)
    # the same samples from the same rows in another order and other partitions
    assert language.learn(docs.repartition(7).orderBy(F.rand(3)), pieces=20, chars=40) == samples


def test_nothing_learnt_and_no_rows(spark):
    docs = docs_of(spark, [(1, "some text", None), (2, None, "en"), (3, "12", "en")])
    samples = language.learn(docs)
    assert samples == {}
    assert sorted(map(tuple, language.identify_language(docs, samples).collect())) == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert language.identify_language(docs.limit(0), {"en": [b"a"]}).collect() == []
    assert language.learn(docs.limit(0)) == {}


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHARS", 1_000)
    rows = [(k, f"word{chr(97 + k % 50 // 25)}{k} tail", f"l{k % 50}") for k in range(500)]
    samples = language.learn(docs_of(spark, rows), pieces=20, chars=10)
    assert len(samples) == 50 and {len(v) for v in samples.values()} == {2}


def test_held_out_accuracy(spark, data):
    from quarry.llm import queries

    found = queries.op12_language(spark, data)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = found.collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
