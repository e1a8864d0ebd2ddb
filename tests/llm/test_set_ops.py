"""URL rules, exact and near copies, mixing, shards, search: operators that relate rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import exact, hamming, mixing, omh, queries, sharding, urls
from quarry.llm.text import word_count

DOC = "doc_id long, text string, source string, size string, shard int, kept int, `a.b` int"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "big", 7, 1, 0) for r in rows], DOC)


# ---- exact copies ------------------------------------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[hashlib.sha256("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()].append((k, i, len(t or "")))
    out = []
    for sha, own in groups.items():
        best = min(own, key=lambda x: (-x[2], x[1] is None, x[1] or 0, x[0]))
        out += [(i, best[1], len(own), k == best[0], sha) for k, i, _ in own]
    return sorted(out, key=str)


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        text = rng.choice([None, "", " ", "ab c", "a bc", "abc ", "abd", "x" * 300 + str(k % 3), "x" * 300 + str(k % 3) + " \n", f"own {k}"])
        rows.append((rng.choice([k, k, 7, None]), text))
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    found = [tuple(r) for r in exact.exact_groups(docs, every_hash=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    wanted = brute_exact(rows)
    # of rows that agree in id, text and length, any one may stay
    assert Counter(found) == Counter(wanted)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], len(r["text"] or "")) for r in kept.collect()) == Counter(best_rows(rows))


def best_rows(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join((t or "").split())].append((i, len(t or "")))
    return [min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0)) for own in groups.values()]


def test_exact_empty(spark):
    none = docs_of(spark, [(1, "a", "s")]).limit(0)
    assert exact.exact_groups(none).count() == 0 and exact.exact_dedup(none).count() == 0


# ---- near copies -------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def test_banded_alignment_is_exact_within_the_band():
    rng = random.Random(7)
    for _ in range(4000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        d = distance(a, b)
        for most in (0, 1, 3, 8, 20):
            assert omh.within_distance(a, b, most) == (d if d <= most else None)


def test_sketches_see_order_and_repeats():
    hasher = omh.hashes_of
    words = [f"w{k}" for k in range(200)]
    same = omh.sketch(hasher(words))
    assert np.array_equal(same, omh.sketch(hasher(list(words))))
    swapped = omh.sketch(hasher(words[100:] + words[:100]))
    near = omh.sketch(hasher(words[:100] + ["new"] + words[100:]))
    assert (same == near).sum() > (same == swapped).sum()
    assert len(set(omh.labelled_kmers(hasher(["x"] * 20)).tolist())) == 16
    assert len(omh.sketch(hasher([]))) == 0 and len(omh.sketch(hasher(["one"]))) == omh.BANDS


def test_scattered_edits_share_a_sketch():
    """Of pairs well above the threshold few may lack a common sketch."""
    rng, hasher = random.Random(1), omh.hashes_of
    met = Counter()
    for edits in (40, 30, 20, 10):
        for _ in range(300):
            a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            b = list(a)
            for k in rng.sample(range(200), edits):
                b[k] = f"new{rng.randrange(10**6)}"
            met[edits] += bool((omh.sketch(hasher(a)) == omh.sketch(hasher(b))).any())
    assert met[40] >= 0.88 * 300 and met[30] >= 0.97 * 300 and met[20] >= 0.99 * 300 and met[10] == 300


def family(rng, n, size, edits):
    base = [f"t{rng.randint(0, 5000)}" for _ in range(n)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["NEW"], [words[k], f"q{rng.randint(0, 9)}"]])
        out.append(" ".join(words))
    return out


def brute_classes(texts, threshold=0.8):
    words = [(t or "").lower().split() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if omh.similar(words[i], words[j], threshold) and (words[i] or (texts[i] or "") == (texts[j] or "")):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(texts))]


def near_corpus():
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        texts += family(rng, rng.randint(40, 200), rng.randint(1, 8), 4)
    passage = " ".join(f"shared{k}" for k in range(60))
    texts += [" ".join(f"u{rng.randint(0, 9**6)}" for _ in range(120)) + " " + passage for _ in range(40)]  # a common passage makes no copies
    texts += ["", None, "short", "short", "Short  ", "two words", "x " * 3000, "x " * 2999, "x " * 1000]
    rng.shuffle(texts)
    return texts


def test_near_classes_match_brute_force(spark):
    texts = near_corpus()
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in omh.near_duplicates(docs).collect()}
    wanted = brute_classes(texts)
    assert [found[k]["class_id"] for k in range(len(texts))] == wanted
    sizes = Counter(wanted)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in found.values())
    kept = omh.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted))


def test_no_link_is_lost_in_an_ambiguous_bucket(spark):
    """Different families share a bucket: all sketches are made of one common run of k-mers."""
    head = " ".join(f"h{k}" for k in range(30))
    texts = [f"{head} " + " ".join(f"{f}{k}" for k in range(14)) + f" end{i}" for f in "abcdef" for i in range(4)]
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])
    # eight words of 45 differ within a family and thirty between families at most, so only families are classes
    found = {r["doc_id"]: r["class_id"] for r in omh.near_duplicates(docs, bands=1, picks=1).collect()}
    same_key = defaultdict(list)
    hasher = omh.hashes_of
    for k, t in enumerate(texts):
        same_key[omh.sketch(hasher(omh.words_of(t)), 1, 1).tolist()[0]].append(k)
    for own in same_key.values():
        for a in own:
            for b in own:
                if omh.similar(omh.words_of(texts[a]), omh.words_of(texts[b]), 0.8):
                    assert found[a] == found[b]


def test_short_texts_that_differ_by_a_word_are_linked(spark):
    """Up to 2 k words no common k-mer is needed; a replaced word of four is too much."""
    base = [f"b{k}" for k in range(9)]
    texts = []
    for n in range(1, 10):
        words = [f"{n}{w}" for w in base[:n]]
        texts += [" ".join(words), " ".join([*words[: n // 2], "new", *words[n // 2 + 1 :]]), " ".join(words[1:]) or "none", " ".join([*words[: n // 2], "added", *words[n // 2 :]])]
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])
    found = {r["doc_id"]: r["class_id"] for r in omh.near_duplicates(docs).collect()}
    assert [found[k] for k in range(len(texts))] == brute_classes(texts)


def test_signatures_bound_distances_from_below():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(0, 60) for _ in range(rng.randint(0, 80))]
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 60)] * rng.randint(0, 1)
        x, y = (omh.signature(omh.hashes_of([str(w) for w in words])) for words in (a, b))
        differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert (differ + abs(len(a) - len(b))) / 2 <= omh.within_distance(a, b, 200)


def test_near_odd_rows(spark):
    docs = docs_of(spark, [(None, "a b c d e f g", None), (None, "a b c d e f g", None), (4, "a b c d e f g", "s"), (4, "other", "s"), (4, "other", "s")])
    rows = omh.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows) == Counter({(None, 4, 3): 2, (4, 4, 3): 1, (4, 4, 2): 2})
    assert Counter((r["doc_id"], r["text"]) for r in omh.near_dedup(docs).collect()) == Counter({(4, "a b c d e f g"): 1, (4, "other"): 1})
    assert omh.near_duplicates(docs.limit(0)).count() == 0 and omh.near_dedup(docs.limit(0)).count() == 0


# ---- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s] + 1e-9]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: float(cap * sizes[s]) for s in over}


def mix_rows(spark, rows):
    docs = docs_of(spark, rows)
    return docs, mixing.mix_sources(docs, word_count(F.col("text")))


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, "", "w " * rng.randint(1, 40)]), rng.choice(["a", "a", "a", "a", "b", "B", "é", "zz", "zz", None])) for k in range(500)] + [(3, "one two", "tiny"), (3, "one two", "tiny")]
    docs, mixed = mix_rows(spark, rows)
    found = mixed.collect()
    assert set(mixed.columns) == {*docs.columns, "source_size", "target", "taken"} and len(mixed.columns) == len(docs.columns) + 3
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(dict(sizes))
    taken = Counter()
    for r in found:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes) and len(found) == len(rows)
    again = mixing.mix_sources(docs.repartition(7), word_count(F.col("text"))).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in found)
    # in each source, at most one row differs from whole epochs
    for s in sizes:
        assert sum(r["size"] > 0 and r["taken"] % r["size"] > 0 for r in found if r["source"] == s) <= 1
    written = mixing.repeat_taken(mixed).collect()
    words = Counter()
    for r in written:
        words[r["source"]] += len(r["text"].split())
    assert all(words[s] == taken[s] for s in sizes)


def test_mix_empty_and_wordless(spark):
    _, none = mix_rows(spark, [(1, "a", "s")])
    assert none.limit(0).count() == 0
    docs = docs_of(spark, [(1, "a", "s")]).limit(0)
    assert mixing.mix_sources(docs, word_count(F.col("text"))).count() == 0
    _, blank = mix_rows(spark, [(1, None, None), (2, " \n", "s")])
    assert [(r["size"], r["taken"]) for r in blank.collect()] == [(0, 0)] * 2


# ---- shards ------------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_near_equal(spark, data):
    rows = sorted(queries.op7_shards(spark, data).collect(), key=lambda r: r["doc_id"])
    total = sum(r["size"] for r in rows)
    before, counts = 0, Counter()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["shard"] == min(23, (2 * before + r["size"]) * 24 // (2 * total))
        assert r["slot"] == counts[r["shard"]]
        counts[r["shard"]] += 1
        before += r["size"]


def test_shards_of_odd_rows(spark):
    docs = docs_of(spark, [(None, None, "s"), (None, "é", "s"), (1, "x" * 1000, "s"), *[(2, "same", "s")] * 50])
    sized = docs.withColumn("size", sharding.byte_size(F.col("text")))
    rows = sharding.shard_by_bytes(sized, shards=5).collect()
    assert len(rows) == 53 and all(0 <= r["shard"] < 5 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert next(r["size"] for r in rows if r["text"] == "é") == 10
    assert sharding.shard_by_bytes(sized.limit(0)).count() == 0


# ---- URLs --------------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, rule string, verdict int"


def judge(spark, pages, **more):
    rows = spark.createDataFrame([(k, u, h, "mine", 3) for k, (u, h) in enumerate(pages)], PAGE)
    return {r["page_id"]: r for r in urls.judge_urls(rows, queries.URL_RULES, **more).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "https://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
        "ftp://net": ("net", "", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://É.org/fr/?a://b": ("É.org", "/fr/", "org/fr/", "allow"),
        "a/b://c.net?d/e": ("c.net", "", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://y.net\n/z": ("y.net\n", "/z", None, "allow"),
    }
    rows = judge(spark, [(u, None) for u in cases])
    for k, wanted in enumerate(cases.values()):
        assert tuple(rows[k][c] for c in ("host", "path", "rule", "verdict")) == wanted
    assert judge(spark, []) == {}


def test_aliases_take_over_blocks_unless_one_is_allowed(spark):
    canonical = '<LINK data-x="1" rel="canonical" href="{}">'.format
    refresh = "<meta http-equiv=refresh content=\"0; URL='{}'\">".format
    pages = [
        ("http://a.com/1", canonical("http://spam.net/x")),  # 0 blocked through its canonical link, which was not crawled
        ("http://b.com/2", refresh("/3")),  # 1 follows a chain of redirects
        ("http://b.com/3", refresh("http://a.com/1#frag")),  # 2
        ("http://ok.example.net/en/a", canonical("http://spam.net/x2")),  # 3 its own rule allows it
        ("http://c.com/", canonical("http://ok.example.net/en/a")),  # 4 its component holds an explicit allow
        ("http://spam.net/x2", None),  # 5 its own rule blocks it, whatever its aliases
        ("http://lone.com/", "<p>canonical refresh</p>"),  # 6
        ("http://d.com/q?r=1&s=2", None),  # 7 by the table of redirects
        ("HTTP://D.com/q?r=1&s=2#top", None),  # 8 the same resource
        ("http://a.com/1", None),  # 9 repeated URL
    ]
    redirects = spark.createDataFrame([("http://d.com/q?r=1&s=2", "http://x.net/"), (None, "http://x.net/"), ("junk", "http://x.net/")], "src string, dst string")
    rows = judge(spark, pages, redirects=redirects)
    assert [rows[k]["verdict"] for k in range(10)] == ["block", "block", "block", "allow", "allow", "block", "allow", "block", "block", "block"]
    assert [rows[k]["rule"] for k in (0, 3, 5)] == [None, "example.net/en/", "net/"]


# ---- search ------------------------------------------------------------------------------------------------------------


def brute_top(codes, asked, k):
    out = {}
    for i in asked:
        near = sorted((bin((codes[i] ^ c) & (1 << 64) - 1).count("1"), j) for j, c in codes.items() if j != i)
        out[i] = [(d, j) for d, j in near[:k]]
    return out


@pytest.mark.parametrize("parts,radius,masks", [(None, None, None), (3, 6, None), (8, 0, None), (8, 0, 50), (4, 0, 0)])
def test_top_k_is_exact(spark, monkeypatch, parts, radius, masks):
    if masks is not None:  # hard queries meet every code, from the first or a later round on, in several blocks
        monkeypatch.setattr(hamming, "MOST_MASKS", masks)
        monkeypatch.setattr(hamming, "SCAN_QUERIES", 7)
    rng = random.Random(10)
    centres = [rng.getrandbits(64) for _ in range(5)]
    codes = {k: rng.choice(centres) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) if k % 3 == 0 else 0) for k in range(300)}
    codes |= {k: centres[0] for k in range(300, 380)}  # many equal codes
    signed = [(k, c - (1 << 64) if c >> 63 else c) for k, c in codes.items()]
    table = spark.createDataFrame([*signed, signed[0]], "id long, code long")
    found = defaultdict(list)
    for r in sorted(hamming.hamming_top_k(table, table.where("id % 20 = 0"), 7, parts, radius).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    assert found == brute_top(codes, [k for k in codes if k % 20 == 0], 7)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, -1.0, None, float("nan")] + [0.0] * 60), (2, None), (None, [1.0] * 64), (3, []), (4, [0.0] * 63 + [2.0]), (5, [1.0] + [-1.0] * 63 + [1.0])]
    codes = {r["id"]: r["code"] for r in hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert codes[1] & 1 and codes[3] == 0 and codes[4] == -(1 << 63) and codes[5] == 0 and set(codes) == {1, 3, 4, 5}
    table = spark.createDataFrame([(20, 5)], "id long, code long")
    assert hamming.hamming_top_k(table, table).count() == 0
    assert hamming.hamming_top_k(table.limit(0), table.limit(0)).count() == 0
    assert hamming.hamming_top_k(table, table.limit(0)).count() == 0


def test_top_k_of_text_ids_and_clashing_names(spark):
    """Ids keep their type; further columns, whatever their names, are left behind; null ids and codes are passed over."""
    rows = [("a", 1, 0, "x", 1), ("b", 3, 0, "x", 2), ("c", -1, 1, "y", 3), ("b", 7, 0, "x", 4), (None, 1, 0, "x", 5), ("d", None, 0, "x", 6)]
    table = spark.createDataFrame(rows, "id string, code long, distance int, query string, part int")
    found = sorted(map(tuple, hamming.hamming_top_k(table, table, 5).collect()))
    assert found == [("a", 1, "b", 1), ("a", 2, "c", 63), ("b", 1, "a", 1), ("b", 2, "c", 62), ("c", 1, "b", 62), ("c", 2, "a", 63)]
    vectors = spark.createDataFrame([("v", [1.0] * 64, 9), ("w", [-1.0] * 64, 9)], "vec_id string, embedding array<float>, code int")
    assert {tuple(r) for r in hamming.sign_codes(vectors).collect()} == {("v", -1), ("w", 0)}


def test_url_sql_agrees_on_aliases(spark):
    import duckdb

    from quarry.llm.oracles import ORACLES

    rng = random.Random(12)
    hosts = ["a.com", "x.net", "ok.example.net", "shop.example.com", "b.org", "c.io"]
    every = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in ("", "/", "/en/q", "/de/1?x=1#f", "/fr/")]
    tags = ['<link rel="canonical" href="{}">', "<meta HTTP-EQUIV='refresh' content='5;url={}'>", "<p>{}</p>"]
    pages = [(k, rng.choice([*every, None, "no scheme"]), rng.choice([None, *(rng.choice(tags).format(rng.choice([*every, "/en/", "p.html", "//x.net/", "#top"])) for _ in range(3))])) for k in range(60)]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    wanted = con.execute(ORACLES["op2_urls"]).fetchall()
    found = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES)
    assert sorted(map(tuple, found.select("page_id", "host", "path", "rule", "verdict").collect())) == sorted(wanted)


@pytest.mark.parametrize("name", ["op2_urls", "op4_mix", "op8_exact", "op9_top_k"])
def test_queries_give_the_rows_of_their_sql(spark, data, duck, name):
    from quarry.llm.oracles import ORACLES

    df = queries.QUERIES[name](spark, data)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(result.fetchall())


def test_all_alias_tags_and_relative_targets(spark):
    html = '<link rel="canonical"><LINK href="../c/./d" rel="canonical"><link rel=canonical href=/e><meta http-equiv="refresh" content="0"><meta http-equiv=refresh content="0; url=?a=1">'
    pages = spark.createDataFrame([("http://H.x/a/b/p?q#f", html), ("http://h.x/a/../z/.", '<link rel=canonical href="../../..">'), ("http://h.x/n", None)], "url string, html string")
    base = "http://h.x/a/b/p?q"
    wanted = {(base, "http://h.x/a/c/d"), (base, "http://h.x/e"), (base, "http://h.x/a/b/p?a=1"), ("http://h.x/z/", "http://h.x/")}
    assert {tuple(r) for r in urls.alias_edges(pages).collect()} == wanted
    blocked = spark.createDataFrame([("http://h.x/blocked/x", '<link rel=canonical href="y"><link rel=canonical href="../free/w">'), ("http://h.x/free/w", "")], "url string, html string")
    rows = {r["url"]: r["verdict"] for r in urls.judge_urls(blocked, [urls.Rule("h.x", "/blocked/", "block")]).collect()}
    assert rows == {"http://h.x/blocked/x": "block", "http://h.x/free/w": "block"}


@pytest.mark.parametrize(
    "html,alias",
    [
        ('<link rel="canonical" href="/a"><link rel="canonical" href="http://bad.x/z">', "http://bad.x/z"),
        ('<link rel="canonical" href="?q=1">', "http://h.x/f/p?q=1"),
        ('<link rel="canonical" href="../z">', "http://h.x/z"),
        ('<link rel="alternate Canonical" href="http://bad.x/z">', "http://bad.x/z"),
        ('<link data-href="http://ok.x/" rel=canonical href="http://bad.x/z">', "http://bad.x/z"),
        ('<link title="a > b rel=stylesheet" href=\'http://bad.x/z\' rel=canonical>', "http://bad.x/z"),
        ('<meta content="0; URL=http://bad.x/z" http-equiv=Refresh>', "http://bad.x/z"),
        ('<!-- <link rel="canonical" href="http://bad.x/z"> --><p>canonical</p>', None),
        ('<link rel="not-canonical" href="http://bad.x/z">', None),
        ('<!-- <link rel="canonical" href="http://bad.x/z">', None),
    ],
)
def test_aliases_of_a_page(spark, html, alias):
    pages = spark.createDataFrame([("http://h.x/f/p", html)], "url string, html string")
    found = {r["dst"] for r in urls.alias_edges(pages).collect()}
    assert alias in found if alias else not found


def test_many_rules_are_joined(spark):
    rng = random.Random(2)
    rules = {(f"h{rng.randint(0, 300)}.{rng.choice(['com', 'a.org', 'net'])}", "/" + "x" * rng.randint(0, 3), rng.choice(["allow", "block"])) for _ in range(30_000)}
    rules |= {("com", f"/p{k}/", "block") for k in range(3000)}
    seen = [f"http://{rng.choice(['', 'w.', 'v.w.'])}h{rng.randint(0, 300)}.{rng.choice(['com', 'org', 'a.org', 'net'])}/{'x' * rng.randint(0, 4)}" for _ in range(300)]
    seen += [f"http://any.com/p{k}/q" for k in range(0, 4000, 400)] + ["http://" + "a." * 5000 + "com/p7/"]
    pages = spark.createDataFrame([(u, None) for u in seen], "url string, html string")
    found = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, [urls.Rule(*r) for r in rules]).collect()}
    for url in seen:
        host, path = url[7:].split("/", 1)
        fits = [(-len(h + p), h + p, a != "block", a) for h, p, a in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        best = min(fits, default=None)
        assert found[url] == ((best[1], best[3]) if best else (None, "allow")), url


# ---- names -------------------------------------------------------------------------------------------------------------

INNER = """__norm __len __head __shared __full __best __row __text __chars __n __fp __lost __key __part __before __tie __salt __index __epochs __source __sum __rows __block __of
__host __path __rule __action __node __blocked __first __middle __shard kept0 a.b"""


@pytest.mark.parametrize("operator", ["exact", "near", "mix", "urls", "shards"])
def test_columns_named_like_inner_ones_come_out_as_they_came_in(spark, operator):
    inner = INNER.split()
    words = " ".join(f"w{j}" for j in range(30))
    rows = [(k, f"{words} own {k % 4}" if k % 2 else words, "net" if k % 3 else None, *(f"{n} {k}" for n in inner)) for k in range(12)]
    docs = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "source", *inner))]))
    if operator == "exact":
        found = exact.exact_dedup(docs)
    elif operator == "near":
        found = omh.near_dedup(docs)
    elif operator == "mix":
        found = mixing.mix_sources(docs, word_count(F.col("text")))
    elif operator == "shards":
        found = sharding.shard_by_bytes(docs.withColumn("size", sharding.byte_size(F.col("text"))), shards=3)
    else:
        found = urls.judge_urls(docs.select(F.concat(F.lit("http://x.net/"), F.col("doc_id")).alias("url"), F.lit("<html>").alias("html"), "*"), queries.URL_RULES)
    got = {r["doc_id"]: r for r in found.collect()}
    assert {"exact": 3, "near": 1}.get(operator, 12) == len(got)
    for k, row in got.items():
        assert [row[n] for n in inner] == [f"{n} {k}" for n in inner]
