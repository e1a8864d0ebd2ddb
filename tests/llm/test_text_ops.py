"""Packing, id matrices, secrets, quality: operators that read a document at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import binpack, packing, quality, queries, secrets
from quarry.llm.text import TokenEncoder, token_encoder

DOC = "doc_id long, text string, start int, ids string, `odd name` int"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, null ids, and columns with names that the operators use themselves."""
    long = "One two three. " * 3000
    rows = [(1, None, 1, "x", 0), (2, "", None, None, None), (3, long, 1, "x", 0), (3, long, 1, "x", 0), (None, "No id. At all", 2, "y", 1), (5, "a" * 5000, 3, "z", 1), (6, "日本語。テキスト。" * 50, 0, "", 0)]
    return spark.createDataFrame(rows, DOC)


def test_both_tokenizer_files_give_equal_ids(duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    fast, slow = TokenEncoder(queries.tokenizer_path()), TokenEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for (t,) in duck.execute("select text from documents").fetchall()] + ["", " ", "\n\n  x", "a<|endoftext|>b", "a  <|endoftext|><|endoftext|> \n b <|endoftext|", "e\u0301 \U0001f600", "x" * 3000, " " * 3000]
    for text, a, b in zip(texts, fast.encode(texts), slow.encode(texts), strict=True):
        assert a.tolist() == b.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]
    assert fast.special == slow.special == {"<|endoftext|>": 50256}
    assert fast.bytes_of == {i: w for i, w in slow.bytes_of.items() if i < 50256}


def brute_cuts(positions, penalties, capacity, overhead, powers):
    cost = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            n = positions[j] - positions[i]
            if n <= capacity:
                padding = 0 if powers and n & (n - 1) == 0 else capacity - n
                cost[j] = min(cost[j], cost[i] + overhead + padding + penalties[j])
    return cost[-1]


def cost_of(cuts, positions, penalties, capacity, overhead, powers):
    total = 0.0
    for i, j in zip(cuts, cuts[1:]):
        n = positions[j] - positions[i]
        assert 0 < n <= capacity
        total += overhead + penalties[j] + (0 if powers and n & (n - 1) == 0 else capacity - n)
    return total


@pytest.mark.parametrize("powers", [True, False])
def test_window_cuts_are_optimal(powers):
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([4, 8, 16, 20])
        positions = [0]
        for _ in range(rng.randint(1, 40)):
            positions.append(positions[-1] + rng.randint(1, min(4, capacity)))
        penalties = [0] + [rng.choice([0, 1, 5, 9]) for _ in positions[1:]]
        overhead = rng.choice([0, 1, 3])
        cuts = packing.window_cuts(positions, penalties, capacity, overhead, powers=powers)
        assert cuts[0] == 0 and cuts[-1] == len(positions) - 1
        assert cost_of(cuts, positions, penalties, capacity, overhead, powers) == pytest.approx(brute_cuts(positions, penalties, capacity, overhead, powers))


def check_pieces(rows, docs, capacity, end_id=1):
    """Exact round trip: pieces tile documents and windows."""
    encoder = token_encoder(queries.tokenizer_path())
    wanted = sorted(((d, encoder.encode([t or ""])[0].tolist() + [end_id]) for d, t in docs), key=str)
    windows = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    found = []
    ordered = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    open_docs = {}
    for r in ordered:  # documents stay in order, so that a document's pieces follow each other
        key = r["doc_id"]
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert r["start"] == len(open_docs.get(key, []))
        open_docs.setdefault(key, []).extend(ids)
        if len(open_docs[key]) == r["doc_tokens"]:
            found.append((key, open_docs.pop(key)))
    assert not open_docs
    assert sorted(found, key=str) == wanted
    return windows


@pytest.mark.parametrize("capacity,block", [(2048, 1 << 19), (64, 128), (8, 64)])
def test_packing_round_trip(spark, capacity, block):
    docs = odd_docs(spark)
    rows = packing.pack_windows(docs.coalesce(1), queries.tokenizer_path(), capacity, grid=min(64, capacity), block_tokens=block).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], capacity)


def test_packing_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    full = packing.pack_windows(spark.read.parquet(f"{data}/documents.parquet"), queries.tokenizer_path()).collect()
    windows = check_pieces(full, [tuple(r) for r in docs], 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(x[1] for x in w) for w in windows.values()))
    assert padding < 0.02 * sum(r["length"] for r in full)
    digest = {(r["doc_id"], r["start"]): r for r in queries.op1_pack(spark, data).collect()}
    for r in full:
        assert digest[r["doc_id"], r["start"]]["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    # windows end with documents or sentences; the few others lie in sentences longer than a window
    encoder = token_encoder(queries.tokenizer_path())
    texts = dict(tuple(r) for r in docs)
    last = {}
    for r in full:
        last[r["sequence_id"]] = max(last.get(r["sequence_id"], r), r, key=lambda x: x["offset"])
    inside = 0
    for r in last.values():
        stop = r["start"] + r["length"]
        if stop < r["doc_tokens"]:
            ids = encoder.encode([texts[r["doc_id"]]])[0].tolist()
            before, after = (b"".join(encoder.bytes_of[i] for i in part).decode("utf-8", "replace") for part in (ids[:stop], ids[stop:]))
            ended = before.rstrip("\"')]}").endswith((".", "!", "?")) and not after[:1].strip() or "\n" in encoder.bytes_of[ids[stop - 1]].decode("utf-8", "replace") or before.endswith(("。", "！", "？"))
            inside += not ended
    assert inside <= 0.03 * len(last)


def test_long_sentences_are_cut_inside_and_long_documents_in_parts(spark):
    text = "One two three four. " * 100 + "word " * 3000 + ". " + "Five six seven. " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = packing.pack_windows(docs, queries.tokenizer_path(), 256, block_tokens=1 << 10).collect()
    check_pieces(rows, [(1, text)], 256)
    ids = token_encoder(queries.tokenizer_path()).encode([text])[0].tolist()
    words = token_encoder(queries.tokenizer_path()).bytes_of
    stops = [r["start"] + r["length"] for r in rows if r["offset"] + r["length"] == sum(x["length"] for x in rows if x["sequence_id"] == r["sequence_id"])]
    inside = [s for s in stops if s < len(ids) and not words[ids[s - 1]].endswith(b".")]
    assert all(words[ids[s - 1]] == b" word" or words[ids[s - 1]] == b"word" for s in inside) and 10 <= len(inside) <= 14


def test_packing_empty_and_bad_parameters(spark):
    none = packing.pack_windows(odd_docs(spark).limit(0), queries.tokenizer_path())
    assert none.count() == 0 and none.columns[0] == "doc_id"
    with pytest.raises(ValueError):
        packing.pack_windows(odd_docs(spark), queries.tokenizer_path(), capacity=1)


def test_room_tree_finds_least_room():
    rng = random.Random(1)
    tree, rooms = binpack.RoomTree(37), []
    for _ in range(2000):
        if rooms and rng.random() < 0.4:
            room = rooms.pop(rng.randrange(len(rooms)))
            tree.add(room, -1)
        else:
            rooms.append(rng.randint(0, 37))
            tree.add(rooms[-1], 1)
        need = rng.randint(0, 37)
        assert tree.least(need) == min((r for r in rooms if r >= need), default=None)


def test_best_fit_decreasing_matches_plain_search():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 50) for _ in range(80)]
        rows = binpack.best_fit_decreasing(sizes, 50)
        room, plain = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [r for r in range(len(room)) if room[r] >= sizes[k]]
            if fits:
                best = min(fits, key=lambda r: room[r])
            else:
                room.append(50)
                best = len(room) - 1
            room[best] -= sizes[k]
            plain[k] = best
        used = {}
        for k, row in enumerate(rows):
            used[row] = used.get(row, 0) + sizes[k]
        assert max(used.values()) <= 50 and len(used) == len(room)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_matrix_round_trip(spark, tmp_path, capacity):
    docs = odd_docs(spark)
    packed = binpack.pack_matrix(docs.coalesce(2), queries.tokenizer_path(), capacity, block_tokens=max(capacity, 1 << 12))
    binpack.write_packed(packed, f"file://{tmp_path}/packed")
    rows = spark.read.parquet(f"file://{tmp_path}/packed").collect()
    matrix = binpack.read_matrix(rows, capacity)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    pieces = {}
    for row, ids in zip(rows, matrix, strict=True):
        ends = row["cu_seqlens"]
        assert ends[0] == 0 and ends[-1] == row["used"] <= capacity and row["position_resets"] == ends[:-1]
        assert not ids[row["used"] :].any()
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            pieces.setdefault((row["doc_ids"][k], row["doc_tokens"][k]), []).append((row["starts"][k], ids[a:b].tolist()))
    encoder = token_encoder(queries.tokenizer_path())
    wanted = {}
    for r in docs.collect():
        ids = encoder.encode([r["text"] or ""])[0].tolist() + [1]
        wanted.setdefault((r["doc_id"], len(ids)), []).append(ids)
    assert pieces.keys() == wanted.keys()
    for key, copies in wanted.items():
        parts = sorted(pieces[key])
        for at in range(0, key[1], capacity):  # equal rows have equal pieces
            assert [p for s, p in parts if s == at] == [copies[0][at : at + capacity]] * len(copies)


def test_matrix_empty(spark):
    assert binpack.pack_matrix(odd_docs(spark).limit(0), queries.tokenizer_path()).count() == 0


def plain_spans(text):
    kinds = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    out = [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return sorted(out, key=lambda s: (s[1], list(kinds).index(s[0])))


def test_base_spans_match_plain_patterns():
    rng = random.Random(4)
    bits = ["token", "=", ":", " ", '"', "secret", "API_KEY", "apikey", "passwd", "AKIA", "0f" * 13, "ABCDEFGH0123456789", "x", "é", "\n", "/", "deadbeef", "ſecret", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.scan(text) if s[0] != "random"] == plain_spans(text), text


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(5)
    alphabet = secrets.ENCODINGS["base64"]
    found = sum(any(s[0] == "random" for s in secrets.scan("see " + "".join(rng.choice(alphabet) for _ in range(44)) + " end")) for _ in range(200))
    assert found >= 180
    clean = ["internationalization_of_components", "https/example/com/articles/archive/listing", "a" * 60, "thequickbrownfoxjumpsoverthelazydog", "0123456789" * 4, "GetUserAccountDetailsByIdentifier", "====================", "-" * 40]
    assert not any(s[0] == "random" for t in clean for s in secrets.scan(t))


@pytest.mark.parametrize("before,after", [("AUTH=", ""), ("see ?sig=", "== end"), ("key=", "=more"), ("/my-app/", ""), ("my-app/v1_b/", "/x"), ("a/b_c-", "")])
@pytest.mark.parametrize("alphabet", ["base62", "base64", "base64url"])
def test_random_strings_behind_names_and_paths_are_found(before, after, alphabet):
    rng = random.Random(6)
    found = exact = 0
    for _ in range(200):
        key = "".join(rng.choice(secrets.ENCODINGS[alphabet]) for _ in range(44))
        text = f"{before}{key}{after}"
        spans = [s for s in secrets.scan(text) if s[0] == "random"]
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
        at = len(before)
        # a cut keeps most of the key, as its own signs may be those of the other alphabet
        found += any(min(e, at + 44) - max(s, at) >= 20 for _, s, e in spans)
        exact += any(s == at and at + 44 <= e <= at + 46 for _, s, e in spans)
    assert found >= (170 if "/" not in before else 130)
    assert exact >= 170 or "/" in before
    assert not any(s[0] == "random" for s in secrets.scan(f"{before}internationalization_of_components{after}"))


def test_false_discoveries_are_controlled_by_length():
    assert secrets.discoveries([], []) == []
    assert secrets.discoveries([math.log(1e-4)], [30], 1e-3) == [True]
    # the same p-value is enough for a long string and not for a short one
    assert secrets.discoveries(np.log([6e-4, 6e-4, 0.5, 0.5]).tolist(), [100, 20, 60, 60], 2e-3) == [True, False, False, False]


@pytest.mark.parametrize("length", [20, 24, 32, 64, 152, 160, 1000, 10_000])
@pytest.mark.parametrize("encoding", list(secrets.ENCODINGS))
def test_random_strings_of_every_encoding_and_length_are_found(encoding, length):
    rng, rounds = random.Random(7), 100 if length <= 160 else 30
    found = 0
    for _ in range(rounds):
        key = "".join(rng.choice(secrets.ENCODINGS[encoding]) for _ in range(length))
        found += any(b - a >= 0.9 * length for _, a, b in secrets.scan(f"see {key} end"))
    assert found >= 0.9 * rounds


@given(st.lists(st.tuples(st.sampled_from([*secrets.ENCODINGS.values(), "a", "=", "/-_+", "é ."]), st.integers(0, 2000)), max_size=4), st.integers(0, 999))
@settings(max_examples=60, deadline=None, phases=[Phase.generate])
def test_no_string_breaks_the_scan(parts, seed):
    rng = random.Random(seed)
    text = "".join("".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in parts)
    spans = secrets.scan(text)
    assert [s for s in spans if s[0] != "random"] == plain_spans(text)
    assert all(0 <= a < b <= len(text) for _, a, b in spans)
    assert [s for s in spans if s[0] == "random"] == plain_random_spans(text)


def plain_random_spans(text):
    """The random spans of a text by loops over characters, in plain floating point on whole sums."""
    base = plain_spans(text)
    signs = set("+/_=-")
    alnum = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def pieces(start, end, cut):
        out, at = [], start
        for k in range(start, end + 1):
            if k == end or text[k] in cut:
                if k > at:
                    out.append((at, k))
                at = k + 1
        return out

    def encoding(a, b):
        body = text[a:b].rstrip("=")
        return next((n for n in ("hex", "HEX", "base32", "base62", "base64", "base64url") if body and set(body) <= set(secrets.ENCODINGS[n])), None)

    def kind(c):
        return "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "sign"

    runs, at = [], 0
    for k in range(len(text) + 1):
        if k == len(text) or text[k] not in alnum | signs:
            runs += [(at, k)] if k - at >= 20 else []
            at = k + 1
    tested = []
    for a, b in runs:
        parts, k = [], a
        while k < b:  # text up to an inner "=", with padding where it ends the run
            while k < b and text[k] == "=":
                k += 1
            e = k
            while e < b and text[e] != "=":
                e += 1
            end = b if set(text[e:b]) <= {"="} else e
            parts, k = parts + ([(k, end)] if e > k and end - k >= 20 else []), end
        for x, y in parts:
            if encoding(x, y):
                own = {(x, y)}
            else:
                own = {(p, q) for cut in ("_-", "+/", "/_-") for p, q in pieces(x, y, cut) if q - p >= 20}
            for p, q in sorted(own):
                name = encoding(p, q)
                if name is None or any(s < q and p < e for _, s, e in base):
                    continue
                alphabet, body = secrets.ENCODINGS[name], text[p:q].rstrip("=")
                n, size = len(body), len(alphabet)
                chi = sum((body.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
                tail = lambda z: math.erfc(z / 2**0.5) / 2
                ps = [tail((chi - size + 1) / max(1e-9, 2 * (size - 1) * (n - 1) / n) ** 0.5)]
                share = Counter(map(kind, alphabet))
                even = 1 - sum((v / size) ** 2 for v in share.values())
                changes = sum(kind(u) != kind(v) for u, v in zip(body, body[1:]))
                ps.append(2 * tail(abs(changes - (n - 1) * even) / max(1e-9, (n - 1) * even * (1 - even) * 1.5) ** 0.5))
                values = [alphabet.index(c) for c in body]
                mean = sum(values) / n
                power = sum((v - mean) ** 2 for v in values)
                serial = sum((u - mean) * (v - mean) for u, v in zip(values, values[1:])) / power if power > 1e-6 else 1.0
                ps.append(2 * tail(abs(serial + 1 / n) * n**0.5))
                prior = dict(zip(("digit", "upper", "lower", "sign"), secrets.WRITTEN_CLASSES))
                log = math.log(prior[kind(body[0])])
                for j, c in enumerate(body):
                    if j:
                        before = kind(body[j - 1])
                        log += math.log(1 - secrets.WRITTEN_CHANGE if before == kind(c) else secrets.WRITTEN_CHANGE * prior[kind(c)] / (1 - prior[before]))
                    if c.isalpha():
                        last = body[j - 1].lower() if j else ""
                        vowel = secrets.VOWEL_AFTER[0 if last and last in "aeiou" else 1 if last.isalpha() else 2]
                        same = [x for x in secrets.LETTERS if (x in "aeiou") == (c.lower() in "aeiou")]
                        weight = {x: max(secrets.LETTERS[x], secrets.LEAST_LETTER) for x in same}
                        log += math.log(vowel if c.lower() in "aeiou" else 1 - vowel) + math.log(weight[c.lower()] / sum(weight.values()))
                    else:
                        log += math.log(0.1 if c.isdigit() else 0.25)
                tested.append((min(0, math.log(6) + log + n * math.log(size)), p, q, min(ps)))
    total = sum(q - p for _, p, q, _ in tested)
    scaled = sorted((t[0] - math.log((t[2] - t[1]) * len(tested) / total), k) for k, t in enumerate(tested))
    last = max([j for j, (v, _) in enumerate(scaled) if v <= math.log(secrets.FALSE_DISCOVERIES * (j + 1) / len(tested))], default=-1)
    passed = sorted((tested[k] for _, k in scaled[: last + 1] if tested[k][3] >= secrets.UNIFORM_LEVEL), key=lambda t: (t[0], t[1] - t[2], t[1]))
    chosen = []
    for _, p, q, _ in passed:
        if all(q <= x or y <= p for x, y in chosen):
            chosen.append((p, q))
    return [("random", p, q) for p, q in sorted(chosen)]


def test_secret_query(spark, data, duck):
    rows = {r["doc_id"]: r for r in queries.op10_secrets(spark, data).collect()}
    docs = duck.execute("select doc_id, text from documents").fetchall()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        spans = plain_spans(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[doc_id]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [rows[doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(listed.split(",")) - {""} <= set(rows[doc_id]["spans"].split(","))


def test_secrets_of_odd_rows(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(9, "token=abcdef12 é " + "0af1" * 8, 1, "", 1)], DOC))
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == 8
    hit = next(r for r in rows if r["doc_id"] == 9)
    assert [(s["kind"], s["value"]) for s in hit["spans"]] == [("assign", "token=abcdef12"), ("hex", "0af1" * 8)]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def auc(scores, good):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n = good.sum()
    return (ranks[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_quality_of_held_out_documents(spark, duck):
    folder = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, folder).collect()
    labels = dict(duck.execute(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    assert len(rows) == duck.execute(f"select count(*) from '{folder}/documents.parquet'").fetchone()[0]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = np.array([labels[r["doc_id"]] == 1 for r in held])
    assert auc(np.array([r["score"] for r in held]), good) > 0.97
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.93


def test_quality_never_learns_from_held_out_labels(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more. " * (1 + k % 7)) for k in range(60)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(60)]
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in labels]
    a, b = (quality.learn(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_pairwise_fit_orders_pairs_and_sets_the_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    good = x @ np.array([2, -1, 0, 0, 0, 0]) + rng.normal(size=500) * 0.1 > -1
    model = quality.fit(x, good)
    assert auc(model.utility(x), good) > 0.98
    assert abs(float((model.score(x) < 0.3).mean()) - float((~good).mean())) < 0.01


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    model = quality.learn(odd_docs(spark), labels)
    docs = odd_docs(spark).withColumn("score", F.lit("old"))
    scored = quality.score_quality(docs, model)
    assert scored.columns.count("score") == 1
    assert [round(r["score"], 6) for r in scored.collect()] == [0.5] * 7
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert np.isfinite(quality.features(None)).all() and np.isfinite(quality.features("x" * 100_000)).all()


def test_repeated_ids_give_one_row_to_the_fit(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 20, f"word {k % 20} of row {k // 20}.") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, good, *rest: seen.append(len(x)))
    quality.learn(docs, labels, rows=7)
    quality.learn(docs, labels)
    held = sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(20))
    assert seen == [7, 20 - held]


def test_fit_agrees_with_gradient_descent_on_all_pairs():
    """The stochastic fit against a plain one on every pair of a good and a poor row."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)) * [1, 3, 0.2, 1] + 5
    good = x @ [1.5, -0.2, 0, 0.4] + rng.normal(size=60) * 0.6 > 8.5
    model = quality.fit(x, good, steps=3000)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    differences = [(a - b).tolist() for a in z[good] for b in z[~good]]
    w = [0.0] * 4
    for _ in range(1500):
        gradient = [1e-3 * v for v in w]
        for d in differences:
            miss = 1 / (1 + math.exp(sum(p * q for p, q in zip(d, w))))
            gradient = [g - miss * v / len(differences) for g, v in zip(gradient, d)]
        w = [v - 0.5 * g for v, g in zip(w, gradient)]
    own = model.utility(x) - model.utility(x).mean()
    plain = z @ np.array(w)
    assert np.corrcoef(own, plain - plain.mean())[0, 1] > 0.995
    ranked = lambda u: np.mean([u[i] > u[j] for i in np.flatnonzero(good) for j in np.flatnonzero(~good)])
    assert abs(ranked(own) - ranked(plain)) < 0.01
    assert (model.score(x) >= 0.3).sum() == pytest.approx(good.sum(), abs=1)
