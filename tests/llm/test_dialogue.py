"""Repair of conversations: the program against all edits and a search of cheapest paths, long conversations in many ranges, odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest

from quarry.llm import dialogue as D

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, place string, code int, `range` int, wording string, copy int, `a.b` int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "w", 3, 4) for r in rows], SCHEMA)


def codes_of(kinds):
    """Codes of pairs (initial, fault)."""
    return bytes("?sua".index(k) + 4 * f for k, f in kinds)


def every_edit(kinds):
    """(cost, audit, final initials) of the least of all edits, with up to two insertions in each gap."""
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    options = []
    for kind, fault in kinds:
        own = [("D", "", 2)]
        if fault not in (D.BLANK, D.DUPLICATE):
            extra = 5 if fault == D.TRUNCATED else 0
            own += [("K", kind, extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(own)
    for some in product(*options):
        for filled in product(gaps, repeat=len(kinds) + 1):
            final = "".join(g + o[1] for g, o in zip(filled, some, strict=False)) + filled[-1]
            if LEGAL.match(final):
                audit = "".join("I" * len(g) + o[0] for g, o in zip(filled, some, strict=False)) + "I" * len(filled[-1])
                found = (sum(o[2] for o in some) + 5 * sum(map(len, filled)), audit, final)
                best = found if best is None else min(best, found)
    return best


def cheapest_path(kinds):
    """The same by a search of cheapest paths over (rows taken, last role)."""
    heap, done = [(0, "", 0, "-", "")], set()
    follows = {"-": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, audit, i, role, final = heapq.heappop(heap)
        if i < 0:
            return cost, audit, final
        if (i, role) in done:
            continue
        done.add((i, role))
        if i == len(kinds) and role in "-a":
            heapq.heappush(heap, (cost, audit, -1, role, final))
        for new in follows[role].replace("s", ""):
            heapq.heappush(heap, (cost + 5, audit + "I", i, new, final + new))
        if i < len(kinds):
            kind, fault = kinds[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, role, final))
            if fault not in (D.BLANK, D.DUPLICATE):
                extra = 5 if fault == D.TRUNCATED else 0
                for new in follows[role]:
                    if new == kind:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, new, final + new))
                    if new != "s":
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, new, final + new))


def whole(codes):
    costs, tables = D.solve(codes, D.END_COSTS)
    letters, final, _ = D.walk(codes, D.END_COSTS, tables, D.NONE, True)
    assert costs[D.NONE] == D.cost_of(codes, letters)
    return costs[D.NONE], letters, final


def test_program_matches_all_edits():
    rng = random.Random(2)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3):
        kinds = [(rng.choice("suua?"), rng.choice([0, 0, 0, D.BLANK, D.DUPLICATE, D.TRUNCATED])) for _ in range(n)]
        assert whole(codes_of(kinds)) == every_edit(kinds) == cheapest_path(kinds), kinds


@pytest.mark.parametrize("seed", range(8))
def test_program_matches_cheapest_paths(seed):
    rng = random.Random(seed)
    for _ in range(60):
        weights = rng.choice([[1, 1, 1, 1], [0, 5, 5, 0], [1, 9, 1, 1], [1, 1, 9, 0]])
        kinds = [(rng.choices("sua?", weights)[0], rng.choice([0, 0, rng.randint(0, 3)])) for _ in range(rng.randint(1, 30))]
        assert whole(codes_of(kinds)) == cheapest_path(kinds), kinds


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_report(original, damaged):
    """What the query returns, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text in damaged:
        wording = hashlib.md5("\0".join(["-" if conv is None else f"={conv}", role, text]).encode()).digest()
        groups[conv].append(((turn is not None, turn or 0), role, text[:256], wording, turn, text))
    out = []
    for conv in {r[0] for r in original}:
        rows = sorted(groups[conv], key=lambda r: r[:4])
        seen, kinds, counts = set(), [], Counter()
        for _, role, _, _, _, text in rows:
            shown = text.strip(SPACE)
            fault = D.BLANK if not shown else D.DUPLICATE if (role, text) in seen else D.TRUNCATED if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        turns = [r[4] for r in rows if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, audit, final = cheapest_path(kinds)
        lines, at, roles = [], 0, iter(final)
        for letter in audit:
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[next(roles)])
                continue
            if letter != "D":
                role = next(roles)
                lines.append(f"{rows[at][1] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[role]}:{rows[at][5]}")
            at += 1
        out.append((conv, gaps, counts[D.BLANK], counts[D.DUPLICATE], counts[D.TRUNCATED], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def full(original, damaged):
    report, repaired = D.repair_conversations(damaged)
    return D.full_report(original, report, D.repaired_digests(repaired))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def corpus(seed, convs=80, longest=14):
    rng = random.Random(seed)
    texts = [None, "", " \t", "Well.", "Well.", "Yes!", "Why?\n ", "open", "open ended ", "a ", "é.", ".", "x" * 300 + "1.", "x" * 300 + "2."]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, "", "u", "ä"]
    rows = []
    for conv in [None, *range(convs)]:
        for k in range(rng.randint(1, longest)):
            turn = rng.choice([k, k, k + 1, k * 2, None, -3])
            role = rng.choice([("user", "assistant")[k % 2]] * 12 + roles)
            rows += [(conv, turn, role, rng.choice([*texts, f"own {k}."]))] * rng.choice([1, 1, 1, 2])
    return rows


def test_report_matches_plain_one_on_odd_rows(spark):
    rows = corpus(4)
    original = rows_of(spark, rows)
    damaged = D.damage(original)
    assert Counter(map(tuple, damaged.collect())) == Counter(plain_damage(rows))
    found = full(original, damaged)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == plain_report(rows, plain_damage(rows))


def test_long_conversations_in_many_ranges(spark):
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant"] * 5 + ["system", "tool"]), rng.choice(["Well.", f"own {k}.", f"own {k}!", "open", ""])) for k in range(1_500)]
    rows += [(7, None, "user", f"early {k}.") for k in range(120)] + [(8, 5, "user", "Same.")] * 700 + [(None, k // 3, "assistant", f"{k}?") for k in range(400)]
    rows += [(conv, k, ("user", "assistant")[k % 2], f"{conv} {k}.") for conv in range(20, 40) for k in range(6)]
    original = rows_of(spark, rows)
    found = full(original, original)
    assert sorted(map(tuple, found.collect()), key=str) == plain_report(rows, rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 2, "user", "Go."), (1, 3, "user", "Go on."), (2, 0, "user", "")]
    report, repaired = D.repair_conversations(rows_of(spark, rows))
    assert repaired.columns == ["conv_id", "position", "turn", "role", "text", "edit"]
    got = [tuple(r)[0:1] + tuple(r)[2:] for r in repaired.orderBy("conv_id", "position").collect()]
    audits = {r["conv_id"]: (r["audit"], r["cost"], r["gaps"]) for r in report.collect()}
    assert audits[2] == ("D", 2, 0)
    # the first turn goes and the last gets the other role, or the like at equal cost: the least letters
    assert audits[1][:2] == cheapest_path([("a", 0), ("u", 0), ("u", 0)])[1::-1] and audits[1][2] == 1
    assert "".join(r[4] for r in got) == audits[1][0].replace("D", "") and LEGAL.match("".join(r[2][0] for r in got))


def test_no_rows_and_all_dropped(spark):
    none = rows_of(spark, [])
    assert full(none, none).collect() == []
    original = rows_of(spark, [(3, 0, "user", "Hi."), (None, 1, "user", "Hi.")])
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, full(original, D.damage(original).limit(0)).collect()), key=str) == [(3, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]


def test_extreme_turns_and_long_texts(spark):
    rows = [(1, -(2**63), "user", "a" * 400_000 + "."), (1, 2**63 - 1, "assistant", "b" * 400_000 + "!"), (2, 5, "user", "Hi.")]
    original = rows_of(spark, rows)
    found = {r["conv_id"]: r for r in full(original, original).collect()}
    assert found[1]["audit"] == "KK" and found[1]["gaps"] == 0 and found[2]["audit"] in ("D", "KI")  # a gap beyond 64 bits counts as none


def test_query_matches_plain_version(spark, data):
    from quarry.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_repair(spark, data)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == plain_report(rows, plain_damage(rows))


def test_query_matches_its_sql(spark, data, duck):
    from quarry.llm import queries

    found = queries.op11_repair(spark, data)
    sql = duck.sql(queries.ORACLES["op11_repair"])
    assert sql.columns == found.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, sql.fetchall()), key=str)
