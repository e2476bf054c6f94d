import hashlib
import itertools
import random
import re
import zlib

import pytest

from kindred.llm import conversation_repair as repair
from kindred.llm import queries

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, audit string"


def brute_align(turns):
    """Every string of edits with at most three insertions, judged by the grammar."""
    best = None
    for n_new in range(4):
        for spots in itertools.combinations_with_replacement(range(len(turns) + 1), n_new):
            slots = []
            for i in range(len(turns) + 1):
                slots += ["new"] * spots.count(i) + ([turns[i]] if i < len(turns) else [])
            ways = []
            for c in slots:
                if c == "new":
                    ways.append([("I", "u", 5), ("I", "a", 5)])
                else:
                    cut = 5 if c.isupper() else 0
                    ways.append([("D", "", 2)])
                    if c != "x":
                        ways[-1] += [("K", c.lower(), cut), ("R", "u", 1 + cut), ("R", "a", 1 + cut)]
            for way in itertools.product(*ways):
                if re.fullmatch("(s?(ua)+)?", "".join(w[1] for w in way)):
                    found = (sum(w[2] for w in way), "".join(w[0] for w in way))
                    best = found if best is None or found < best else best
    return best


def test_align_equals_enumeration():
    rng = random.Random(1)
    cases = ["", "s", "u", "a", "x", "S", "ua", "sua", "au", "uu", "aua", "uau", "ssua", "suA", "oo", "Ua", "sx", "xsu"]
    cases += ["".join(rng.choice("sssuuuaaaoxSUA") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    cases += ["".join(rng.choice("suuaaoxUA") for _ in range(5)) for _ in range(12)]
    for turns in cases:
        assert repair.align(turns) == brute_align(turns), turns


def by_states(turns):
    """Least cost with a state per letter of the grammar instead of a target; for long conversations."""
    far = 10**12
    cost = {"": 0, "s": far, "u": far, "a": far}
    step = lambda at: {"": "u", "s": "u", "u": "a", "a": "u"}[at]

    def grown(c):
        for _ in range(3):
            for at in list(c):
                c[step(at)] = min(c[step(at)], c[at] + 5)
        return c

    cost = grown(cost)
    for t in turns:
        new = {at: v + 2 for at, v in cost.items()}
        for at, v in cost.items() if t != "x" else ():
            cut = 5 if t.isupper() else 0
            new[step(at)] = min(new[step(at)], v + cut + (t.lower() != step(at)))
            if at == "" and t.lower() == "s":
                new["s"] = min(new["s"], v + cut)
        cost = grown(new)
    return min(cost[""], cost["a"])


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_long_conversations(n):
    rng = random.Random(n)
    turns = "s" + "".join(rng.choice("xU" if rng.random() < 0.1 else "ua"[i % 2] * 20 + "s") for i in range(n))
    cost, audit = repair.align(turns)
    assert cost == by_states(turns)
    assert len(audit) - audit.count("I") == len(turns)
    letters = iter(turns)
    paid, target = 0, iter(repair.targets(audit))
    for edit in audit:
        c = "" if edit == "I" else next(letters)
        if edit != "D":
            want = next(target)
            assert edit != "K" or c.lower() == want
            assert c != "x"
        paid += {"D": 2, "I": 5, "K": 0, "R": 1}[edit] + (5 if c.isupper() and edit in "KR" else 0)
    assert paid == cost


def brute_report(rows):
    """The contract, row by row in Python."""
    space = lambda x: " " if x is None else str(x)
    by_conv = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        mark = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        row = (turn, "user" if mark == 4 else role, text)
        by_conv[conv] += [row] * (2 if mark == 3 else 1)
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, letters, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters.append("x" if fault in ("blank", "duplicate") else c.upper() if fault else c)
        at = [t for t, _, _ in turns if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
        cost, audit = brute_align("".join(letters))
        lines, left, rest = [], iter(turns), sum(map(audit.count, "KRI"))
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else 'au'[rest % 2 == 0] == 'u' and 'user' or 'assistant'}:{text}")
                rest -= 1
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for conv in range(150):
        for turn in range(rng.randint(1, 4)):
            text = rng.choice(["Yes.", "No!", "Why?", "so", "", " ", None, "a.b c", "x. \t\n", "Done. ", f"turn {turn}."])
            role = rng.choice(["user", "assistant"][turn % 2 :] + ["system"] * (turn == 0) + ["tool"] * (conv % 9 == 0))
            out.append((conv, turn + (turn > 1) * (conv % 5), role, text))
    out += [(None, 0, "user", "Hi."), (None, None, None, "Hi."), (500, None, "user", "A."), (500, None, "assistant", None)]
    out += [(501, 3, "user", "Same."), (501, 3, "user", "Same."), (501, 4, "", "Same."), (502, 0, "user", "é" * 100_000 + ".")]
    return out


def test_query_equals_brute_force(spark, rows, tmp_path):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS).repartition(3)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_report(rows)


def test_repaired_turns(spark):
    turns = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (2, 0, "system", "S."), (2, 1, "user", "Q?")]
    judged = repair.judged(spark.createDataFrame([(*t, 0, "") for t in turns], TURNS))
    found = repair.audits(judged)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (2, "DKK"), 2: (4, "DD")}
    out = repair.repaired_turns(judged, found).orderBy("conv_id", "place").collect()
    for conv in {r.conv_id for r in out}:
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in out if r.conv_id == conv))
    assert [(r.place, r.text) for r in out if r.conv_id == 1] == [(1, "B."), (2, "C.")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_report(repair.damaged(empty), empty).count() == 0
