"""Conversation repair against exhaustive search and plain loops: ties, odd rows, conversations over several tasks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewheel.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, piece string, place int, audit string, mark long, at int"
ROLE = {"u": "user", "a": "assistant"}


def exhaustive(rows):
    """(cost, audit, repaired initials) of the best of all edit sequences with up to three insertions, judged by the pattern."""
    best = None
    options = []
    for initial, gone, cut in rows:
        options.append([("D", "", 2)] if gone else [("D", "", 2), ("K", initial, 5 * cut), ("R", "u", 1 + 5 * cut), ("R", "a", 1 + 5 * cut)])
    for chosen in itertools.product(*options):
        for n in range(4):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    edits = list(chosen)
                    for at, role in sorted(zip(places, roles, strict=True), key=lambda x: -x[0]):
                        edits.insert(at, ("I", role, 5))
                    if re.fullmatch("(s?(ua)+)?", "".join(e[1] for e in edits)):
                        key = sum(e[2] for e in edits), "".join(e[0] for e in edits)
                        best = key if best is None or key < best else best
    return best


def relaxed(rows):
    """The same for longer ones: all (state, rows used) labels, bettered until nothing changes."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    labels, changed = {(0, 0): (0, "")}, True
    while changed:
        changed = False
        for (i, s), (cost, audit) in sorted(labels.items()):
            steps = [((i, after[s][r]), 5, "I") for r in "ua" if r in after[s]]
            if i < len(rows):
                initial, gone, cut = rows[i]
                steps.append(((i + 1, s), 2, "D"))
                if not gone:
                    steps += [((i + 1, after[s][r]), 1 + 5 * cut, "R") for r in "ua" if r in after[s]]
                    steps += [((i + 1, after[s][initial]), 5 * cut, "K")] if initial in after[s] else []
            for node, more, letter in steps:
                new = cost + more, audit + letter
                if node not in labels or new < labels[node]:
                    labels[node], changed = new, True
    return min(labels[len(rows), s] for s in (0, 3) if (len(rows), s) in labels)


def test_least_cost_and_audit():
    rng = random.Random(8)
    cases = [[(rng.choice("suatU"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))] for _ in range(120)]
    for rows in cases:
        assert conversations.cheapest(rows) == exhaustive(rows) == relaxed(rows), rows
    for n in (9, 40):
        for _ in range(40):
            rows = [(rng.choice("suuaaat"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]
            assert conversations.cheapest(rows) == relaxed(rows)


def test_blocks_give_the_same(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.choice("suuaaat"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(10, 60))]
        whole = conversations.cheapest(rows)
        monkeypatch.setattr(conversations, "BLOCK", rng.randint(1, 9))
        assert conversations.cheapest(rows) == whole
        monkeypatch.undo()


def plain(rows):
    """Rows (conv, turn, role, text, present) to the query's rows, repaired texts by conversation, in plain loops."""
    out, texts = {}, {}
    for conv in {r[0] for r in rows}:
        held = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, there in rows if c == conv and there]
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in held:
            solid = [c for c in text if c not in " \t\n\v\f\r"]
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        lattice = [(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(held, faults, strict=True)]
        cost, audit = relaxed(lattice)
        numbers = [t for t, _, _ in held if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        lines, left, last = [], iter(held), ""
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append((role, text))
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
        texts[conv] = lines
    return out, texts


def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_query(spark):
    rows = []
    for conv, turn, role, text in given(spark):
        fate = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        new = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text, fate != 0)
        rows += [new] * (2 if fate == 3 else 1)
    got = queries.op13_conversations(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(rows)[0]


def odd_rows():
    rows = [(1, None, "user", "Hi."), (1, 0, "assistant", None), (1, 5, None, "What?"), (1, 9, "", "Yes!"), (2, 3, "tool", "no end"), (2, 3, "tool", "no end"), (None, 1, "user", "Lost."), (3, None, "user", ""), (4, 1, "user", "Long " * 40_000 + ".")]
    rng = random.Random(3)
    rows += [(7, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "Maybe?", " ", f"Text {t}."])) for t in range(0, 400, 3)]
    return rows + [(10 + t, 0, "user", "Hello.") for t in range(20)]


@pytest.mark.parametrize("rows_each", [1_000, 17])
def test_odd_rows_and_conversations_over_several_tasks(spark, rows_each):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "p", 1, "a", 2, 3) for r in rows], SCHEMA).repartition(3)
    got, turns = conversations.repaired(df, rows_each=rows_each)
    want, texts = plain([(*r, True) for r in rows])
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert found == want and found[7][6].count("K") > 20
    shown = {}
    for r in sorted(turns.collect(), key=lambda r: (r.piece, r.place)):
        shown.setdefault(r.conv_id, []).append((r.role, r.text))
    assert shown == {c: t for c, t in texts.items() if t}


def test_rows_that_are_gone_and_empty_tables(spark):
    df = spark.createDataFrame([(*r, "p", 1, "a", 2, 3) for r in odd_rows()], SCHEMA)
    got, turns = conversations.repaired(df, df["conv_id"] != 2)
    row = next(r for r in got.collect() if r.conv_id == 2)
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got, turns = conversations.repaired(df.where("false"))
    assert got.collect() == [] and turns.collect() == []
