"""Conversation repair: audits against strings, edits against all edit sequences, settled prefixes, the query, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerspark.llm import queries, repair
from ledgerspark.llm.repair import BAD, FINE, TRUNCATED, Audits, Conversation, Repair

FAULTS = {BAD: "blank", TRUNCATED: "cut", FINE: "whole."}


@pytest.mark.parametrize("fold", [None, lambda before, letter: 7, lambda before, letter: (before + letter) % 3])
def test_audits_compare_like_strings(fold):
    """The last two folds collide all the time, so only the letters can decide."""
    rng, audits = random.Random(0), Audits(fold)
    for _ in range(300):
        audits.add(rng.randrange(len(audits.letter)) if rng.random() < 0.3 else len(audits.letter) - 1, rng.choice(b"DI"))
    words = [audits.text(n) for n in range(len(audits.letter))]
    for a, b in itertools.product(rng.sample(range(len(words)), 60), repeat=2):
        assert audits.less(a, b) == (words[a] < words[b])
        assert audits.text(audits.ancestor(a, audits.depth[a] // 2)) == words[a][: audits.depth[a] // 2]


def all_edits(rows):
    """Cheapest (cost, audit) by trying every sequence of edits with two insertions at most in a row."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            roles, cost, audit, good = "", 2 * sum(inserts), "I" * inserts[0], True
            new = lambda: "a" if roles.endswith("u") else "u"  # noqa: E731, B023
            for _ in range(inserts[0]):
                roles += new()
            for (initial, kind), edit, n in zip(rows, edits, inserts[1:], strict=True):
                good &= edit == "D" or kind != BAD
                cost += {"D": 3, "K": 0, "R": 2}[edit] + (kind == TRUNCATED and edit != "D")
                roles += {"D": "", "K": initial, "R": new()}[edit]
                for _ in range(n):
                    roles += new()
                audit += edit + "I" * n
            if good and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("settle", [False, True])
def test_edits_against_all_sequences(settle):
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suaux"), rng.choice([FINE, FINE, TRUNCATED, BAD])) for _ in range(rng.randrange(5))]
        dp, given = Repair(), ""
        for row in rows:
            dp.row(*row)
            given += dp.settled() if settle else ""
        cost, rest = dp.end()
        assert (cost, given + rest) == all_edits(rows), rows


def test_settled_prefixes():
    """Long runs: giving out settled prefixes changes nothing; mixed roles leave a short stretch undecided, and nodes are small."""
    rng = random.Random(2)
    for weights in ([1, 1, 1, 1], [6, 1, 1, 1], [0, 1, 0, 0], [0, 0, 0, 1]):
        rows = list(zip(rng.choices("suax", weights, k=2_000), rng.choices([FINE, TRUNCATED, BAD], [5, 2, 2], k=2_000), strict=True))
        plain, dp, given, waits = Repair(), Repair(), [], 0
        for i, row in enumerate(rows):
            plain.row(*row)
            dp.row(*row)
            if i % 64 == 63:
                given.append(dp.settled())
                waits = max(waits, len(dp.audits.letter))
        cost, rest = dp.end()
        assert (cost, "".join(given) + rest) == plain.end()
        held = plain.audits
        assert sum(x.itemsize * len(x) for x in (held.ups, held.first, held.depth, held.hash, held.same)) < 100 * len(held.letter)
        assert min(weights) == 0 or waits < 1_000


def expected(rows):
    """Result of the contract for rows (turn, role, text) in order, edits by the DP."""
    seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append((role[:1], BAD if fault in ("blank", "duplicate") else TRUNCATED if fault else FINE))
    dp = Repair()
    for c in codes:
        dp.row(*c)
    cost, audit = dp.end()
    out, state, left = [], 0, iter(rows)
    for e in audit:
        row = next(left) if e != "I" else None
        if e == "D":
            continue
        new = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((row[1] if e == "K" else new, row[2] if row else ""))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def broken(conv, rows):
    """The damage of the contract to rows (turn, role, text), then their order."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df, rows):
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append(tuple(row))
    assert got == {c: expected(broken(c, r)) for c, r in want.items()}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op12_repair(spark, sf_dir), rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHORT", 4)
    monkeypatch.setattr(repair, "SETTLE", 8)
    monkeypatch.setattr(repair, "HELD", 100)
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " \t\x0b\n", "same.", "same", "no end \n", "wh?t!", " ", "x" * 3_000_000 + ".", f"{rng.random()} ends."])
    rows = [(rng.choice([None, 1, 2, 3, *range(4, 30)]), rng.choice([None, 0, 1, 2, *range(3, 90)]), rng.choice([None, "", "system", "user", "assistant", "tool"]), text()) for _ in range(300)]
    rows += [(900 + c, 0, "user", "gone or not.") for c in range(60)] + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text AS gone", "1 AS way", "2 AS blank")
    compare(repair.repair(repair.damaged(df)), rows)
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


@pytest.mark.parametrize("roles", [["user", "assistant", "system"], ["tool"]])
def test_rows_wait_in_a_file(monkeypatch, roles):
    """The first edits of like roles stay open to the end; their texts wait on disk."""
    monkeypatch.setattr(repair, "HELD", 1_000)
    c, rng, most = Conversation({}), random.Random(4), 0
    rows = [(i, rng.choice(roles), f"text {i}" + rng.choice(["", "."])) for i in range(2_001)]
    for turn, role, text in rows:
        c.add(turn, role, text, False, text[-1] != ".", False)
        most = max(most, sum(len(t) for _, t in c.rows.rows))
    assert c.result() == expected(rows) and most <= 1_000
