"""Transcript parsing: Viterbi against all paths, blocks against the whole, markers, odd rows, held-out accuracy."""

import itertools

import duckdb
import numpy as np
import pytest

from ledgerspark.llm import chat_format, queries

CONV = "conv_id long, turn_id long, part long, text string, role string, code int"
TALK = [(c, 0, t, ("short question" if t % 2 == 0 else "a much longer answer " * 9 + "\n" + "second line " * 9), "user" if t % 2 == 0 else "assistant", 1) for c in range(30) for t in range(6)]


@pytest.fixture(scope="module")
def model(spark):
    return chat_format.fit(spark.createDataFrame(TALK, CONV).select("conv_id", "part", "text", "role"))


def test_viterbi_is_best_path(model):
    rng = np.random.default_rng(0)
    for n in (1, 2, 4):
        codes = rng.integers(0, model.emit.shape[1], n)
        score = lambda p: model.start[p[0]] + sum(model.emit[s, c] for s, c in zip(p, codes, strict=True)) + sum(model.step[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        best = max(itertools.product(range(6), repeat=n), key=score)
        assert score(chat_format.viterbi(model, codes, -1, -1)) == pytest.approx(score(best))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_agree_with_whole(spark, model, monkeypatch, block):
    rng = np.random.default_rng(1)
    rows = [(c, t, " ".join(["word"] * int(rng.integers(1, 60))) + ("\nmore" * int(rng.integers(0, 3)))) for c in (1, 2, None) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, part long, text string")
    lines = chat_format.lines_of(df)
    monkeypatch.setattr(chat_format, "BLOCK", block)
    got = chat_format.decode(lines, model).toPandas().sort_values(["conv_id", "part", "line"])
    whole = lines.toPandas().sort_values(["conv_id", "part", "line"])
    for c in (1, 2, None):
        a, b = (x[x.conv_id.isna()] if c is None else x[x.conv_id == c] for x in (got, whole))
        want = chat_format.viterbi(model, b.code.to_numpy(), -1, -1)
        assert a.role.tolist() == [chat_format.ROLES[s // 2] for s in want] and a.begins.tolist() == [s % 2 == 0 for s in want]


def test_markers_name_roles(spark, model):
    text = "System: be brief\n\nHuman: hello there\nsecond line\n\nassistant: hi\n\n### Instruction manual: x\n\n<|user|> bye\n\n**AI:** so long"
    p = chat_format.format_transcripts(spark.createDataFrame([(1, 0, text)], "conv_id long, part long, text string"), model).toPandas().sort_values("turn")
    assert p.role.tolist() == ["system", "user", "assistant", "system", "user", "assistant"]
    assert p.text.tolist() == ["be brief", "hello there\nsecond line", "hi", "x", "bye", "so long"]
    assert p.rendered.iloc[1] == "<|user|>\nhello there\nsecond line\n<|end|>"


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    p = queries.op2_chat_format(spark, sf).toPandas()
    t = duckdb.sql(f"select conv_id, turn as first_part, role as said, text as whole from '{sf}/conversations.parquet'").df()
    m = t.merge(p, how="left", on=["conv_id", "first_part"])
    assert (m.said == m.role)[m.held_out.fillna(False).astype(bool)].mean() > 0.9
    assert len(p) == len(t) and (m.whole == m.text).mean() > 0.95
    for _, g in p.groupby("conv_id"):
        assert sorted(g.turn) == list(range(len(g)))


def test_odd_rows(spark, model):
    rows = [(1, 9, None, "x", "user", 1), (1, 9, 0, None, None, 1), (1, 9, 0, "", "user", 1), (2, 9, 0, " \n\t\n", "odd", 1), (None, 9, 0, "q", "user", 1), (1, 9, 3, "tie", "user", 1), (1, 9, 3, "tie", "user", 1), (3, 9, 0, "w " * 50_000, "assistant", 1)]
    df = spark.createDataFrame(rows, CONV)
    p = chat_format.format_transcripts(df, model).toPandas()
    assert p.n_lines.sum() == 5 and set(p.conv_id.dropna()) == {1, 3}
    assert chat_format.format_transcripts(df.limit(0), model).count() == 0
    assert chat_format.format_transcripts(df, chat_format.fit(df.limit(0))).count() > 0


@pytest.mark.parametrize(("block", "size"), [(64, 1), (64, 3), (2, 2), (64, 4096)])
def test_cut_blocks_agree_with_whole(spark, model, monkeypatch, block, size):
    """Runs of many lines are cut; states, turn numbers and counted moves are those of the whole conversation."""
    rng = np.random.default_rng(2)
    text = lambda: " ".join(["word"] * int(rng.integers(1, 60))) + "\nmore\n\nstill" * int(rng.integers(0, 4))
    rows = [(c, t, text()) for c in (1, 2, None) for t in (None, *range(9), 5, 300)]
    df = spark.createDataFrame(rows, "conv_id long, part long, text string")
    monkeypatch.setattr(chat_format, "BLOCK", block)
    monkeypatch.setattr(chat_format, "LINES", size)
    lines = chat_format.lines_of(df)
    whole = lines.toPandas().sort_values(["part", "copy", "repeat", "line"])
    decoded = chat_format.decode(lines, model)
    got = decoded.toPandas().sort_values(["part", "copy", "repeat", "line"])
    turns = chat_format.turns_of(decoded).toPandas()
    pairs = {}
    for c in (1, 2, None):
        a, b, t = (x[x.conv_id.isna()] if c is None else x[x.conv_id == c] for x in (got, whole, turns))
        want = chat_format.viterbi(model, b.code.to_numpy(), -1, -1)
        assert [2 * chat_format.ROLES.index(r) + (not f) for r, f in zip(a.role, a.begins, strict=True)] == want
        begins = [s % 2 == 0 for s in want]
        assert sorted(t.turn) == list(range(sum(begins)))
        assert t.sort_values("turn").n_lines.tolist() == np.bincount(np.cumsum(begins) - 1).tolist()
        for pair in zip([None, *b.code], b.code):
            pairs[pair] = pairs.get(pair, 0) + 1
    moved = chat_format.moves_of(chat_format.blocked(lines).withColumnRenamed("code", "state")).collect()
    assert {(r["before"], r["state"]): r["count"] for r in moved} == pairs


def test_fit_counts(spark):
    """Start and step counts against a plain walk over the same lines."""
    rows = [(c, t, "a b c\nd e" if t % 3 else "x", ("user", "assistant", "system", "odd", None)[(c + t) % 5]) for c in range(8) for t in range(11)]
    m = chat_format.fit(spark.createDataFrame(rows, "conv_id long, part long, text string, role string"))
    start, step = np.ones(6), np.ones((6, 6))
    for c in range(8):
        before = None
        for t in range(11):
            role = rows[c * 11 + t][3]
            for k in range(rows[c * 11 + t][2].count("\n") + 1) if role in chat_format.ROLES else ():
                state = 2 * chat_format.ROLES.index(role) + (k > 0)
                if before is None:
                    start[state] += 1
                else:
                    step[before, state] += 1
                before = state
    assert np.allclose(m.start[::2], np.log(start / start.sum())[::2])
    seen = m.step > -1e8
    assert np.allclose(m.step[seen], np.log(step / step.sum(axis=1, keepdims=True))[seen])


def test_very_many_equal_parts(spark, model):
    """No block is larger than its bound, however often a part repeats; each repeat is a whole."""
    rows = [(1, 0, "first line\nsecond line\n\nthird", k) for k in range(6000)] + [(1, 1, "an end", 0)]
    df = spark.createDataFrame(rows, "conv_id long, part long, text string, n long").repartition(5).drop("n")
    lines = chat_format.blocked(chat_format.lines_of(df))
    assert lines.groupBy("conv_id", "block").count().agg({"count": "max"}).first()[0] <= chat_format.LINES
    turns = chat_format.format_transcripts(df, model).toPandas()
    assert turns.n_lines.sum() == 18_001 and turns.turn.nunique() == len(turns)
    assert "".join(turns.sort_values("turn").text.str.replace("\n", "")) == "first linesecond linethird" * 6000 + "an end"
