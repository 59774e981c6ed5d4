"""Packed values against a plain scanner of the same rules."""

import random

import pytest

from quillgraph.operators.values import delimiter_scores, split_ids, split_values

SEPARATORS = ",，;；、|｜/／"
CLOSE = {"(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "“": "”", '"': '"'}


def scan(text):
    """Pieces by one pass over the characters."""
    out, cur, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c in CLOSE and (j := text.find(CLOSE[c], i + 1)) > 0:
            cur += text[i : j + 1]
            i = j + 1
        elif c in SEPARATORS and not (0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()):
            out.append(cur)
            cur, i = "", i + 1
        else:
            cur += c
            i += 1
    out.append(cur)
    done = []
    for p in out:
        p = p.strip()
        for a, b in (('"', '"'), ("“", "”")):
            if len(p) >= 2 and p[0] == a and p[-1] == b and a not in p[1:-1] and b not in p[1:-1]:
                p = p[1:-1].strip()
        if p:
            done.append(p)
    return done if len(done) >= 2 else []


def rows(spark, values):
    df = spark.createDataFrame([(i, "s", v, "x", 7) for i, v in enumerate(values)], "k long, src string, v string, val string, pos int")
    got = {}
    for r in split_values(df, "k", "src", "v").orderBy("row_key", "pos").collect():
        got.setdefault(int(r.row_key), []).append((r.pos, r.val))
    return got


def test_against_scanner(spark):
    rnd = random.Random(5)
    parts = ["头痛", "发热 样", "3,14-醇", "散（术、桂）", '"甲,乙"', "“丙；丁”", "ABC 12", "", " x ", "[a/b]"]
    values = ["".join(rnd.choice(parts) + rnd.choice(["，", ";", " / ", "｜", "、", ",,"]) for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    values += ["甲、乙"] * 40
    got = rows(spark, values)
    for i, v in enumerate(values):
        assert [p for _, p in got.get(i, [])] == scan(v), v
        assert [n for n, _ in got.get(i, [])] == list(range(1, len(scan(v)) + 1))


def test_defined_cases(spark):
    long = "、".join(f"名{i}号" for i in range(5000))
    got = rows(spark, [None, "", "  ", "单", "甲，甲", "，，甲，", "3,14", "(a、b)", '"未闭，合', long])
    assert got == {4: [(1, "甲"), (2, "甲")], 8: [(1, '"未闭'), (2, "合")], 9: [(i + 1, f"名{i}号") for i in range(5000)]}


def test_plain_marks_of_a_source(spark):
    """A mark whose pieces are irregular in a source is an ordinary character there."""
    mixed = [("a", f"长长长长长长长长长名字_{i}/x") for i in range(30)] + [("a", f"甲{i}号；乙{i}号") for i in range(30)]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(mixed)], "k long, src string, v string")
    keys = {int(r.row_key) for r in split_values(df, "k", "src", "v").collect()}
    assert keys == set(range(30, 60))


def test_few_values_show_a_plain_mark(spark):
    """Four values are enough; one odd value is not, and a single long list does not make its delimiter plain."""
    few = [("a", f"长长长长长长长长长名字_{i}/x") for i in range(4)] + [("b", "长长长长长长长长长名字_1/x"), ("b", "甲号/乙号")]
    few += [("c", "甲号；乙号")] * 5 + [("c", "；".join(f"名{i}号" for i in range(500)))]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(few)], "k long, src string, v string")
    keys = {int(r.row_key) for r in split_values(df, "k", "src", "v").collect()}
    assert keys == set(range(4, 12))
    score = {r.source: r for r in delimiter_scores(df, "src", "v").collect()}
    assert score["a"].score == pytest.approx(score["a"].consistency * score["a"].regularity) and score["a"].score < 0.5 < score["b"].score
    assert score["c"].consistency == pytest.approx((5 + 6.4) / 14)


def test_counts_without_consistency(spark):
    """Pieces of one kind whose number varies without any rule are not a list."""
    vals = ["、".join(["名"] * n) for n in (2, 4, 8, 16, 32, 64, 128, 200) for _ in range(3)] + ["甲；乙"] * 3
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(vals)], "k long, src string, v string")
    assert {int(r.row_key) for r in split_values(df, "k", "src", "v").collect()} == {24, 25, 26}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, src string, v string")
    assert split_values(df, "k", "src", "v").count() == 0 and split_ids(df, "k", "v").count() == 0


@pytest.mark.parametrize("v", ['["c_1", "c_2"]', "['c_1','c_2']", "{c_1,c_2}", "c_1 c_2", '"[\\"c_1\\", \\"c_2\\"]"', "c_1；c_2；", '"c_1" ; "c_2"'])
def test_ids(spark, v):
    df = spark.createDataFrame([(1, v), (2, "c_9"), (3, None), (4, "[]")], "k long, v string")
    assert [(r.row_key, r.pos, r.val) for r in split_ids(df, "k", "v").orderBy("pos").collect()] == [("1", 1, "c_1"), ("1", 2, "c_2")]


def test_long_pieces_need_no_deep_stack(spark):
    rows_ = ["甲" * 200_000 + "、乙", "1,2" * 20_000 + "、乙", '"甲"' * 3000 + "、乙"]
    assert {k: len(v) for k, v in rows(spark, rows_).items()} == {0: 2, 1: 2, 2: 2}
    df = spark.createDataFrame([(1, "a-" * 100_000 + "a b")], "k long, v string")
    assert split_ids(df, "k", "v").count() == 2
