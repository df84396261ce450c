"""Variants that only clipped reads show: by side and kind, and what gives none."""

import random

import pytest

from varloom.operators import clipcalls as cc

rng = random.Random(7)
REF = "".join(rng.choice("ACGT") for _ in range(30_000))
NEW = "".join(rng.choice("ACGT") for _ in range(300))
TURN = str.maketrans("ACGT", "TGCA")
ROWS = "qname string, chrom string, start long, end long, cigar string, seq string, sa string"


def turned(text):
    return text.translate(TURN)[::-1]


# What a read passes at 10,000: aligned up to there or from the next base on, clipped beyond it.
PASSED = {
    "INS": (REF[:10_000] + NEW + REF[10_000:], 10_000, 10_300, 10_001),
    "DEL": (REF[:10_000] + REF[10_800:], 10_000, 10_000, 10_801),
    "DUP": (REF[:10_000] + REF[9_200:], 10_000, 10_000, 9_201),
    "INV": (REF[:10_000] + turned(REF[10_000:10_900]) + REF[10_900:], 10_000, 10_900, 10_901),
}
FOUND = {"INS": (10_001, 10_001, 300), "DEL": (10_001, 10_800, -800), "DUP": (9_201, 10_000, 800), "INV": (10_001, 10_900, 900)}


@pytest.mark.parametrize("kind", sorted(PASSED))
def test_settle(kind):
    text, left_end, right_from, resumes = PASSED[kind]
    for side, pos, tail in (("R", 10_000, text[left_end : left_end + 900]), ("L", resumes, text[right_from - 900 : right_from][::-1])):
        got = cc.settle(tail, side, pos, REF[4_999:20_000], 5_000, 20)
        assert got is not None, (kind, side)
        assert (got[0], got[1], got[3]) == FOUND[kind] and got[2] == kind
        assert got[4] == (NEW if kind == "INS" else None)
    assert cc.settle(NEW * 3, "R", 10_000, REF[4_999:20_000], 5_000, 20) is None
    assert cc.settle("", "R", 10_000, REF[4_999:20_000], 5_000, 20) is None


def table(spark, kind, sa=None):
    text, left_end, right_from, resumes = PASSED[kind]
    rows = []
    for k in range(6):
        tail, head = text[left_end : left_end + 700 + 10 * k], text[right_from - 700 - 10 * k : right_from]
        rows.append((f"r{k}", "c", 9_001, 10_000, f"1000M{len(tail)}S", REF[9_000:10_000] + tail, sa))
        rows.append((f"l{k}", "c", resumes, resumes + 999, f"{len(head)}S1000M", head + REF[resumes - 1 : resumes + 999], sa))
    rows += [("x", None, None, None, None, None, None), ("h", "c", 9_001, 10_000, "1000M500H", REF[9_000:10_000], None)]
    rows += rows[:1]  # a repeated row is one read
    return spark.createDataFrame(rows, ROWS)


def calls(spark, rows, contig="c"):
    tiles = spark.createDataFrame([("c", i, 10_000 * i + 1, REF[10_000 * i : 10_000 * i + 10_000]) for i in range(3)], "chrom string, tile int, start long, seq string")
    regions = spark.createDataFrame([(contig, 9_000, 11_000)], "chrom string, start long, end long")
    return cc.clip_calls(rows, regions, tiles, 10_000, 3, 20, 100_000, reach=5_000)


@pytest.mark.parametrize("kind", sorted(PASSED))
def test_both_sides_are_one_call(spark, kind):
    got = calls(spark, table(spark, kind)).collect()
    assert [(r.start, r.end, r.sv_len, r.svtype, r.support) for r in got] == [(*FOUND[kind], kind, 12)]
    assert got[0].reads == sorted(f"{s}{k}" for s in "lr" for k in range(6))
    assert got[0].alt_seq == (NEW if kind == "INS" else None)


def test_nothing_to_call(spark):
    rows = table(spark, "DEL")
    assert calls(spark, rows, "d").count() == 0
    assert calls(spark, rows.limit(0)).count() == 0
    assert calls(spark, table(spark, "DEL", sa="c,1,+,10M,60,0;")).count() == 0
    assert calls(spark, rows.filter("qname in ('r0', 'r1')")).count() == 0


def test_own_depth(spark):
    c = spark.createDataFrame([(1, "c", 1000, 2, ["a", "z"]), (2, "c", 5000, 1, ["a"])], "region_id long, chrom string, start long, support int, reads array<string>")
    a = spark.createDataFrame([("c", 900, 999, "a"), ("c", 900, 1100, "b"), ("c", 900, 1200, "b")], "chrom string, start long, end long, qname string")
    assert {(r.region_id, r.dp) for r in cc.own_depth(c, a).collect()} == {(1, 3), (2, 1)}
