"""Operators on small tables whose answers can be worked out by hand or by brute force."""

import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions import alignment as pa
from varloom.functions import intervals as iv
from varloom.functions import sequence as sq
from varloom.operators import aggregates as ag
from varloom.operators import breakpoints as bp
from varloom.operators import call, cigar, cluster, dedup, detect, intervals, pileup, sampling, splitreads, windows
from varloom.sources import alignments as al
from varloom.sources import files, writers

ALN = al.SCHEMA


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_sequence_functions(spark):
    r = one(
        spark, a=sq.reverse_complement(F.lit("ACGTNacgtRY")), b=sq.is_homopolymer(F.lit("AAAA")), c=sq.is_homopolymer(F.lit("AAT")), d=sq.similarity(F.lit("kitten"), F.lit("SITTING")), e=sq.similarity(F.lit(""), F.lit("x")),
        f=sq.split_nonempty(F.lit("a;;b;"), ";"), g=sq.is_valid_sequence(F.lit("ACGT\n")), h=sq.matches_base(F.lit("a"), F.lit("R")), i=sq.matches_base(F.lit("c"), F.lit("R")), j=sq.base_at(F.lit("ACGT"), F.lit(1), F.lit(True)),
        k=sq.is_similar(F.lit("kitten"), F.lit("sitting"), 0.5), m=sq.is_similar(F.lit("kitten"), F.lit("sitting"), 0.6), n=sq.subsequence(F.lit("AACCGGTT"), F.lit(3), F.lit(5), F.lit(False)),
    )
    assert r.a == "RYacgtNACGT"
    assert (r.b, r.c, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.m, r.n) == (True, False, 0.0, ["a", "b"], False, True, False, "A", True, False, "CCG")
    assert r.d == pytest.approx(1 - 3 / 7)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=14), st.text("ACGT", max_size=14))
def test_alignment_properties(a, b):
    r = pa.align(a, b)
    assert 0 <= pa.similarity(a, b) <= 1 and pa.edit_distance(a, b) == pa.edit_distance(b, a)
    for q in (r, pa.align_affine(a, b)):
        assert sum(n for n, op in q.runs if op != "D") == len(a) and sum(n for n, op in q.runs if op != "I") == len(b)
    assert pa.edit_distance(a, "TT" + a + "GG", "infix") == 0 and pa.edit_distance(a, a + "GG", "prefix") == 0


def test_minimizers(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    got = one(spark, m=sq.minimizers(F.lit(text), 10, 15)).m
    number = [int("".join(str("ACGT".index(c)) for c in text[i : i + 15]), 4) for i in range(len(text) - 14)]
    want = []
    for i in range(len(number) - 9):
        best = min((number[j], j) for j in range(i, i + 10))
        if best not in want:
            want.append(best)
    assert [(int(x.hash), x.pos) for x in got] == want


def test_interval_predicates(spark):
    n = lambda x: F.lit(x).cast("long")
    r = one(spark, a=iv.overlaps(n(1), n(5), n(5), n(8)), b=iv.overlap_size(n(1), n(5), n(5), n(8)), c=iv.overlaps(n(5), n(1), n(3), n(2)), d=iv.adjacent(n(1), n(5), n(5), n(8)), e=iv.contained(n(2), n(3), n(1), n(4)))
    assert (r.a, r.b, r.c, r.d, r.e) == (True, 0, True, False, True)


def test_merge_and_gaps(spark):
    df = spark.createDataFrame([("c1", 1, 5), ("c1", 5, 8), ("c1", 10, 12), ("c1", 11, 11), ("c2", 1, 2)], "chrom string, start long, end long")
    want = [("c1", 1, 8), ("c1", 10, 12), ("c2", 1, 2)]
    assert sorted((r.chrom, r.start, r.end) for r in intervals.merge(df).collect()) == want
    assert sorted((r.chrom, r.start, r.end) for r in intervals.merge_tiled(df, 4).collect()) == want
    assert [(r.start, r.end) for r in intervals.gaps(df, least=1).collect()] == [(9, 9)]


def test_joins_equal_nested_loops(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), s, s + rng.randint(0, 40), i) for i, s in enumerate(rng.randint(1, 400) for _ in range(120))]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, id long")
    got = {(r.id, r.b_id) for r in intervals.overlap_join(df, df, 16, 3, 2).collect()}
    want = {(x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and x[1] <= y[2] + 2 and y[1] - 3 <= x[2]}
    assert got == want
    few = df.filter("id % 7 = 0")
    semi = {r.id for r in intervals.overlap_join(df, few, 16, how="left_semi").collect()}
    assert semi == {x[3] for x in rows if any(y[3] % 7 == 0 and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for y in rows)}
    assert {r.id for r in intervals.overlap_join(df, few, 16, how="left_anti").collect()} == {x[3] for x in rows} - semi
    deep = intervals.depth(df).collect()
    for p in range(1, 441):
        assert sum(r.depth for r in deep if r.chrom == "a" and r.start <= p <= r.end) == sum(x[0] == "a" and x[1] <= p <= x[2] for x in rows)


def test_cigar(spark):
    df = spark.createDataFrame([("r", 0, "c", 100, 60, "5S10M2I3D7=1X4H", "A" * 25, 1, None, None), ("m", 16, "c", 100, 60, "5S10M2I3D7=1X4H", "A" * 25, 1, None, None)], ALN)
    seg = {r.qname: r for r in splitreads.segments(df).collect()}
    assert (seg["r"].ref_end, seg["r"].query_len, seg["r"].left_clip, seg["r"].left_hard, seg["r"].right_clip, seg["r"].right_hard) == (120, 29, 5, False, 4, True)
    assert (seg["r"].query_start, seg["r"].query_end, seg["m"].query_start, seg["m"].query_end) == (6, 25, 24, 5)
    runs = cigar.aligned_runs(df.filter("qname = 'r'")).orderBy("idx").collect()
    assert [(r.op, r.len, r.rpos, r.qpos) for r in runs] == [("S", 5, 100, 1), ("M", 10, 100, 6), ("I", 2, 110, 16), ("D", 3, 110, 18), ("=", 7, 113, 18), ("X", 1, 120, 25), ("H", 4, 121, 26)]
    assert cigar.split_runs("3S10M2I5M", "4A7^CC3") == [("S", 3), ("=", 4), ("X", 1), ("=", 5), ("I", 2), ("=", 5)]


def test_alignments_of_one_place_stay(spark):
    at = ("r", 0, "c", 100, 60, "5S10M4S", "A" * 19, 1, None, "d,300,+,9S10M,50,0;d,300,+,9S10M,50,0;c,100,+,5S10M4S,60,1;")
    df = spark.createDataFrame([at, (*at[:4], 10, *at[5:])], ALN)
    assert sorted((r.chrom, r.mapq, r.from_sa) for r in splitreads.segments(df).collect()) == [("c", 10, False), ("c", 60, False), ("d", 50, True)]


def test_segments_of_one_place_have_one_order(spark):
    rows = [("r", "c", 100, 119, 1, 20, "+"), ("r", "c", 500, 519, 31, 50, "+"), ("r", "c", 500, 519, 50, 31, "-")]
    schema = "qname string, chrom string, ref_start long, ref_end long, query_start int, query_end int, orient string"
    for order in (rows, rows[::-1]):
        got = splitreads.ordered(spark.createDataFrame(order, schema).coalesce(1)).collect()
        assert {(r["rank"], r.orient, r.rightmost) for r in got if r.ref_start == 500} == {(2, "+", False), (3, "-", True)}


def test_rank_and_previous_segment_are_of_one_order(spark):
    """Equal segments, in sorts that spill: a second sort would deal them anew."""
    rows = [("r", "c", 100 * k, 100 * k + 19, 10 * k, 10 * k + 19, "+", i) for i in range(400) for k in range(3)]
    df = spark.createDataFrame(rows, "qname string, chrom string, ref_start long, ref_end long, query_start int, query_end int, orient string, id int").coalesce(1)
    conf, key = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "50")
    try:
        got = sorted(splitreads.ordered(df).collect(), key=lambda r: r["rank"])
    finally:
        conf.remove(key)
    assert [r["rank"] for r in got] == list(range(1, 1201)) and sorted(r.id for r in got) == sorted(x[7] for x in rows)
    assert [r.prev and r.prev.ref_start for r in got] == [None] + [r.ref_start for r in got[:-1]]
    assert [r["rank"] for r in got if r.leftmost] == [1] and [r["rank"] for r in got if r.rightmost] == [1200]


def test_a_mean_on_the_limit_is_no_outlier(spark):
    """0.7 is 0.6 times the mean of 0.7, 0.8 and 2.0, and as doubles less."""
    rows = [("c", 0, 6, 1), ("c", 10, 17, 1), ("c", 20, 29, 2)]
    found = lambda extra: [(r.start, r.mean) for r in pileup.local_depth_outliers(spark.createDataFrame(rows + extra, "chrom string, start long, end long, depth long")).collect()]
    assert found([]) == []
    assert found([("c", 30, 39, 9)]) == [(0, 0.7), (10, 0.8), (30, 9.0)]


def test_mismatches_from_reference(spark):
    ref = "ACGTACGTACGTACGTACGT"
    tiles = spark.createDataFrame([("c", 0, 1, ref[:10]), ("c", 1, 11, ref[10:])], "chrom string, tile int, start long, seq string")
    df = spark.createDataFrame([("r", 0, "c", 7, 60, "8M", "GTTCGTAC", None, None, None)], ALN)
    got = cigar.mark_mismatches(cigar.aligned_runs(df), tiles, 10).orderBy("rpos").collect()
    assert [(r.op, r.len, r.rpos, r.qpos) for r in got] == [("=", 2, 7, 1), ("X", 1, 9, 3), ("=", 1, 10, 4), ("=", 4, 11, 5)]


def test_pileup_depth(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        a, b, n = rng.randint(3, 20), rng.randint(3, 20), rng.randint(1, 4)
        op = rng.choice("ID")
        rows.append((f"r{i}", 0, "c", rng.randint(1, 100), 60, f"{a}={n}{op}{b}=", "A" * (a + b + (n if op == "I" else 0)), 0, None, None))
    runs = cigar.aligned_runs(spark.createDataFrame(rows, ALN))
    pile = {r.pos: r for r in pileup.pileup(runs, min_ins=1, min_del=1, dense=True).collect()}
    parsed = [(r[3], *map(int, __import__("re").findall(r"\d+", r[5])), "I" if "I" in r[5] else "D") for r in rows]
    for p in range(1, 150):
        depth = sum(s <= p < s + a or s + a + (n if op == "D" else 0) <= p < s + a + (n if op == "D" else 0) + b for s, a, n, b, op in parsed)
        ins = sum(op == "I" and p == s + a for s, a, n, b, op in parsed)
        spread = sum(op == "D" and s + a <= p < s + a + n for s, a, n, b, op in parsed)
        got = pile.get(p)
        assert (got.depth, got.n_ins, got.del_spread) == (depth, ins, spread) if got else depth + ins + spread == 0


def test_disagree_rule(spark):
    r = spark.createDataFrame([(8, 1, 1, 0, 0, 10, "A")], "n_a int, n_c int, n_g int, n_t int, n_n int, depth int, ref string")
    assert r.select(pileup.disagrees().alias("x")).first().x
    assert r.select(pileup.majority_base().alias("x")).first().x == "A"


def test_aggregates(spark):
    r = one(spark, s=ag.min_support(F.lit(40.0)), g=ag.genotype(F.lit(26), F.lit(31)), h=ag.genotype(F.lit(4), F.lit(29)), d=ag.allele_depths(F.lit(26), F.lit(31)), c=ag.compensation(F.lit(100), F.lit(100)))
    assert (r.s, r.g, r.h, r.d, r.c) == (3, "1/1", "0/0", "5,26", 1.5)
    assert ag.mean_depth_of_modal_group([30, 31, 60, 33, 29]) == pytest.approx(30.75)
    w = spark.createDataFrame([(v,) for v in range(1, 101)], "v int")
    assert ag.percentile_by_histogram(w, "v", 0.95, 2).first().estimate == 96


def test_type_votes(spark):
    n = lambda x: F.lit(x)
    r = one(spark, a=splitreads.decide(n(5), n(0), n(3), n(4), n(True), n(0)), b=splitreads.decide(n(5), n(0), n(3), n(4), n(False), n(2000)), c=splitreads.decide(n(0), n(0), n(3), n(4), n(False), n(2000)), d=splitreads.decide(n(1), n(0), n(0), n(4), n(False), n(0)))
    assert (r.a, r.b, r.c, r.d) == ("TRA", "DUP", "UNC", "UNC")


def test_windows(spark):
    df = spark.createDataFrame([("c", p) for p in (1, 2, 3, 7, 8, 30)], "chrom string, pos long")
    assert sorted((r.start, r.end, r.n) for r in windows.runs(df, ["chrom"], "pos").collect()) == [(1, 3, 3), (7, 8, 2), (30, 30, 1)]
    assert sorted((r.start, r.end, r.n) for r in windows.runs_tiled(df, ["chrom"], "pos", 4, 4).collect()) == [(1, 8, 5), (30, 30, 1)]
    regions = spark.createDataFrame([("c", s, s + 10) for s in (1, 900, 1300, 1600, 1880, 5000)], "chrom string, start long, end long")
    assert [r.chunk for r in windows.chunks(regions, ["chrom"]).orderBy("start").collect()] == [1, 1, 1, 1, 1, 2]


def test_redundancy(spark):
    sig = spark.createDataFrame([("r", 100, "I", 50), ("r", 250, "D", 48), ("r", 900, "I", 500), ("r", 1500, "I", 40)], "qname string, pos long, op string, len int")
    kept = dedup.cancel_false_neighbours(sig, ["qname"]).orderBy("pos").collect()
    assert [r.pos for r in kept] == [900, 1500]
    assert [r.pos for r in dedup.drop_small_signatures(sig.filter("pos > 500"), ["qname"]).collect()] == [900]
    v = spark.createDataFrame([("c", 100, 100, "INS", 300, "A" * 300, 5), ("c", 110, 110, "INS", 299, "A" * 299, 9), ("c", 5000, 5000, "INS", 300, "C" * 300, 2)], "chrom string, start long, end long, svtype string, sv_len int, alt string, support int")
    assert [r.start for r in dedup.near_duplicate_neighbours(v, ["chrom"], ["start"], dedup.same_variant() & dedup.same_sequence(), "support").orderBy("start").collect()] == [110, 5000]
    assert [r.start for r in dedup.not_already_known(v, v.filter("start = 100").withColumn("start", F.lit(104).cast("long"))).orderBy("start").collect()] == [5000]


def test_sampling_keeps_reads_whole(spark):
    rows = [("k", f"r{i % 30}", 1, 100) for i in range(60)]
    got = sampling.sample_reads(spark.createDataFrame(rows, "key string, qname string, start long, end long"), ["key"], 10.0).groupBy("qname").count().collect()
    assert {r["count"] for r in got} == {2} and 4 <= len(got) <= 6


def test_depth_limits(spark):
    rows = [(f"r{i}", "c", 10, 1009) for i in range(400)] + [(f"s{i}", "c", 250_000, 250_999) for i in range(20)]
    df = spark.createDataFrame(rows, "qname string, chrom string, start long, end long")
    assert al.skip_ultra_deep(df, 3.0).count() == 20
    got = sampling.limit_depth(df, 1.0)
    assert got.filter("start = 10").count() == 100 and got.filter("start > 10").count() == 20


def test_dense_reads(spark):
    rows = [("a", 0, "c", 1, 60, "500M20D500M", "A" * 1000, 0, None, None), ("b", 0, "c", 1, 60, "10M30I" * 20 + "10M", "A" * 900, 0, None, None)]
    df = al.with_ends(spark.createDataFrame(rows, ALN))
    assert [r.qname for r in al.drop_dense_reads(df, 15.0).collect()] == ["a"]
    cover = al.local_coverage(df, ["chrom"]).first()
    assert (cover.bases, cover.reads, cover.span, cover.coverage) == (1900, 2, 1020, 4 * 1900 / 1020)


def test_user_regions(spark):
    df = spark.createDataFrame([("c", 10, 20, 15), ("c", 100, 120, 110), ("d", 5, 6, 5)], "chrom string, start long, end long, pos long")
    limits = spark.createDataFrame([("c", 15, 105), ("d", None, None)], "chrom string, start long, end long")
    ask = lambda mode: sorted(r.start for r in intervals.in_regions(df, limits, mode).collect())
    assert (ask("overlap"), ask("contained"), ask("point")) == ([5, 10, 100], [5], [5, 10])


def test_two_alleles():
    S = cluster.Signature
    reads = {f"a{i}": [S("c", 100 + i, "I", 60)] for i in range(6)} | {f"b{i}": [S("c", 100, "I", 400)] for i in range(5)} | {"n": []}
    got = cluster.two_alleles(reads, 3)
    assert {got[f"a{i}"] for i in range(6)} == {0} and {got[f"b{i}"] for i in range(5)} == {1} and "n" not in got
    assert cluster.match_profile(reads["a0"], reads["b0"]) in ([0], [0, 0]) and cluster.match_ratio(reads["a0"], reads["a1"]) == 1


def test_all_reads_of_a_cluster_vote(spark):
    import random

    r = random.Random(7)
    ref, extra = "CG" + "".join(r.choice("ACGT") for _ in range(150)), "".join(r.choice("ACGT") for _ in range(60))
    whole = ref[:80] + extra + ref[80:]
    # The first 15 in alphabetical order lack what most have.
    rows = [(1, 0, "c", 1, ref, f"q{i}", "A" + ref if i < 15 else whole) for i in range(35)]
    got = cluster.consensus_alleles(spark.createDataFrame(rows, "region_id long, cluster_id int, chrom string, start long, ref_seq string, qname string, seq string"), 50).collect()
    assert [(x.svtype, x.sv_len) for x in got] == [("INS", 60)]
    long = "".join(r.choice("ACGT") for _ in range(2_100))
    for text, n in ((extra, 15), (long, 1)):
        wrong = text[:30] + {"A": "C", "C": "G", "G": "T", "T": "A"}[text[30]] + text[31:]
        seqs = [wrong] * n + [text] * (n + 3)
        sig = spark.createDataFrame([(1, f"q{i:02}", "c", 100, "I", len(x), x) for i, x in enumerate(seqs)], "region_id long, qname string, chrom string, pos long, op string, len int, seq string")
        members = spark.createDataFrame([(1, f"q{i:02}", 0) for i in range(len(seqs))], "region_id long, qname string, cluster_id int")
        assert [x.ins_seq for x in cluster.alleles(sig, members, 3).collect()] == [text]


def test_phase_links(spark):
    t = "variant_id long, chrom string, start long, reads array<string>, others array<string>"
    rows = [(1, "c", 10, ["a", "b", "x"], ["d", "e"]), (2, "c", 20, ["a", "b", "y"], ["f"]), (3, "c", 30, ["d", "e", "f"], ["a", "b", "y"])]
    got = {r.variant_id: (r.linked, r.flips) for r in call.links_between(spark.createDataFrame(rows, t)).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, True)}


def test_link_text_round_trip(spark):
    rows = spark.createDataFrame([(7, 0, "R", 1, True, 55, 4, 9), (7, 1, "L", 0, True, 91, 4, 9)], "group_id long, side_id int, end string, mate_side_id int, same_orient boolean, pos long, support long, coverage long")
    text = bp.link_text(rows)
    assert {r.text for r in text.collect()} == {"1+|55|4|9,-", "-,0+|91|4|9"}
    assert sorted(bp.parse_links(text).collect()) == sorted(rows.collect())
    assert bp.support_and_coverage(rows).first()[1:] == (4, 9)


def test_region_arguments():
    assert files.parse_region("chr1:1k-2m") == ("chr1", 1000, 2_000_000) and files.parse_region("chrX") == ("chrX", None, None)
    assert files.expand_contigs("chr22-chrY") == ["chr22", "chrX", "chrY"] and files.expand_contigs("chr3-chr1") == ["chr1", "chr2", "chr3"]
    with pytest.raises(ValueError):
        files.parse_region("chr1:9-2")
    with pytest.raises(ValueError):
        files.expand_contigs("chr1-2")


def test_vcf_reader(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nchr1\t5\tDEL.1\tACG\tA\t.\tPASS\tEND=7;SVTYPE=DEL;SVLEN=-2;DP=31;AF=0.839;FLAG\tGT:AD:DP\t1|1:5,26:31\nchr1\t9\tBND.1\tN\tN]chr2:77]\t.\tPASS\tSVTYPE=BND\n")
    a, b = files.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("start").collect()
    assert (a.end, a.svtype, a.sv_len, a.dp, a.gt, a.ad) == (7, "DEL", -2, 31, "1|1", "5,26")
    assert (b.bnd.mate_chrom, b.bnd.mate_pos, b.bnd.base_first, b.dp, b.gt) == ("chr2", 77, True, None, None)


def test_paf_and_bed_readers(spark, tmp_path):
    (tmp_path / "a.paf").write_text("q\t100\t0\t90\t+\tchr1:501-900___l___r\t400\t10\t95\t80\t90\t60\ttp:A:P\tcg:Z:50M5D40M\n")
    r = files.read_paf(spark, str(tmp_path / "a.paf")).first()
    assert (r.chrom, r.start, r.end, r.qstart, r.type, r.cigar) == ("chr1", 511, 595, 1, "P", "50M5D40M")
    (tmp_path / "a.bed").write_text("# c\nchr1\t5\t9\nchr2\n")
    assert sorted(tuple(x) for x in files.read_bed_regions(spark, str(tmp_path / "a.bed")).collect()) == [("chr1", 5, 9), ("chr2", None, None)]


def test_bam_reader(spark, tmp_path):
    def record(name, ref, pos, flag, cigar, seq, tags):
        ops, code = [], "MIDNSHP=X"
        for n, op in cigar:
            ops.append(n << 4 | code.index(op))
        nib = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes(nib[i] << 4 | nib[i + 1] for i in range(0, len(nib), 2)) + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data += record("r1", 0, 11, 0, [(4, "M"), (1, "I"), (2, "M")], "ACGTNAC", b"NMC\x01MDZ4C1\0SAZchr1,50,+,3S4M,60,0;\0") + record("r2", 0, 20, 16, [(3, "=")], "ACG", b"XBBc\x02\0\0\0\x01\x02NMi\x05\0\0\0")

    def block(x):
        d = zlib.compressobj(6, zlib.DEFLATED, 31)
        return d.compress(x) + d.flush()

    (tmp_path / "a.bam").write_bytes(block(data[:60]) + block(data[60:]) + block(b""))
    a, b = al.read_bam(spark, str(tmp_path / "a.bam")).orderBy("qname").collect()
    assert tuple(a) == ("r1", 0, "chr1", 11, 60, "4M1I2M", "ACGTNAC", 1, "4C1", "chr1,50,+,3S4M,60,0;")
    assert (b.flag, b.pos, b.seq, b.nm, b.md) == (16, 20, "ACG", 5, None)


def bam_record(rng, k, ref, pos):
    n = rng.randint(1, 400)
    seq = [rng.choice((1, 2, 4, 8)) for _ in range(n)]
    name = f"read{k}".encode()
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, 1, 0, n, -1, -1, 0) + name + b"\0" + struct.pack("<I", n << 4)
    nib = seq + [0] * (n % 2)
    body += bytes(nib[i] << 4 | nib[i + 1] for i in range(0, len(nib), 2)) + b"\xff" * n + b"NMC" + bytes([k % 200])
    return struct.pack("<i", len(body)) + body, (f"read{k}", ("c1", "c2")[ref], pos, f"{n}M", "".join("=ACMGRSVTWYHKDBN"[x] for x in seq), k % 200)


def blocked_gzip(data, size):
    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        d = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[at : at + size]
        raw = d.compress(part) + d.flush()
        out += bytes((31, 139, 8, 4, 0, 0, 0, 0, 0, 255, 6, 0, 66, 67, 2, 0)) + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_over_several_splits(spark, tmp_path):
    """Records that cross blocks and splits, two files, and regions by an index."""
    rng = random.Random(11)
    want = []
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + c + b"\0" + struct.pack("<i", 9_000) for c in (b"c1", b"c2"))
    for f in range(2):
        data = head
        for k in range(400):
            raw, row = bam_record(rng, 1000 * f + k, int(k >= 200), 1 + 20 * (k % 200))
            data += raw
            want.append(row)
        (tmp_path / f"{f}.bam").write_bytes(blocked_gzip(data, 700))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = al.read_bam(spark, str(tmp_path), with_place=True).cache()
        assert rows.select("path", "split").distinct().count() > 8
        plain = lambda df: sorted((r.qname, r.chrom, r.pos, r.cigar, r.seq, r.nm) for r in df.collect())
        assert plain(rows) == sorted(want)
        assert {(r.chrom, r.length, r["rank"]) for r in al.read_bam_header(spark, str(tmp_path)).collect()} == {("c1", 9_000, 0), ("c2", 9_000, 1)}
        index = al.index_bam(spark, str(tmp_path)).cache()
        limits = spark.createDataFrame([("c1", 500, 900), ("c2", 3_900, None)], "chrom string, start long, end long")
        inside = [w for w in want for c, a, b in (("c1", 500, 900), ("c2", 3_900, 10**9)) if w[1] == c and w[2] <= b and w[2] + len(w[4]) - 1 >= a]
        assert plain(al.read_bam(spark, str(tmp_path), index, limits)) == sorted(inside)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_homopolymers_across_stretches(spark):
    ref = spark.createDataFrame([("c", 0, 99_998, "AACCGTTA")], "chrom string, tile int, start long, seq string")
    got = {r.pos: r.polymer for r in pileup.homopolymers(pileup.reference_bases(ref)).collect()}
    assert got == {99_998: True, 99_999: True, 100_000: True, 100_001: True, 100_002: False, 100_003: True, 100_004: True, 100_005: False}


def test_records_near_each_other(spark):
    t = "chrom string, start long, chrom2 string, end long, svtype string, support int"
    rows = [("a", 1060, "b", 100, "TRA", 3), ("a", 1061, "b", 101, "TRA", 5), ("a", 1111, "b", 140, "TRA", 4), ("a", 1300, "b", 100, "TRA", 1), ("a", 1062, "b", 400, "TRA", 2)]
    assert sorted(r.support for r in bp.strongest(spark.createDataFrame(rows, t)).collect()) == [1, 2, 5]


def test_writers(spark):
    c = spark.createDataFrame([("chr10", 5, 5, "INS", 3, "A", "ATTT", 9, 0.5, "0/1", 4, 5), ("chr2", 7, 9, "DEL", -3, "ACGT", "A", 9, 1.0, "1/1", 0, 9)], "chrom string, start long, end long, svtype string, sv_len int, ref string, alt string, dp int, af double, gt string, ad_ref int, ad_alt int")
    lines = [r.line for r in writers.vcf_lines(writers.with_ids(c)).collect()]
    assert lines[0] == "chr2\t7\tDEL.1\tACGT\tA\t.\tPASS\tEND=9;SVTYPE=DEL;SVLEN=-3;DP=9;AF=1.0\tGT:AD:DP\t1/1:0,9:9" and lines[1].startswith("chr10")
    t = spark.createDataFrame([("chr1", 5, "R", "chr2", 9, "L", "TRA.1", "N")], "chrom string, start long, end_type string, chrom2 string, end long, end_type2 string, id string, ref string")
    assert sorted((r.id, r.alt, r.mate_id) for r in writers.breakends(t).collect()) == [("TRA.1_1", "N[chr2:9[", "TRA.1_2"), ("TRA.1_2", "]chr1:5]N", "TRA.1_1")]


def test_gate_columns(spark):
    base = {"mean_depth": 30.0, "signatures": 10, "start": 1, "end": 40, "consensus_bases": 1, "large_bases": 1, "zero_bases": 0, "high_bases": 0, "raised_share": 0.0}
    ask = lambda **k: spark.createDataFrame([tuple((base | k).values())], list(base)).select(detect.indel_gate(3, 18).alias("x")).first().x
    assert ask() and not ask(signatures=1) and not ask(mean_depth=1.0, signatures=1)
