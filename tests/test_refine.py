"""Refinement operators on small tables."""

from pyspark.sql import functions as F

from varloom.operators import call, cluster, refine
from varloom.sources import files

SIG = "qname string, chrom string, pos long, op string, len int, seq string"


def test_recount(spark):
    v = spark.createDataFrame([("c", 1000, 1000, "INS", 100), ("c", 5000, 5099, "DEL", -100)], "chrom string, start long, end long, svtype string, sv_len int")
    s = spark.createDataFrame([("a", "c", 1010, "I", 95, None), ("b", "c", 1000, "I", 50, None), ("b", "c", 1050, "I", 45, None), ("d", "c", 1000, "I", 300, None), ("e", "c", 5000, "D", 90, None), ("f", "c", 5000, "I", 100, None)], SIG)
    assert {r.svtype: r.recounted for r in refine.recount_support(v, s).collect()} == {"INS": 2, "DEL": 1}
    assert {(r.qname, r.ins_sum, r.del_sum) for r in refine.sums_by_read(s, ["chrom"]).collect()} == {("a", 95, 0), ("b", 95, 0), ("d", 300, 0), ("e", 0, 90), ("f", 100, 0)}


def test_neighbours(spark):
    s = spark.createDataFrame([("a", "c", 100, "I", 50, "A"), ("a", "c", 130, "I", 40, "C"), ("a", "c", 900, "I", 50, "G"), ("a", "c", 120, "D", 30, None), ("a", "c", 160, "D", 20, None)], SIG)
    got = {(r.op, r.pos, r.len, r.seq, r.members) for r in refine.merge_neighbour_signatures(s, ["qname", "chrom"]).collect()}
    assert got == {("I", 100, 90, "AC", 2), ("I", 900, 50, "G", 1), ("D", 120, 50, "", 2)}
    v = spark.createDataFrame([(1, 0, "c", 10, 20, "DEL", -10, 4), (1, 0, "c", 60, 70, "DEL", -10, 5), (1, 0, "c", 500, 510, "DEL", -10, 5)], "region_id long, cluster_id int, chrom string, start long, end long, svtype string, sv_len int, support int")
    assert {(r.start, r.end, r.sv_len, r.support) for r in refine.merge_neighbour_variants(v).collect()} == {(10, 70, -20, 5), (500, 510, -10, 5)}


def test_half_records(spark):
    t = spark.createDataFrame([("c1", 1000, "c2", 500, 4), ("c2", 505, "c1", 1003, 9), ("c1", 9000, "c2", 500, 2)], "chrom string, start long, chrom2 string, end long, support int")
    assert {(r.chrom, r.start, r.chrom2, r.end, r.support) for r in refine.merge_half_translocations(t).collect()} == {("c1", 1003, "c2", 505, 9), ("c1", 9000, "c2", 500, 2)}


def test_padding_makes_equal_haplotypes_equal(spark):
    ref = "TTTTTGCGCGCAAAAA"
    tiles = spark.createDataFrame([("c", 0, 1, ref)], "chrom string, tile int, start long, seq string")
    pairs = spark.createDataFrame([("c", 6, "GC", 8, "GC"), ("c", 6, "GC", 6, "AT")], "chrom string, pos_a long, seq_a string, pos_b long, seq_b string")
    got = {r.pos_b: (r.comp_a, r.comp_b) for r in refine.padded_pairs(pairs, tiles, 100).collect()}
    assert got == {8: ("GCGC", "GCGC"), 6: ("GC", "AT")}


def test_smoothing(spark):
    runs = spark.createDataFrame([("q", "c", 0, "=", 3, "AAA", None), ("q", "c", 1, "X", 1, "C", "G"), ("q", "c", 2, "I", 1, "T", None), ("q", "c", 3, "D", 2, None, "CC"), ("q", "c", 4, "I", 30, "T" * 30, None), ("q", "c", 5, "D", 40, None, "A" * 40), ("q", "c", 6, "=", 2, "GG", None)], "qname string, chrom string, idx int, op string, len int, run_seq string, ref_run string")
    assert refine.smoothed(runs, 18).first().seq == "AAA" + "G" + "CC" + "T" * 30 + "GG"


def test_split_consensus(spark):
    paf = spark.createDataFrame([("k", 100, 1, 40, "+", "c", 1, 40, "P"), ("k", 100, 141, 180, "+", "c", 41, 80, "P"), ("m", 100, 1, 40, "-", "c", 301, 340, "P"), ("m", 100, 41, 80, "-", "c", 101, 140, "P"), ("k", 100, 50, 60, "+", "c", 900, 910, "S")], "qname string, qlen int, qstart int, qend int, strand string, chrom string, start long, end long, type string")
    got = {(r.qname, r.start, r.end, r.sv_len, r.svtype) for r in refine.split_alignment_indels(paf, 20).collect()}
    assert got == {("k", 41, 41, 100, "INS"), ("m", 141, 300, -160, "DEL")}
    assert refine.outermost(paf.filter("qname = 'k' and type = 'P'")).first().right.end == 80


def test_members(spark):
    head = spark.createDataFrame([("x", q) for q in "abcd"] + [("y", "p")], "cns_id string, qname string")
    cl = spark.createDataFrame([(1, 0, q) for q in "abz"] + [(1, 1, q) for q in "bcd"] + [(2, 0, "p")], "region_id long, cluster_id int, qname string")
    assert {(r.cns_id, r.region_id, r.cluster_id) for r in refine.members_of_groups(head, cl).collect()} == {("x", 1, 1), ("y", 2, 0)}
    assert files.consensus_members(F.lit("a")).__class__.__name__ == "Column"
    assert spark.range(1).select(files.consensus_members(F.lit("cns_1_9_2___q1;q2;")).alias("m")).first().m == ["q1", "q2"]


def test_works(spark):
    g = spark.createDataFrame([(1, "c", 100, 110, "c", 5000, 5010), (2, "c", 100, 110, "d", 5000, 5010)], "group_id long, chrom string, low long, high long, chrom2 string, low2 long, high2 long")
    assert sorted((r.group_id, r.chrom, r.start, r.end) for r in refine.clip_works(g).collect()) == [(1, "c", 100, 5010), (2, "c", 100, 110), (2, "d", 5000, 5010)]
    f = lambda n, c: spark.range(1).select(refine.consensus_flank(F.lit(n), c).alias("x")).first().x
    assert (f(60, False), f(600, False), f(2000, False), f(0, True), f(1500, True), f(10, True)) == (1060, 3600, 8000, 20000, 7500, 5000)


def test_groups(spark):
    sides = spark.createDataFrame([(1, "DUP", 0, "c", 100, 110), (1, "DUP", 1, "c", 900, 910), (2, "DUP", 0, "c", 105, 120), (2, "DUP", 1, "c", 905, 920), (3, "DUP", 0, "c", 100, 101)], "group_id long, svtype string, side_id int, chrom string, start long, end long")
    assert {(r.group_id, r.b_group_id) for r in refine.overlapping_groups(sides).collect()} == {(1, 2), (1, 3)}
    links = spark.createDataFrame([(1, 0, "R", 1, 9), (1, 1, "L", 0, 9), (1, 2, "L", 0, 1)], "group_id long, side_id int, end string, mate_side_id int, support long")
    assert refine.consistent_links(links).count() == 2
    top = spark.createDataFrame([(1, 0, "R", 1, 20), (1, 0, "R", 2, 5), (1, 0, "R", 3, 1)], "group_id long, side_id int, end string, mate_side_id int, support long")
    assert {r.mate_side_id for r in refine.top_mates(top).collect()} == {1, 2}
    turned = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", True), (1, "b", False)], "group_id long, qname string, turned_back boolean")
    assert refine.duplication_number(turned).first().dup_num == 2


def test_zero_runs_grow(spark):
    z = spark.createDataFrame([("c", 100, 200), ("c", 900, 910)], "chrom string, start long, end long")
    r = spark.createDataFrame([("c", 190, 260), ("c", 400, 410)], "chrom string, start long, end long")
    assert sorted((x.start, x.end) for x in refine.extend_zero_runs(z, r).collect()) == [(100, 260), (900, 910)]


def test_clip_signatures_cluster():
    S = cluster.Signature
    reads = {f"a{i}": [S("c", 100 + i, "C", 900, "", "c2")] for i in range(5)} | {f"b{i}": [S("c", 100, "C", 900, "", "c9")] for i in range(4)}
    got = cluster.two_alleles(reads, 3)
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a0"] != got["b0"]
    assert cluster.signatures_match(S("c", 1, "C", 500), S("c", 90, "I", 60)) and not cluster.signatures_match(S("c", 1, "V", 500), S("c", 1, "I", 500))


def test_phase_set_counts(spark):
    calls = spark.createDataFrame([("c:1",), ("c:1",), ("c:9",), (None,)], "ps string")
    assert tuple(call.phase_sets(calls).first()) == (1, 2)


def test_names_of_a_cluster_leave_its_line_behind(spark, tmp_path):
    (tmp_path / "c").write_text("#id\n3\t4\tr1;r2;;r3\n5\t0\t\n")
    found = files.read_clusters(spark, str(tmp_path / "c"))
    assert {(r.file, r.cluster_id, r.qname) for r in found.collect()} == {("c", 3, "r1"), ("c", 3, "r2"), ("c", 3, "r3")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate explode" in x)
    assert plan.index("split(value") > plan.index(generate)


def test_calls_of_one_start_are_settled_by_size(spark):
    schema = "qname string, qstart int, qend int, strand string, chrom string, start long, end long, type string"
    for plus, minus in ((100, 97), (97, 100)):
        paf = spark.createDataFrame([("k", 1, 40, "+", "c", 1, 40, "P"), ("k", 41 + plus, 80 + plus, "+", "c", 41, 80, "P"), ("k", 1, 40, "-", "c", 301, 340, "P"), ("k", 301 + minus, 340 + minus, "-", "c", 1, 40, "P")], schema)
        assert [(r.start, r.sv_len) for r in refine.split_alignment_indels(paf, 20).collect()] == [(41, 97)]
