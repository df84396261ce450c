"""The variant pipeline on a genome with planted variants, from files to VCF lines."""

import pytest
from tests.genome import build

from varloom import cli
from varloom.sources import alignments as al
from varloom.sources import files


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    contigs, rows, truth = build()
    (d / "ref.fa").write_text("".join(f">{c} planted\n" + "\n".join(s[i : i + 80] for i in range(0, len(s), 80)) + "\n" for c, s in contigs.items()))
    head = "".join(f"@SQ\tSN:{c}\tLN:{len(s)}\n" for c, s in contigs.items())
    sam = lambda r: "\t".join(map(str, (r[0], r[1], r[2], r[3], r[4], r[5], "*", 0, 0, r[6], "*"))) + (f"\tSA:Z:{r[9]}" if r[9] else "")
    (d / "reads.sam").write_text("@HD\tVN:1.6\n" + head + "".join(sam(r) + "\n" for r in rows))
    return d, contigs, rows, truth


def test_readers(spark, inputs):
    d, contigs, rows, _ = inputs
    got = al.read_sam(spark, str(d / "reads.sam"))
    assert got.count() == len(rows)
    assert {r.chrom: (r.length, r["rank"]) for r in al.read_sam_header(spark, str(d / "reads.sam")).collect()} == {c: (len(s), k) for k, (c, s) in enumerate(contigs.items())}
    fasta = files.read_fasta(spark, str(d / "ref.fa"))
    assert {r.name: r.seq for r in fasta.collect()} == contigs
    assert files.valid_fasta(fasta).first().valid
    tiles = files.reference_tiles(fasta, 10_000)
    spot = spark.createDataFrame([("chr1", 9_990, 10_020)], "chrom string, start long, end long")
    assert files.fetch(tiles, spot, 10_000).first().ref_seq == contigs["chr1"][9_989:10_020]


def test_calls(spark, inputs):
    d, _, _, truth = inputs
    cli.run(spark, cli.parser().parse_args(["all", "--reads", str(d / "reads.sam"), "--reference", str(d / "ref.fa"), "--out", str(d / "out")]))
    calls = files.read_vcf(spark, str(d / "out/vcf/records")).collect()
    for chrom, pos, kind, size, gt in truth:
        near = [c for c in calls if c.chrom == chrom and abs(c.start - pos) <= 20 and c.svtype == ("BND" if kind == "TRA" else kind)]
        assert near, (chrom, pos, kind, calls)
        if size is not None:
            assert abs(abs(near[0].sv_len) - abs(size)) <= 0.05 * abs(size), (near, size)
        if gt:
            assert near[0].gt.replace("|", "/").replace("1/0", "0/1") == gt
    assert len([c for c in calls if c.svtype != "BND"]) == len([t for t in truth if t[2] != "TRA"]), calls
    assert len([c for c in calls if c.svtype == "BND"]) == 2
    header = open(next((d / "out/vcf/header").glob("part-*"))).read()
    assert header.startswith("##fileformat=VCFv4.2") and "#CHROM" in header
