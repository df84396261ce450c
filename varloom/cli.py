"""Command line: ``python -m varloom.cli COMMAND --reads F --reference F --out D``.

Commands: det (candidates), cns (allele clusters), call (variants), all, det-cns.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import call, cluster
from .plans import pipeline
from .plans.parameters import PRESETS, tumor
from .plans.storage import release
from .sources import alignments, files, writers

COMMANDS = ("det", "cns", "call", "all", "det-cns")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--reads", required=True, help="SAM or BAM file or folder")
    p.add_argument("--reference", required=True, help="FASTA file")
    p.add_argument("--out", required=True)
    p.add_argument("--preset", choices=sorted(PRESETS), default="ccs")
    p.add_argument("--tumor", action="store_true")
    p.add_argument("--min-size", type=int)
    p.add_argument("--max-size", type=int)
    p.add_argument("--min-mapq", type=int)
    p.add_argument("--min-support", type=int)
    p.add_argument("--sample", default="sample")
    p.add_argument("--include-alt", action="store_true")
    p.add_argument("--include-decoy", action="store_true")
    p.add_argument("--no-phasing", action="store_true")
    p.add_argument("regions", nargs="*", help="chr, chr:a-b or chr1-chr5")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    from .functions.intervals import is_alternative, is_decoy

    p = PRESETS[args.preset]
    p = tumor(p) if args.tumor else p
    p = replace(p, **{k: v for k in ("min_size", "max_size", "min_mapq", "min_support") if (v := getattr(args, k)) is not None})
    reads = (alignments.read_bam if args.reads.endswith(".bam") else alignments.read_sam)(spark, args.reads)
    if not args.include_alt:
        reads = reads.filter(~is_alternative(F.col("chrom")))
    if not args.include_decoy:
        reads = reads.filter(~is_decoy(F.col("chrom")))
    fasta = files.read_fasta(spark, args.reference)
    tiles = files.reference_tiles(fasta, p.tile)
    limits = files.regions(spark, *args.regions) if args.regions else None
    found = pipeline.detect_candidates(reads, tiles, p, limits)
    writers.save_stage(found.indels, f"{args.out}/candidates/indels")
    writers.save_stage(found.clips, f"{args.out}/candidates/clips")
    writers.save_stage(found.groups, f"{args.out}/candidates/groups")
    if args.command == "det":
        return
    if args.command in ("cns", "det-cns"):
        sig = pipeline.region_signatures(found.reads, found.indels, p)
        writers.save_clusters(cluster.cluster_regions(sig, found.estimates.support), f"{args.out}/clusters")
        return
    calls = pipeline.call_variants(reads, tiles, p, found)
    if not args.no_phasing:
        calls = call.phased(calls, found.reads, p.link_reads)
    calls = writers.with_ids(pipeline.with_alleles(calls, tiles, p.tile))
    moved = writers.with_ids(pipeline.translocations(found).withColumn("sv_len", F.lit(None).cast("int")).withColumn("dp", F.col("support")).withColumn("gt", F.lit("./.")).withColumn("ad_ref", F.lit(0)).withColumn("ad_alt", F.col("support")).withColumn("ref", F.lit("N")))
    every = calls.unionByName(writers.breakends(moved), allowMissingColumns=True)
    contigs = [(r.name, r.n) for r in fasta.select("name", F.length("seq").alias("n")).collect()]  # one row a contig
    writers.save_lines(writers.vcf_lines(every), f"{args.out}/vcf", writers.vcf_header(contigs, args.sample))
    writers.save_lines(writers.bed_lines(calls), f"{args.out}/bed", ["\t".join((*writers.BED_COLUMNS, args.sample))])
    writers.save_lines(writers.bedpe_lines(moved), f"{args.out}/bedpe", ["\t".join((*writers.BEDPE_COLUMNS, args.sample))])


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("varloom").getOrCreate()
    run(spark, parser().parse_args(argv))
    release(spark)


if __name__ == "__main__":
    main()
