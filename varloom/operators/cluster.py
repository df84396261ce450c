"""Alleles of a region: signatures of reads matched, clustered, smoothed and made consensus.

Grouped functions get one region's reads, of which sampling before leaves at most what the
consensus depth allows, however deep the region is.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import fmean, median, pstdev

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import consensus, similarity


@dataclass(frozen=True)
class Signature:
    chrom: str
    pos: int
    op: str
    length: int
    seq: str = ""
    mate: str = ""


@dataclass(frozen=True)
class Matching:
    distance: int = 400
    merged_distance: int = 800
    size_ratio: float = 0.75
    similarity: float = 0.7
    long: int = 20_000
    match: int = 2
    mismatch: int = -5
    open: int = -4
    extend: int = -2


def sizes_match(a: Signature, b: Signature, distance: int, ratio: float) -> bool:
    return a.op == b.op and min(a.length, b.length) >= ratio * max(a.length, b.length) and abs(a.pos - b.pos) < distance


def signatures_match(a: Signature, b: Signature, how: Matching = Matching(), merged: bool = False, memo: dict | None = None) -> bool:
    """Same kind, like size and place; insertions whose bases are known must be similar too.

    Clips match clips of the same mate; a clip matches an indel at its place.
    """
    distance = how.merged_distance if merged else how.distance
    if "C" in (a.op, b.op):
        return abs(a.pos - b.pos) < distance and (a.op != b.op or a.mate == b.mate)
    if a.op == "V" or b.op == "V":
        return a.op == b.op and abs(a.pos - b.pos) < distance and min(a.length, b.length) >= how.size_ratio * max(a.length, b.length)
    if not sizes_match(a, b, distance, how.size_ratio):
        return False
    if a.op != "I" or not a.seq or not b.seq or max(a.length, b.length) > how.long:
        return True
    key = (a.seq, b.seq) if a.seq < b.seq else (b.seq, a.seq)
    if memo is None:
        return similarity(*key) >= how.similarity
    if key not in memo:
        memo[key] = similarity(*key)
    return memo[key] >= how.similarity


def match_profile(a: list[Signature], b: list[Signature], how: Matching = Matching(), free_ends: bool = False, memo: dict | None = None) -> list[int]:
    """1 for each aligned pair of matching signatures, 0 for what stands alone or unlike.

    Global alignment with affine gaps; ``free_ends`` costs nothing to leave the ends over.
    """
    n, m = len(a), len(b)
    if not n and not m:
        return [1]
    low = -(10**9)
    edge = lambda k: 0 if free_ends or not k else how.open + how.extend * (k - 1)
    best = [[low] * (m + 1) for _ in range(n + 1)]
    up, left = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        best[i][0] = edge(i)
    for j in range(m + 1):
        best[0][j] = edge(j)
    hit = [[signatures_match(x, y, how, memo=memo) for y in b] for x in a]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up[i][j] = max(best[i - 1][j] + how.open, up[i - 1][j] + how.extend)
            left[i][j] = max(best[i][j - 1] + how.open, left[i][j - 1] + how.extend)
            best[i][j] = max(best[i - 1][j - 1] + (how.match if hit[i - 1][j - 1] else how.mismatch), up[i][j], left[i][j])
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + (how.match if hit[i - 1][j - 1] else how.mismatch):
            out.append(int(hit[i - 1][j - 1]))
            i, j = i - 1, j - 1
        elif i and (not j or best[i][j] == up[i][j]):
            out.append(0)
            i -= 1
        else:
            out.append(0)
            j -= 1
    return out[::-1]


def match_ratio(a: list[Signature], b: list[Signature], how: Matching = Matching(), memo: dict | None = None) -> float:
    profile = match_profile(a, b, how, memo=memo)
    return sum(profile) / len(profile)


def trimmed(values: list[float], within: float = 3.0) -> list[float]:
    """Values below ``within`` times the mean."""
    mean = fmean(values)
    return [v for v in values if v < within * mean] or values


def inside_deviation(values: list[float], deviations: float = 2.0) -> list[int]:
    """Places of the values within so many standard deviations of the trimmed mean."""
    kept = trimmed(values)
    mean, spread = fmean(kept), pstdev(kept)
    return [i for i, v in enumerate(values) if abs(v - mean) <= deviations * spread or v == mean]


def categories(reads: dict[str, list[Signature]]) -> list[str]:
    """Reads by how common their number of signatures is, then by mean size, large first."""
    counts: dict[int, int] = {}
    for s in reads.values():
        counts[len(s)] = counts.get(len(s), 0) + 1
    size = {q: fmean([x.length for x in s]) if s else 0.0 for q, s in reads.items()}
    return sorted(reads, key=lambda q: (-counts[len(reads[q])], len(reads[q]), -size[q], q))


def seed(reads: dict[str, list[Signature]], names: list[str]) -> str:
    """The read whose summed size is nearest to the trimmed mean of the modal category."""
    counts: dict[int, int] = {}
    for q in names:
        counts[len(reads[q])] = counts.get(len(reads[q]), 0) + 1
    modal = max(sorted(counts), key=counts.__getitem__)
    sums = {q: float(sum(s.length for s in reads[q])) for q in names if len(reads[q]) == modal}
    mean = fmean(trimmed(list(sums.values())))
    return min(sums, key=lambda q: (abs(sums[q] - mean), q))


def two_alleles(reads: dict[str, list[Signature]], minimum: int, how: Matching = Matching()) -> dict[str, int]:
    """Cluster number of each read: 0, 1, or -1 where both alleles fit equally (left out).

    Each read in turn is a provisional seed; reads of equal match ratio to it form groups, the
    two largest seed the alleles. Reads without signatures are in none.
    """
    reads = {q: sorted(s, key=lambda x: (x.pos, x.op, x.length)) for q, s in reads.items() if s}
    if not reads:
        return {}
    memo: dict = {}
    order = categories(reads)
    chosen: list[list[str]] = []
    for first in order:
        ratios = {q: round(match_ratio(reads[q], reads[first], how, memo), 6) for q in order}
        grouped: dict[float, list[str]] = {}
        for q in order:
            grouped.setdefault(ratios[q], []).append(q)
        if len(grouped.get(0.0, [])) > 0.8 * len(order) or (set(grouped) == {0.0, 1.0} and len(grouped[1.0]) == 1 and len(order) > 2):
            continue
        ranked = sorted(grouped.items(), key=lambda g: (-len(g[1]), -g[0]))
        chosen = [g for _, g in ranked if len(g) >= minimum or len(g) >= 0.6 * minimum][:2] or [ranked[0][1]]
        break
    if not chosen:
        return {q: 0 for q in order}
    seeds = [seed(reads, g) for g in chosen]
    loose = Matching(how.distance, how.merged_distance, how.size_ratio, min(how.similarity, 0.8), how.long)
    if len(seeds) == 2 and (match_ratio(reads[seeds[0]], reads[seeds[1]], loose, memo) == 1 or len(chosen[1]) < 0.2 * len(chosen[0])):
        seeds, chosen = seeds[:1], chosen[:1]
    out = {q: k for k, g in enumerate(chosen) for q in g}
    for q in order:
        if q in out:
            continue
        ratios = [match_ratio(reads[q], reads[s], how, memo) for s in seeds]
        if len(seeds) == 1 or ratios[0] != ratios[1]:
            out[q] = max(range(len(seeds)), key=ratios.__getitem__)
            continue
        means = [fmean(match_ratio(reads[q], reads[x], how, memo) for x in g) for g in chosen]
        out[q] = -1 if means[0] == means[1] else max(range(2), key=means.__getitem__)
    return out


def cluster_regions(signatures: DataFrame, minimum: int, how: Matching = Matching()) -> DataFrame:
    """region_id, qname, cluster_id of every read with signatures.

    ``signatures``: region_id, qname, chrom, pos, op, len, seq.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        reads: dict[str, list[Signature]] = {}
        for r in pdf.itertuples(index=False):
            reads.setdefault(r.qname, []).append(Signature(r.chrom, int(r.pos), r.op, int(r.len), r.seq or ""))
        found = two_alleles(reads, minimum, how)
        return pd.DataFrame({"region_id": pdf["region_id"].iloc[0], "qname": list(found), "cluster_id": list(found.values())})

    return signatures.groupBy("region_id").applyInPandas(run, "region_id long, qname string, cluster_id int")


def alleles(signatures: DataFrame, clusters: DataFrame, minimum: int, how: Matching = Matching(), share: float = 0.5) -> DataFrame:
    """Variants that most reads of a cluster carry, called from the reads themselves.

    Signatures of a cluster that match form an event; it is called if enough reads have it. Its
    place is the median, its length the most frequent one within two deviations of the trimmed
    mean (the smallest of equally frequent ones), its sequence the consensus.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n_reads = pdf["qname"].nunique()
        events: list[list] = []
        for r in pdf.sort_values(["pos", "op", "len", "qname"]).itertuples(index=False):
            s = Signature(r.chrom, int(r.pos), r.op, int(r.len), r.seq or "")
            home = next((e for e in events if sizes_match(e[0][1], s, how.distance, how.size_ratio)), None)
            if home is None:
                events.append([(r.qname, s)])
            else:
                home.append((r.qname, s))
        rows = []
        for e in events:
            names = sorted({q for q, _ in e})
            if len(names) < max(share * n_reads, min(minimum, n_reads)):
                continue
            keep = [e[i][1] for i in inside_deviation([float(s.length) for _, s in e])] or [s for _, s in e]
            lengths: dict[int, int] = {}
            for s in keep:
                lengths[s.length] = lengths.get(s.length, 0) + 1
            size = max(sorted(lengths), key=lengths.__getitem__)
            seqs = [s.seq for s in keep if s.seq]
            near = [x for x in seqs if len(x) == size] or seqs
            text = "" if keep[0].op == "D" or not near else consensus(near)
            start = int(median([s.pos for s in keep]))
            rows.append((pdf["region_id"].iloc[0], int(pdf["cluster_id"].iloc[0]), pdf["chrom"].iloc[0], start, start if keep[0].op == "I" else start + size - 1, "INS" if keep[0].op == "I" else "DEL", len(text) or size if keep[0].op == "I" else -size, text or None, len(names), names))
        return pd.DataFrame(rows, columns=["region_id", "cluster_id", "chrom", "start", "end", "svtype", "sv_len", "ins_seq", "support", "reads"])

    rows = signatures.join(clusters.filter("cluster_id >= 0"), ["region_id", "qname"])
    return rows.groupBy("region_id", "cluster_id").applyInPandas(run, "region_id long, cluster_id int, chrom string, start long, end long, svtype string, sv_len int, ins_seq string, support int, reads array<string>")


def consensus_alleles(sequences: DataFrame, min_size: int) -> DataFrame:
    """Variants from each cluster's consensus aligned to the region's reference.

    ``sequences``: region_id, cluster_id, chrom, start (of the window), ref_seq, qname, seq.
    Windows are the caller's to bound: the table of an alignment is the product of the lengths.
    """
    from ..functions.alignment import align_affine

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text, ref, at = consensus(sorted(pdf["seq"])), pdf["ref_seq"].iloc[0], int(pdf["start"].iloc[0])
        rows, i, j = [], 0, 0
        for n, op in align_affine(text, ref).runs:
            if op in "ID" and n >= min_size:
                rows.append((pdf["region_id"].iloc[0], int(pdf["cluster_id"].iloc[0]), pdf["chrom"].iloc[0], at + j, at + j if op == "I" else at + j + n - 1, "INS" if op == "I" else "DEL", n if op == "I" else -n, text[i : i + n] if op == "I" else None, pdf["qname"].nunique(), sorted(set(pdf["qname"]))))
            i, j = i + n * (op != "D"), j + n * (op != "I")
        return pd.DataFrame(rows, columns=["region_id", "cluster_id", "chrom", "start", "end", "svtype", "sv_len", "ins_seq", "support", "reads"])

    return sequences.groupBy("region_id", "cluster_id").applyInPandas(run, "region_id long, cluster_id int, chrom string, start long, end long, svtype string, sv_len int, ins_seq string, support int, reads array<string>")


def incomplete(clusters: DataFrame, called: DataFrame) -> DataFrame:
    """Clusters without any call yet: what the next step of the cascade is for."""
    return clusters.join(called.select("region_id", "cluster_id").distinct(), ["region_id", "cluster_id"], "left_anti")


def low_coverage_support(minimum: int, flanking: Column) -> Column:
    """Fewer supporting reads are asked for where few reads span a region."""
    return F.when(flanking <= 6, 1).when(flanking <= 15, F.least(F.lit(2), F.lit(minimum))).otherwise(minimum)
