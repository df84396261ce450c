"""A small genome with planted variants, and reads of it whose alignments are known."""

from __future__ import annotations

import random


def build(seed: int = 42, length: int = 60_000, depth: int = 24, read: int = 6_000, error: float = 0.002):
    """(contigs, SAM rows, planted variants).

    chr1: INS 60 hom, INS 400 het, DEL 60 het, DEL 400 hom, tandem DUP 2000 hom (split reads);
    chr2: INV 3000 hom, and a translocation from chr1's end half into chr2;
    chr3: INS 800 hom and DEL 3000 hom, which show only as clips, without SA tags.
    """
    rng = random.Random(seed)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    contigs = {"chr1": bases(length), "chr2": bases(length)}
    planted = [("chr1", 10_000, "INS", bases(60), "1/1"), ("chr1", 18_000, "DEL", 60, "0/1"), ("chr1", 26_000, "INS", bases(400), "0/1"), ("chr1", 34_000, "DEL", 400, "1/1")]
    rows = []
    serial = 0

    def noisy(text: str) -> str:
        out = list(text)
        for i in range(len(out)):
            if rng.random() < error:
                out[i] = rng.choice([b for b in "ACGT" if b != out[i]])
        return "".join(out)

    def indels(text: str) -> tuple[str, list[tuple[int, str]]]:
        """A piece with sequencing errors: substitutions, and indels of one or two bases."""
        out, ops, at = [], [], 0
        while at < len(text):
            step = min(len(text) - at, 1 + int(rng.expovariate(error)))
            out.append(noisy(text[at : at + step]))
            ops.append((step, "M"))
            at += step
            if len(text) - at > 5:
                n = rng.randint(1, 2)
                if rng.random() < 0.5:
                    out.append(bases(n))
                    ops.append((n, "I"))
                else:
                    at += n
                    ops.append((n, "D"))
        return "".join(out), ops

    def emit(chrom: str, start: int, size: int, haplotype: int) -> None:
        """A read that begins at a reference position and crosses the planted indels."""
        nonlocal serial
        ref, at, seq, cigar = contigs[chrom], start, [], []
        while sum(map(len, seq)) < size and at <= len(ref):
            nxt = next((v for v in planted if v[0] == chrom and v[1] >= at and (v[4] == "1/1" or haplotype == 0)), None)
            stop = min(at + size - sum(map(len, seq)) - 1, len(ref), nxt[1] - 1 if nxt else 10**9)
            if stop >= at:
                piece = indels(ref[at - 1 : stop])
                seq.append(piece[0])
                cigar += piece[1]
            at = stop + 1
            if nxt and at == nxt[1] and sum(map(len, seq)) < size - 50:
                if nxt[2] == "INS":
                    seq.append(nxt[3])
                    cigar.append((len(nxt[3]), "I"))
                else:
                    cigar.append((nxt[3], "D"))
                    at += nxt[3]
                planted_here = nxt[1] + 1 if nxt[2] == "INS" else at
                at = at if nxt[2] == "DEL" else at
                stop = min(at + max(1, size - sum(map(len, seq))) - 1, len(ref))
                tail = next((v for v in planted if v[0] == chrom and v[1] > planted_here and (v[4] == "1/1" or haplotype == 0)), None)
                stop = min(stop, tail[1] - 1 if tail else stop)
                piece = indels(ref[at - 1 : stop])
                seq.append(piece[0])
                cigar += piece[1]
                at = stop + 1
            elif nxt and at == nxt[1]:
                break
        text = "".join(seq)
        if len(text) < 200 or cigar[-1][1] != "M":
            return
        serial += 1
        rows.append((f"r{serial}_{haplotype}", 0, chrom, start, 60, "".join(f"{n}{op}" for n, op in cigar), text, None, None, None))

    def split(parts: list[tuple[str, int, int, str]]) -> None:
        """A read made of reference pieces (chrom, start, end, strand), one alignment each."""
        nonlocal serial
        serial += 1
        complement = str.maketrans("ACGT", "TGCA")
        piece = lambda c, s, e, o: contigs[c][s - 1 : e] if o == "+" else contigs[c][s - 1 : e].translate(complement)[::-1]
        texts = [noisy(piece(*p)) for p in parts]
        whole = "".join(texts)
        cigars, at = [], 0
        for (c, s, e, o), t in zip(parts, texts):
            before, after = at, len(whole) - at - len(t)
            at += len(t)
            left, right = (before, after) if o == "+" else (after, before)
            cigars.append("".join(f"{n}{op}" for n, op in ((left, "S"), (len(t), "M"), (right, "S")) if n))
        sa = [f"{c},{s},{o},{g},60,0" for (c, s, e, o), g in zip(parts, cigars)]
        for k, ((c, s, e, o), g) in enumerate(zip(parts, cigars)):
            seq = whole if o == "+" else whole.translate(complement)[::-1]
            rows.append((f"s{serial}", (0 if o == "+" else 16) + (0 if k == 0 else 2048), c, s, 60, g, seq, None, None, ";".join(x for j, x in enumerate(sa) if j != k) + ";"))

    for chrom in contigs:
        for k in range(length * depth // read):
            start = rng.randint(1, length - 300)
            size = min(read, length - start)
            if chrom == "chr1" and start <= 47_000 and start + size >= 43_000:
                continue  # those reads are split ones
            if chrom == "chr2" and (start <= 24_500 and start + size >= 19_500 or start <= 41_000 and start + size >= 39_000):
                continue
            emit(chrom, start, size, k % 2)
    for k in range(16):
        j = rng.randint(1_000, 1_900)
        split([("chr1", 46_000 - 2_000 - j + 1, 46_000, "+"), ("chr1", 44_001, 46_000 + j, "+")])  # tandem duplication of 44,001 to 46,000
        split([("chr2", 20_001 - 1_500 - k, 20_000, "+"), ("chr2", 20_001, 23_000, "-"), ("chr2", 23_001, 24_500 + k, "+")])
        split([("chr1", 55_001 - 2_000 - k, 55_000, "+"), ("chr2", 40_001, 42_000 + k, "+")])
    contigs["chr3"] = bases(30_000)
    ref, novel = contigs["chr3"], bases(800)
    for k in range(30_000 * depth // read):
        start = rng.randint(1, 29_700)
        size = min(read, 30_000 - start)
        if start + size <= 9_500 or start >= 10_500 and start + size <= 17_500 or start >= 21_500:
            emit("chr3", start, size, k % 2)
    for k in range(12):
        for at, resumes, between in ((10_000, 10_001, novel), (18_000, 21_001, "")):
            left, right = noisy(ref[at - 2_000 - k : at]), noisy(ref[resumes - 1 : resumes + 1_999 + k])
            inner = noisy(between)
            after, before = inner + right[: 1_000 + 20 * k], left[-1_000 - 20 * k :] + inner
            rows.append((f"c{at}_{k}_r", 0, "chr3", at - len(left) + 1, 60, f"{len(left)}M{len(after)}S", left + after, None, None, None))
            rows.append((f"c{at}_{k}_l", 0, "chr3", resumes, 60, f"{len(before)}S{len(right)}M", before + right, None, None, None))
    truth = [(c, p, t, len(x) if t == "INS" else -x, g) for c, p, t, x, g in planted] + [("chr1", 44_001, "DUP", 2_000, None), ("chr2", 20_001, "INV", 3_000, None), ("chr1", 55_000, "TRA", None, None), ("chr3", 10_001, "INS", 800, "1/1"), ("chr3", 18_001, "DEL", -3_000, "1/1")]
    return contigs, rows, truth
