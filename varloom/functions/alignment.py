"""Pairwise alignment of sequences in NumPy, a row of the table at a time.

Python functions for use inside Arrow functions; ``similarity`` on columns is in ``sequence``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Alignment:
    """``distance`` or score, 0-based half-open place on the target, runs (len, op) with = X I D."""

    score: int
    start: int
    end: int
    runs: tuple[tuple[int, str], ...]

    @property
    def cigar(self) -> str:
        return "".join(f"{n}{op}" for n, op in self.runs)

    @property
    def plain_cigar(self) -> str:
        """With M for both = and X."""
        out: list[list] = []
        for n, op in self.runs:
            op = "M" if op in "=X" else op
            if out and out[-1][1] == op:
                out[-1][0] += n
            else:
                out.append([n, op])
        return "".join(f"{n}{op}" for n, op in out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.upper().encode("utf-32-le"), np.uint32)


def align(query: str, target: str, mode: str = "global", match: int = 0, mismatch: int = -1, gap: int = -1) -> Alignment:
    """Best alignment; the defaults score minus the edit distance.

    ``mode``: global, prefix (the target's end is free) or infix (both its ends are). Equal
    choices prefer the diagonal, then a gap in the target.
    """
    a, b = _codes(query), _codes(target)
    n, m = len(a), len(b)
    columns = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64) if mode == "infix" else gap * columns
    moves = np.zeros((n + 1, m + 1), np.uint8)  # 1 diagonal, 2 insertion (query only), 3 deletion
    moves[0, 1:] = 0 if mode == "infix" else 3
    for i in range(1, n + 1):
        diagonal = row[:-1] + np.where(b == a[i - 1], match, mismatch)
        up = row + gap
        best = up.copy()
        move = np.full(m + 1, 2, np.uint8)
        take = diagonal >= best[1:]
        best[1:][take] = diagonal[take]
        move[1:][take] = 1
        reach = np.maximum.accumulate(best - gap * columns) + gap * columns  # gaps along the row
        move[reach > best] = 3
        row, moves[i] = reach, move
    end = m if mode == "global" else int(np.argmax(row))
    score, i, j, steps = int(row[end]), n, end, []
    while i > 0 or (j > 0 and mode != "infix"):
        move = moves[i, j] if i else 3
        if move == 1:
            steps.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
        elif move == 2:
            steps.append("I")
            i -= 1
        else:
            steps.append("D")
            j -= 1
    runs: list[list] = []
    for op in reversed(steps):
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return Alignment(score, j, end, tuple((k, op) for k, op in runs))


def align_affine(query: str, target: str, match: int = 2, mismatch: int = -4, open: int = -6, extend: int = -1) -> Alignment:
    """Global alignment in which a gap of n costs ``open`` + (n - 1) ``extend``: one gap stays one."""
    a, b = _codes(query), _codes(target)
    n, m = len(a), len(b)
    low = -(10**8)
    columns = np.arange(m + 1)
    core = np.full((n + 1, m + 1), low, np.int32)  # best that ends in a pair or a vertical gap
    down = np.full((n + 1, m + 1), low, np.int32)  # ends in a gap of the target
    best = np.full((n + 1, m + 1), low, np.int32)
    core[0, 0] = 0
    best[0] = np.where(columns == 0, 0, open + extend * (columns - 1))
    for i in range(1, n + 1):
        down[i] = np.maximum(best[i - 1] + open, down[i - 1] + extend)
        core[i] = down[i]
        core[i, 1:] = np.maximum(core[i, 1:], best[i - 1, :-1] + np.where(b == a[i - 1], match, mismatch))
        across = np.maximum.accumulate(core[i].astype(np.int64) - extend * columns)
        best[i] = core[i]
        best[i, 1:] = np.maximum(core[i, 1:], across[:-1] + open - extend + extend * columns[1:])
    steps, i, j = [], n, m
    while i or j:
        if not i:
            steps += ["D"] * j
            break
        if best[i, j] != core[i, j]:  # a gap along the row, from where it pays
            k = j - 1
            while core[i, k] + open + extend * (j - k - 1) != best[i, j]:
                k -= 1
            steps += ["D"] * (j - k)
            j = k
        if j and core[i, j] == best[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            steps.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
            continue
        while True:
            steps.append("I")
            opened = down[i, j] == best[i - 1, j] + open
            i -= 1
            if opened or not i:
                break
    runs: list[list] = []
    for op in reversed(steps):
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return Alignment(int(best[n, m]), 0, m, tuple((k, op) for k, op in runs))


def edit_distance(query: str, target: str, mode: str = "global") -> int:
    return -align(query, target, mode).score


def similarity(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def needleman_wunsch(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[str, str]:
    """Both sequences with dashes where the other goes on alone."""
    out_a, out_b, i, j = [], [], 0, 0
    for n, op in align(a, b, "global", match, mismatch, gap).runs:
        out_a.append("-" * n if op == "D" else a[i : i + n])
        out_b.append("-" * n if op == "I" else b[j : j + n])
        i, j = i + n * (op != "D"), j + n * (op != "I")
    return "".join(out_a), "".join(out_b)


def consistency(a: str, b: str, relief: float = 0.1, run: int = 3) -> float:
    """Share of equal columns of the global alignment; gaps in long runs count a tenth less each."""
    x, y = needleman_wunsch(a, b)
    if not x:
        return 0.0
    same = sum(p == q for p, q in zip(x.upper(), y.upper()))
    eased, length = 0.0, 0
    for p, q in zip(x + "A", y + "A"):
        if p == "-" or q == "-":
            length += 1
            continue
        eased += relief * length if length >= run else 0
        length = 0
    return same / (len(x) - eased)


def anchored(a: str, b: str, anchors: list[tuple[int, int]], k: int) -> tuple[str, str]:
    """Global alignment of long sequences piece by piece between common k-mers (pos in a, pos in b)."""
    out_a, out_b, i, j = [], [], 0, 0
    for p, q in sorted(anchors):
        if p < i or q < j:
            continue
        x, y = needleman_wunsch(a[i:p], b[j:q])
        out_a.append(x + a[p : p + k])
        out_b.append(y + b[q : q + k])
        i, j = p + k, q + k
    x, y = needleman_wunsch(a[i:], b[j:])
    return "".join(out_a) + x, "".join(out_b) + y


def consensus(sequences: list[str], seed: int | None = None) -> str:
    """Majority vote over all sequences aligned to one of them (the one of median length).

    A column keeps its base unless most sequences lack it; an insertion that most share, in
    its most frequent form, goes in.
    """
    if not sequences:
        return ""
    if len(sequences) < 3:
        return sequences[0 if seed is None else seed]
    order = sorted(range(len(sequences)), key=lambda i: (len(sequences[i]), i))
    center = sequences[order[len(order) // 2] if seed is None else seed]
    columns: list[dict[str, int]] = [{} for _ in center]
    extra: list[dict[str, int]] = [{} for _ in range(len(center) + 1)]
    for s in sequences:
        i = j = 0
        for n, op in align(s, center, "global", 2, -2, -2).runs:
            if op in "=X":
                for k in range(n):
                    columns[j + k][s[i + k]] = columns[j + k].get(s[i + k], 0) + 1
            elif op == "I":
                extra[j][s[i : i + n]] = extra[j].get(s[i : i + n], 0) + 1
            else:
                for k in range(n):
                    columns[j + k][""] = columns[j + k].get("", 0) + 1
            i, j = i + n * (op != "D"), j + n * (op != "I")
    out, half = [], len(sequences) / 2
    for k in range(len(center) + 1):
        if sum(extra[k].values()) > half:
            out.append(max(sorted(extra[k]), key=extra[k].__getitem__))
        if k < len(center):
            best = max(sorted(columns[k], key=lambda b: b != center[k]), key=columns[k].__getitem__)
            out.append(best)
    return "".join(out)
