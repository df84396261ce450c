"""Settings of the variant pipeline, with the defaults of each technology's preset."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Parameters:
    min_size: int = 20
    size_factor: float = 0.9
    max_size: int = 100_000
    min_mapq: int = 20
    min_clip: int = 200
    clip_ratio: float = 0.1
    clip_reach: int = 20_000  # bases around a clip region in which its reads' clips are sought
    max_depth: float = 300.0
    consensus_depth: float = 40.0
    size_percentile: float = 0.95
    count_percentile: float = 0.99995
    high_indel: float = 0.6
    hom: float = 0.7
    het: float = 0.2
    allele_similarity: float = 0.9
    match_similarity: float = 0.7
    size_ratio: float = 0.75
    max_density: float = 15.0
    link_reads: int = 3
    min_support: int = 0  # 0: from the depth
    tile: int = 10_000

    @property
    def internal_size(self) -> int:
        """Least signature length inside the pipeline; the final gate is ``min_size``."""
        return round(self.min_size * self.size_factor)


PRESETS = {
    "ccs": Parameters(),
    "clr": Parameters(allele_similarity=0.8, match_similarity=0.6, max_density=100.0),
    "ont": Parameters(allele_similarity=0.8, match_similarity=0.6, max_density=100.0),
}


def tumor(p: Parameters) -> Parameters:
    """Wider density bounds and a lower bar of similarity, for mixed samples."""
    return replace(p, max_density=1.5 * p.max_density, match_similarity=0.85 * p.match_similarity)
