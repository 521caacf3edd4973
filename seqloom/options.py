"""Options of an alignment run. Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    # Seeding.
    min_seed_len: int = 19
    kmer: int = 14
    step: int = 1  # lattice of match lengths: 1, or 2 for pairs of bases
    seed_cap: int = 2000  # most occurrences of a first-phase seed; 0: no cap
    max_mem_intv: int = 20
    split_factor: float = 1.5
    split_width: int = 10
    choose_strand: bool = True
    fixed_pivots: int = 3
    min_gap: int = 5
    gap_step: int = 4
    both_strands: bool = False
    gap_early_exit: bool = True
    use_fixed_pivots: bool = False
    max_occ: int = 500
    # Chaining.
    band: int = 100
    max_chain_gap: int = 10000
    min_chain_weight: int = 0
    mask_level: float = 0.5
    drop_ratio: float = 0.5
    max_chain_extend: int = 1 << 30
    weak_chains: int = 0  # over so many chains, weak new ones are dropped; 0: never
    weak_len: int = 60
    weak_occ: int = 0  # and only if seeds have so many occurrences
    # Scores.
    match: int = 1
    mismatch: int = 4
    o_del: int = 6
    o_ins: int = 6
    e_del: int = 1
    e_ins: int = 1
    clip5: int = 5
    clip3: int = 5
    zdrop: int = 100
    # Selection and output.
    min_score: int = 30
    redundant: float = 0.95
    xa_drop: float = 0.8
    max_xa: int = 5
    max_xa_alt: int = 200
    mapq_len: int = 50
    unpaired: int = 17
    max_ins: int = 10000
    max_rescue: int = 50
    rescue: bool = True
    pairing: bool = True
    smart_pairing: bool = False
    all_hits: bool = False
    soft_clip: bool = False
    split_as_secondary: bool = False
    primary5: bool = False
    keep_mapq: bool = False
    ignore_alt: bool = False
    append_comment: bool = False
    chunk_pairs: int = 100_000
    read_group: str | None = None
    header_lines: tuple[str, ...] = ()

    def with_match(self, match: int) -> Options:
        """Another match score scales all other scores that were left at their defaults."""
        own, factor = Options(), match
        scaled = {n: getattr(self, n) * factor for n in ("mismatch", "o_del", "o_ins", "e_del", "e_ins", "clip5", "clip3", "zdrop", "min_score", "unpaired") if getattr(self, n) == getattr(own, n)}
        return replace(self, match=match, **scaled)

    @staticmethod
    def preset(name: str) -> Options:
        """Settings for contigs against a genome, and for two kinds of long noisy reads."""
        if name == "intractg":
            return Options(o_del=16, o_ins=16, mismatch=9, clip5=5, clip3=5)
        if name in ("pacbio", "pbref"):
            return Options(o_del=1, o_ins=1, e_del=1, e_ins=1, mismatch=1, split_factor=10.0, min_chain_weight=40, min_seed_len=17, clip5=0, clip3=0)
        if name == "ont2d":
            return Options(o_del=1, o_ins=1, e_del=1, e_ins=1, mismatch=1, split_factor=10.0, min_chain_weight=20, min_seed_len=14, clip5=0, clip3=0)
        raise ValueError(f"there is no preset {name}")
