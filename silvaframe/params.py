"""Run parameters: defaults, flags, and sizes chosen from the matrix."""

from __future__ import annotations

import argparse
import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class ForestParams:
    trees: int = 1
    depth: int = 1
    samples: int = 1
    in_features: int = 1
    out_features: int = 1
    norm: int = 2
    balance: float = 0.5
    dispersion: str = "sme"
    braids: int = 3
    reduce_input: bool = False
    reduce_output: bool = False
    row_sum_scaling: bool = False
    bag: float = 0.66
    least_side: int = 3
    guard: int = 2
    max_splits: int = 0
    exclude_self: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        if min(self.trees, self.samples, self.in_features, self.out_features) < 1 or self.depth < 0:
            raise ValueError("trees, samples and features must be positive")
        if self.norm not in (1, 2) or self.dispersion not in ("sme", "ssme", "variance", "mad"):
            raise ValueError("norm is 1 or 2; dispersion is sme, ssme, variance or mad")

    def auto(self, rows: int, columns: int) -> ForestParams:
        """Sizes from the matrix: F / log10 F features, a falling share of the rows, log5 N levels."""
        few = max(1, int(min(columns / math.log10(columns), columns))) if columns > 1 else 1
        draw = rows if rows < 10 else 2 * (rows // 3) if rows < 1000 else rows // 2 if rows < 5000 else rows // 4
        return replace(self, trees=100, samples=max(1, draw), in_features=few, out_features=few, depth=max(int(math.log(max(rows, 1), 5)), 2))


def from_flags(argv: list[str]) -> ForestParams:
    """Parameters from command-line flags; unknown flags are an error."""
    p = argparse.ArgumentParser(add_help=False)
    flag = lambda s: s.lower() == "true"
    p.add_argument("-t", "-trees", dest="trees", type=int)
    p.add_argument("-depth", dest="depth", type=int)
    p.add_argument("-ss", dest="samples", type=int)
    p.add_argument("-if", "-ifs", dest="in_features", type=int)
    p.add_argument("-of", "-ofs", dest="out_features", type=int)
    p.add_argument("-n", "-norm", dest="norm", type=lambda s: int(s.lower().lstrip("l")))
    p.add_argument("-sfr", dest="balance", type=float)
    p.add_argument("-dm", "-dispersion_mode", dest="dispersion", type=str.lower)
    p.add_argument("-braid", "-braids", dest="braids", type=int)
    p.add_argument("-ri", "-reduce_input", dest="reduce_input", type=flag)
    p.add_argument("-ro", "-reduce_output", dest="reduce_output", type=flag)
    p.add_argument("-scale", "-scaling", dest="row_sum_scaling", type=flag)
    p.add_argument("-max_splits", dest="max_splits", type=int)
    p.add_argument("-seed", dest="seed", type=int)
    got = {k: v for k, v in vars(p.parse_args(argv)).items() if v is not None}
    return ForestParams(**{f.name: got[f.name] for f in fields(ForestParams) if f.name in got})
