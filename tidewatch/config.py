"""Constants that define the semantics, and the run-time settings in place of environment variables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    d_bits: int = 19
    d0: int = 591396864
    hours: int = 168
    min_size: int = 10
    min_pool: int = 40
    pairs: int = 600
    draws: int = 200
    draws2: int = 1000
    draws3: int = 10_000
    screen2: float = 0.1
    screen3: float = 0.01
    residue: float = 0.5
    residue_members: int = 5
    peer_ratio: float = 1.0
    q: float = 0.05
    epsilon: float = 0.75
    min_frac: float = 0.1
    min_samples: int = 5
    fit_cap: int = 12_000
    samples: int = 160
    seed: int = 7

    @property
    def d_size(self) -> int:
        return 1 << self.d_bits


#: For the small test tables.
SMALL = Config(min_size=5, min_pool=10, draws=40, pairs=60)
#: The same blocks and pools, with all draws and pairs.
SMALL_STAGED = Config(min_size=5, min_pool=10)
