"""Settings of the rating pipeline."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Models: win (early binary outcome) and severity (four ordered classes). Roles: the focal player and its opponents.
MODELS = ("win", "severity")
ROLES = ("Rusher", "Blocker")
CLASSES = ("loss", "win", "pressure", "sack")
#: Smoothing strengths; infinity means the league profile alone.
STRENGTHS = (0.0, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0, 1000.0, math.inf)
THRESHOLDS = (0, 100, 200, 400)
UNKNOWN_QB = "__UNKNOWN_QB__"


@dataclass(frozen=True)
class Params:
    seed: int = 20260916
    folds: int = 5
    train_last_week: int = 15
    last_week: int = 18
    draws: int = 1000
    penalty_max: float = 1.0
    penalty_min: float = 1e-6
    penalties: int = 120
    tolerance: float = 1e-9
    clip: float = 1e-15
    #: Strengths of the fixed comparator and of the season's descriptive scores.
    comparator_strength: dict[str, float] = field(default_factory=lambda: {"win": 25.0, "severity": 50.0})
    season_strength: dict[str, float] = field(default_factory=lambda: {"win": 2.0, "severity": 10.0})
    #: Outcome weights used where none have been learnt: by class, loss 0 and sack 1.
    severity_weights: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)

    def penalty_grid(self) -> list[float]:
        """Log-spaced penalties from the largest to the smallest."""
        top, low, n = math.log(self.penalty_max), math.log(self.penalty_min), self.penalties
        return [math.exp(top + (low - top) * i / (n - 1)) for i in range(n)]


def strength_label(strength: float) -> str:
    return "league_only" if math.isinf(strength) else f"{strength:g}"
