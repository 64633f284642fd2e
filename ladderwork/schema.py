"""Fixed schemas and parameters of the rating engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Order of the fold: date, game, then player inside a game.
FOLD_ORDER = ("game_date", "game_id", "player_id")

UPDATE_SCHEMA = (
    "variant string, game_id long, game_date timestamp_ntz, season long, track string, player_id long, team_id string, "
    "home boolean, share double, s_team double, e_team double, perf double, perf_used double, k_eff double, games_before long, "
    "rating_before double, delta_raw double, zero_mean_offset double, delta double, rating_after double"
)

CHECKPOINT_SCHEMA = T.StructType(
    [
        T.StructField("player_id", T.LongType(), False),
        T.StructField("rating", T.DoubleType(), False),
        T.StructField("games_played", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class RatingParams:
    """One variant of the rating fold; see operators.fold for what each does."""

    variant: str = "base"
    k: float = 45.0
    theta: float = 0.0
    home_advantage: float = 0.0
    rookie_boost: float = 6.0
    rookie_tau: float = 60.0
    init_value: float = 1425.0
    #: None: no surprise term; else "fixed", "game" or "league" with a scale
    anchor: str | None = "game"
    fixed_anchor: float = 1500.0
    surprise_scale: float = 285.0
    playoff_multiplier: float = 1.0
    #: None: every player's first games are boosted; else only these players'
    rookie_ids: tuple[int, ...] | None = None
    #: "uniform": players without a start rating begin at init_value; "draft": they are an error
    init_mode: str = "uniform"

    def __post_init__(self) -> None:
        if self.init_mode not in ("uniform", "draft"):
            raise ValueError(f"unknown init mode {self.init_mode!r}")
        if self.anchor not in (None, "fixed", "game", "league"):
            raise ValueError(f"unknown anchor {self.anchor!r}")
        if self.surprise_scale <= 0:
            raise ValueError("surprise_scale must be positive")
        if self.k < 0 or self.rookie_boost < 0:
            raise ValueError("k and rookie_boost must not be negative")


@dataclass(frozen=True)
class PerformanceParams:
    """Stateless per-game performance."""

    alpha: float = 0.7
    alpha_modern: float | None = None
    modern_from: int = 1996
    sigma_floor: float = 1.0
    shrink_minutes: float = 5.0
    mode: str = "raw"

    def __post_init__(self) -> None:
        for a in (self.alpha, self.alpha_modern):
            if a is not None and not 0 <= a <= 1:
                raise ValueError("alpha must lie in [0, 1]")
        if self.mode not in ("raw", "team_relative", "on_off"):
            raise ValueError(f"unknown mode {self.mode!r}")
