"""Scalar functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_minutes(text: Column) -> Column:
    """'mm:ss' or a number to minutes; blank, unreadable and negative texts to NULL."""
    trimmed = F.trim(text)
    parts = F.split(trimmed, ":")
    clock = F.try_add(
        F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double") / F.lit(60.0)
    )
    value = F.when(F.contains(trimmed, F.lit(":")), clock).otherwise(trimmed.try_cast("double"))
    return F.when(value >= 0, value)


def season_start(date: Column) -> Column:
    """Start year of a season: months before July belong to the year before; July to September 2020 to 2019."""
    year, month = F.year(date), F.month(date)
    bubble = (year == 2020) & month.between(7, 9)
    return F.when(bubble, F.lit(2019)).when(month < 7, year - 1).otherwise(year).cast("long")


def season_label(start: Column) -> Column:
    """1999 -> '1999-00'."""
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def normalised_season(raw: Column, season_type: Column, date: Column) -> Column:
    """A playoff season stored under its end year gets its start year."""
    return F.when((season_type == "Playoffs") & (raw == F.year(date)), raw - 1).otherwise(raw).cast("long")


def team_key(city: Column, name: Column) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (city, name)])


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def classify_track(game_type: Column, sub_label: Column) -> tuple[Column, Column]:
    """(track, season type): play-in counts as playoffs, a cup final does not count."""
    kind, sub = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (game_type, sub_label))
    playoffs = kind.isin("playoffs", "play-in tournament")
    excluded = kind.isin("preseason", "all-star") | F.contains(sub, F.lit("championship"))
    track = F.when(excluded, "excluded").when(playoffs, "playoffs").otherwise("regular")
    return track, F.when(playoffs, "Playoffs").otherwise("Regular Season")


def all_star_cutoff(season: Column) -> Column:
    """The mid-season date: 1 February of the end year, with two fixed exceptions."""
    plain = F.make_date(season.cast("int") + 1, F.lit(2), F.lit(1))
    return (
        F.when(season == 1998, F.make_date(F.lit(1999), F.lit(2), F.lit(14)))
        .when(season == 2020, F.make_date(F.lit(2021), F.lit(3), F.lit(1)))
        .otherwise(plain)
    )


def age_years(at: Column, birth: Column) -> Column:
    """Whole elapsed days over 365.2425."""
    return F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(birth.cast("timestamp"))) / 86_400_000_000) / 365.2425


def period_label(season: Column) -> Column:
    return (
        F.when(season < 1980, "1970s").when(season < 1990, "1980s").when(season < 2000, "1990s")
        .when(season < 2010, "2000s").when(season < 2020, "2010s").otherwise("2020s")
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def cut(value: Column, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of the bin of value; bins hold their left edge, or their right one."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        inside = ((value > low) & (value <= high)) if right else ((value >= low) & (value < high))
        out = F.when(inside, label).otherwise(out)
    return out


def quadrant(x: Column, y: Column) -> Column:
    return F.when((x >= 0) & (y >= 0), "Q1").when((x < 0) & (y >= 0), "Q2").when((x < 0) & (y < 0), "Q3").when((x >= 0) & (y < 0), "Q4")


def lift_class(base: Column, other: Column, epsilon: float = 0.01) -> Column:
    """How the second variant compares with the first, within a relative epsilon."""
    change = (other - base) / F.nullif(base, F.lit(0.0))
    return (
        F.when(base.isNull() & other.isNull(), "absent").when(base.isNull(), "new").when(other.isNull(), "gone")
        .when(change > epsilon, "up").when(change < -epsilon, "down").otherwise("same")
    )


def win_probability(difference: Column, home_advantage: Column | float = 0.0) -> Column:
    """Logistic in base 10 with scale 400."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(difference + home_advantage) / 400.0))


def k_effective(k: Column | float, games: Column, boost: float, tau: float) -> Column:
    """Step size of a player with `games` games; tau <= 0 means no boost."""
    base = F.lit(k) if isinstance(k, (int, float)) else k
    return base * (1.0 + (boost - 1.0) * F.exp(-games / F.lit(tau))) if tau > 0 else base


def norm_cdf(z: Column) -> Column:
    """Normal distribution by Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2.0) / F.sqrt(F.lit(2.0) * F.pi()) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - norm_cdf(F.abs(z)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by the normal approximation; NULL under four pairs or at |r| = 1."""
    z = r * F.sqrt((n - 2) / F.nullif(1.0 - r * r, F.lit(0.0)))
    return F.when((n > 3) & (F.abs(r) < 1), two_sided_p(z))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair coins, summed term by term (n at most 60)."""
    term = lambda j: F.exp(_log_factorial(n) - _log_factorial(j) - _log_factorial(n - j) - n * F.log(F.lit(2.0)))
    return F.when(k > n, 0.0).otherwise(F.aggregate(F.sequence(k, n), F.lit(0.0), lambda s, j: s + term(j)))


def _log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def general_number(value: Column) -> Column:
    """A double as text without a trailing .0."""
    whole = value == F.floor(value)
    return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))


def phase(regular: Column, playoffs: Column) -> Column:
    """Name of the quadrant of a change in both tracks."""
    return (
        F.when((regular >= 0) & (playoffs >= 0), "all_phase_riser").when((regular < 0) & (playoffs >= 0), "playoff_reversal")
        .when((regular < 0) & (playoffs < 0), "all_phase_decliner").when((regular >= 0) & (playoffs < 0), "playoff_penalty")
    )


def source_switch(first: Column, second: Column) -> tuple[Column, Column]:
    """Label of two peak tracks, and 1 or -1 where the second moves to or from the playoffs."""
    up, down = (first == "regular") & (second == "playoffs"), (first == "playoffs") & (second == "regular")
    return F.concat(first, F.lit("_to_"), second), F.when(up, 1).when(down, -1).otherwise(0)


def whole_score(score: Column) -> Column:
    """Whole part of a score of five decimals; what the order of its sum leaves beyond the ninth is no part of it."""
    return F.floor(F.round(score, 9))


def result_text(home: Column, home_score: Column, guest_score: Column) -> Column:
    """'W 101-99' for the home score first; a guest's loss names the guest's score first."""
    won = F.when(home, home_score > guest_score).otherwise(guest_score > home_score)
    text = lambda letter, a, b: F.concat(F.lit(f"{letter} "), a.cast("string"), F.lit("-"), b.cast("string"))
    return F.when(won, text("W", home_score, guest_score)).when(home, text("L", home_score, guest_score)).otherwise(text("L", guest_score, home_score))


def named_value(cell: Column) -> tuple[Column, Column]:
    """Name and number of a text 'name (number)'; NULL for other texts."""
    pattern = r"^(.*) \(([0-9.]+)\)$"
    fits = F.regexp_like(cell, F.lit(pattern))
    return F.when(fits, F.regexp_extract(cell, pattern, 1)), F.when(fits, F.regexp_extract(cell, pattern, 2).try_cast("double"))


def lift_kind(peak: Column, high: Column, edge: float = 0.01) -> Column:
    """Class of a career by the relative lifts of its peak and of its high end."""
    flat_peak, flat_high = F.abs(peak) < edge, F.abs(high) < edge
    return (
        F.when((peak <= -edge) | (high <= -edge), "playoff_penalty").when((peak >= edge) & (high >= edge), "playoff_redefined")
        .when((peak >= edge) & flat_high, "playoff_spike").when(flat_peak & (high >= edge), "steady_boost").otherwise("playoff_neutral")
    )


def _decades(year: Column, first: str, last: str) -> Column:
    return cut(year, [-9999, 1980, 1990, 2000, 2010, 2020, 9999], [first, "1980s", "1990s", "2000s", "2010s", last])


def period_of_start(season: Column) -> Column:
    """Period of the year in which a season starts."""
    return _decades(season, "1976-79", "2020s")


def period_of_end(year: Column) -> Column:
    """Period of the year in which a season ends."""
    return _decades(year, "1977-79", "2020-26")


def fixed_decimals(value: Column, digits: int) -> Column:
    """A number as text with exactly so many decimals."""
    return F.format_string(f"%.{digits}f", value)
