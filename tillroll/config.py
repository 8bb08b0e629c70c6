"""Settings of a run. Everything a caller may want to change is a field here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class RepairWindow:
    """Days (both ends included) of one series whose outliers are replaced."""

    series: str
    first_day: date
    last_day: date


@dataclass(frozen=True)
class Settings:
    as_of: date
    home_country: str
    excluded_countries: tuple[str, ...]
    view_start: date
    repair_windows: tuple[RepairWindow, ...] = ()
    other_label: str = "All Others"
    horizon: int = 90
    train_percent: int = 80
    seed: int = 123
    n_closest: int = 5
    n_return: int = 10
    # Holders of one item per task of the pair join.
    pair_block: int = 1000
    roll_periods: tuple[int, ...] = (7, 14, 21, 28)
    max_acf_lag: int = 28
    tune_candidates: int = 10
    tune_folds: int = 5
    cv_slices: int = 4
    # Trees of the base forest and their depth; tuned forests draw their trees from the range.
    forest_trees: int = 100
    forest_depth: int = 12
    forest_tree_range: tuple[int, int] = (10, 120)
    # Rounds of the tuned boosts.
    boost_round_range: tuple[int, int] = (5, 40)
    # Candidates that differ only in trees or rounds, at a time: the longest fit scores the others.
    forest_sizes: int = 2
    boost_sizes: int = 5
    # Terms (constant included) and factors of a term of the tuned splines.
    spline_term_range: tuple[int, int] = (2, 20)
    spline_degree_range: tuple[int, int] = (1, 2)
    # Members of a tuned committee of rules, and near rows that correct it.
    committee_range: tuple[int, int] = (1, 5)
    neighbor_range: tuple[int, int] = (0, 9)
    # Forecast shown per series: the home market uses one model, the rest another.
    home_model: str = "BOOST - Tuned"
    other_model: str = "ENSEMBLE (MEAN): 4 MODELS"


# The cut-off day, countries left out, and days repaired in the
# online-retail data.
ONLINE_RETAIL = Settings(
    as_of=date(2011, 11, 30),
    home_country="United Kingdom",
    excluded_countries=("EIRE", "Channel Islands", "RSA", "West Indies"),
    view_start=date(2011, 1, 1),
    repair_windows=(
        RepairWindow("All Others", date(2010, 3, 16), date(2010, 3, 19)),
        RepairWindow("All Others", date(2010, 8, 8), date(2010, 8, 10)),
        RepairWindow("United Kingdom", date(2010, 3, 22), date(2010, 3, 24)),
        RepairWindow("United Kingdom", date(2010, 9, 26), date(2010, 9, 28)),
        RepairWindow("United Kingdom", date(2011, 1, 17), date(2011, 1, 19)),
    ),
)

# The same questions asked of the star-schema tables.
STAR = Settings(
    as_of=date(2001, 7, 31),
    home_country="NATION_1",
    excluded_countries=("NATION_21", "NATION_22", "NATION_23", "NATION_24"),
    view_start=date(2000, 9, 1),
    repair_windows=(
        RepairWindow("All Others", date(1995, 1, 1), date(1996, 12, 31)),
        RepairWindow("NATION_1", date(1995, 1, 1), date(1996, 12, 31)),
    ),
)
