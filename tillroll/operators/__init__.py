"""Reusable DataFrame -> DataFrame operators."""

from .cohort import (first_dates, journey, journey_paths, latest_as_of, moved_after, moved_between, pair_moments,
                     pair_periods, pairs_before)
from .joins import dates_relative_to, join_relative_to, rows_on_edge_date
from .keys import surrogate_key
from .lists import apply_changes, apply_tagged, explode_list, repeat_rows, tagged
from .measure import first_match, flag, price_of, round_ratio, share
from .quality import assert_schema, check_ratings, missing_counts, missing_rows, parse_counts, schema_of
from .rank import keep_max, top_n, top_ranked

__all__ = [
    "apply_changes", "apply_tagged", "assert_schema", "check_ratings", "dates_relative_to", "explode_list",
    "first_dates", "first_match", "flag", "join_relative_to", "journey", "journey_paths", "keep_max",
    "latest_as_of", "missing_counts", "missing_rows", "moved_after", "moved_between", "pair_moments", "pair_periods",
    "pairs_before", "parse_counts", "price_of", "repeat_rows", "round_ratio", "rows_on_edge_date", "schema_of", "share",
    "surrogate_key", "tagged", "top_n", "top_ranked",
]
