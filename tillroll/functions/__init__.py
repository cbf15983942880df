"""Column-level helpers built from pyspark.sql.functions (JVM-side, codegen'd)."""

from .agg import name_key, ordered_concat
from .dates import (days_between, minute_field, month_start, period_index, period_label,
                    period_start, seconds_between, total_minutes, weekday_name, weekday_number)
from .text import (FAKE_NULLS, clean_sentinels, is_fake_null, list_is_bad, parse_measure, parse_timestamp,
                   replace_fake_null, split_list)

__all__ = [
    "FAKE_NULLS", "clean_sentinels", "days_between", "is_fake_null", "list_is_bad", "minute_field", "month_start", "name_key",
    "ordered_concat", "parse_measure", "parse_timestamp", "period_index", "period_label",
    "period_start", "replace_fake_null", "seconds_between", "split_list", "total_minutes",
    "weekday_name", "weekday_number",
]
