"""Column-expression helpers (built-in Spark functions only)."""

from .exprs import (as_date, clip, combine_money, days_between, exact_avg, exact_sum, fixed,
                    floor_at, money_parts, MONEY_PARTS,
                    format_currency, matches, md5_key, month_of, round1, safe_ratio,
                    shorten, weekday0, year_month)

__all__ = ["as_date", "clip", "combine_money", "money_parts", "MONEY_PARTS", "days_between", "exact_avg", "exact_sum", "fixed", "floor_at",
           "format_currency", "matches", "md5_key", "month_of", "round1", "safe_ratio",
           "shorten", "weekday0", "year_month"]
