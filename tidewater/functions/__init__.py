"""Column expressions: every helper returns a JVM-side Column."""

from tidewater.functions.scalars import (  # noqa: F401
    month_bucket, quarter_label, rate_pct, mean_of_decimal, clean_reference, parse_quantity,
    loose_equal, loose_contains, cut_with_ellipsis, to_number, clamp01, business_key,
    nullif_zero, bound, complete_json, float_text, python_type,
)
