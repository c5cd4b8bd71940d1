"""Column -> Column helpers built only from Spark's built-in expressions."""

from orderpulse.functions.dates import (  # noqa: F401
    add_days, floor_days, month_start, parse_date, ts_literal, to_utc,
)
from orderpulse.functions.numbers import (  # noqa: F401
    locale_number, locale_int, order_code, locale_decimal, lenient_double,
)
from orderpulse.functions.text import (  # noqa: F401
    client_key, generated_sku, strip_accents, split_code_description,
)
from orderpulse.functions.labels import (  # noqa: F401
    reliability, tier, reliability_label,
)
