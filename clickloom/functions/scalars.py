"""Column expressions for click-log fields. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published data set's for right results.
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
LOG_START_MS = 1_465_876_799_998
NAMED_COUNTRIES = ("US", "CA", "GB")
FIRST_YEAR, LAST_YEAR = 2001, 2016

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(ts: ColumnOrName) -> Column:
    """Whole milliseconds since 1970 of a timestamp, read as UTC."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def floor_div(a: ColumnOrName, b: int) -> Column:
    """Integer division rounding down, also below zero.

    ``div`` truncates toward zero; the remainder of ``pmod`` is never negative, so the
    difference is an exact multiple of ``b`` and no double is involved.
    """
    a = _col(a)
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def floor_mod(a: ColumnOrName, b: int) -> Column:
    return F.pmod(_col(a), F.lit(b))


def hour_of_day(ts: ColumnOrName) -> Column:
    """1..24 of a millisecond offset."""
    return (1 + floor_mod(floor_div(ts, HOUR_MS), 24)).cast("int")


def day_of_log(ts: ColumnOrName) -> Column:
    """Day 1, 2, ... of a millisecond offset."""
    return (1 + floor_div(ts, DAY_MS)).cast("int")


def hour_of_log(ts: ColumnOrName) -> Column:
    """Hours counted through the days: 1 + 24 (day - 1) + (hour - 1)."""
    return (1 + 24 * (day_of_log(ts) - 1) + (hour_of_day(ts) - 1)).cast("int")


def publish_offset(text: ColumnOrName, year_filter: bool = True) -> Column:
    """Publish time text to milliseconds after the log start; null if empty or out of the years."""
    at = F.try_to_timestamp(F.nullif(_col(text), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    offset = F.unix_millis(at) - F.lit(LOG_START_MS)
    return F.when(F.year(at).between(FIRST_YEAR, LAST_YEAR), offset) if year_filter else offset


def geo_part(geo: ColumnOrName, index: int) -> Column:
    """Part 1 (country), 2 (state) or 3 (DMA) of ``country>state>DMA``; null when missing."""
    return F.try_element_at(F.split(_col(geo), ">"), F.lit(index))


def country_group(country: ColumnOrName) -> Column:
    c = _col(country)
    return F.when(c.isin(*NAMED_COUNTRIES), c).otherwise("Rest")


def country_group_id(country: ColumnOrName) -> Column:
    c = _col(country)
    ids = F.lit(len(NAMED_COUNTRIES) + 1)
    for i, name in reversed(list(enumerate(NAMED_COUNTRIES, start=1))):
        ids = F.when(c == name, i).otherwise(ids)
    return ids


def first_char_int(text: ColumnOrName) -> Column:
    return F.substring(_col(text), 1, 1).try_cast("int")


def hex_half(uid: ColumnOrName, half: int) -> Column:
    """Half 1 or 2 (7 digits) of a 14-digit hexadecimal id as a number."""
    return F.conv(F.substring(_col(uid), 1 + 7 * (half - 1), 7), 16, 10).cast("bigint")


def strip_quotes(text: ColumnOrName) -> Column:
    return F.translate(_col(text), "\"'", "")


def clean_name(name: ColumnOrName) -> Column:
    """Blanks, brackets and colons of a project name become underscores."""
    return F.regexp_replace(_col(name), r"[() :]", "_")


def model_version(name: ColumnOrName) -> Column:
    """Number after ``v`` in a model name, null without one."""
    return F.nullif(F.regexp_extract(_col(name), r"v(\d+)", 1), F.lit("")).cast("int")


def model_cohort(name: ColumnOrName) -> Column:
    """Group size from the three-digit ``.NNN`` ending (model number + 1)."""
    number = F.nullif(F.regexp_extract(_col(name), r"\.(\d{3})$", 1), F.lit("")).cast("int")
    return number + 1


def batch_name(prefix: str, batch: ColumnOrName, sub: ColumnOrName | None = None) -> Column:
    """``prefix_007`` or ``prefix_007_012``."""
    parts = [F.lit(prefix), F.lpad(_col(batch).cast("string"), 3, "0")]
    if sub is not None:
        parts.append(F.lpad(_col(sub).cast("string"), 3, "0"))
    return F.concat_ws("_", *parts)


def sparse_text(cols: Sequence[str]) -> Column:
    """``index:value`` pairs of the columns, 1-based, without zeros and nulls."""
    pairs = [
        F.when(
            F.col(c).isNotNull() & (F.col(c) != 0),
            F.concat(F.lit(f"{i}:"), F.col(c).cast("string")),
        )
        for i, c in enumerate(cols, start=1)
    ]
    return F.concat_ws(" ", *pairs)


def format_number_es(x: ColumnOrName, digits: int = 1) -> Column:
    """``1.234,5``: dot for thousands, comma for decimals."""
    return F.translate(F.format_number(_col(x), digits), ",.", ".,")


def duration_text(seconds: ColumnOrName) -> Column:
    """Seconds in the largest fitting unit, as the progress reports print them."""
    s = _col(seconds)

    def unit(divisor: int, digits: int, word: str) -> Column:
        return F.concat(F.format_string(f"%.{digits}f", F.round(s / divisor, digits)), F.lit(f" {word}"))

    return (
        F.when(s < 60, unit(1, 1, "segundos"))
        .when(s < 3600, unit(60, 1, "minutos"))
        .when(s < 86400, unit(3600, 1, "horas"))
        .otherwise(unit(86400, 2, "días"))
    )


def one_hot(c: ColumnOrName, values: Sequence, names: Sequence[str]) -> list[Column]:
    """One 0/1 column per value; a null gives null as a missing comparison does."""
    c = _col(c)
    return [F.when(c.isNotNull(), (c == v).cast("int")).alias(n) for v, n in zip(values, names, strict=True)]


def platform_dummies(c: ColumnOrName = "platform") -> list[Column]:
    return one_hot(c, (1, 2, 3), ("platform1", "platform2", "platform3"))


def country_dummies(c: ColumnOrName = "country_group") -> list[Column]:
    return one_hot(c, ("US", "CA", "GB", "Rest"), ("countryUS", "countryCA", "countryGB", "countryRest"))


def denormalise_size(x: ColumnOrName) -> Column:
    """Group size stored as (size - 2) / 10, back to the size."""
    return F.round(_col(x) * 10 + 2).cast("int")


def nan_to_zero(x: ColumnOrName) -> Column:
    return F.nanvl(_col(x), F.lit(0.0))


def null_token(x: ColumnOrName, token: str) -> Column:
    return F.nullif(_col(x), F.lit(token))
