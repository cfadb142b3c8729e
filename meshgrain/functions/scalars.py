"""Scalar functions as columns: voltages in closed form, ticks, readable numbers, plain text, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs and what stands for them in ASCII.
ASCII = {
    "—": "--", "–": "-", "→": "->", "µ": "u", "·": "-", "≈": "~", "✓": "OK",
    "✗": "X", "█": "#", "▄": "#", "▀": "#", "░": ".", "▒": "+", "▓": "*",
}


def closed_form_voltage(v0: Column, current: Column, steps: Column, decay: float) -> Column:
    """Voltage after a number of ticks of constant input."""
    return current + (v0 - current) * F.pow(F.lit(decay), steps)


def ms_to_tick(ms: Column, dt_ms: float = 0.1) -> Column:
    """The nearest tick, halves to even."""
    return F.rint(ms / F.lit(dt_ms)).cast("long")


def is_finite(x: Column) -> Column:
    """Neither null, nor NaN, nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def fmt_count(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def fmt_bytes(n: Column) -> Column:
    """A size in binary units, one digit after the point from KiB on."""
    units = ["KiB", "MiB", "GiB", "TiB"]
    out = F.concat(_fixed(n / float(1024 ** len(units)), 1), F.lit(" TiB"))
    for power in (3, 2, 1):
        out = F.when(n < 1024 ** (power + 1), F.concat(_fixed(n / float(1024**power), 1), F.lit(f" {units[power - 1]}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def fmt_seconds(s: Column) -> Column:
    """A duration in us, ms, s, or minutes and seconds."""
    minutes = F.floor(s / 60.0)
    rest = F.bround(s - minutes * 60.0, 1)
    long_ = F.concat(minutes.cast("string"), F.lit("m "), F.format_string("%04.1f", rest), F.lit("s"))
    return F.when(s < 1e-3, F.concat(_fixed(s * 1e6, 0), F.lit(" us"))).when(s < 1.0, F.concat(_fixed(s * 1e3, 1), F.lit(" ms"))).when(s < 60.0, F.concat(_fixed(s, 2), F.lit(" s"))).otherwise(long_)


def ascii_text(text: Column) -> Column:
    """text with known signs spelled in ASCII and every other sign beyond it as ?."""
    spelled = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ASCII.items(), text)
    return F.regexp_replace(spelled, r"[^\x00-\x7F]", "?")


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def retry_after(message: Column) -> Column:
    """Seconds that an error message asks to wait: the number after one of the phrases, past quotes and signs of assignment; null if it names none."""
    phrases = ("retry-after", "too many requests")
    return F.nullif(F.regexp_extract(F.lower(message), "(?:" + "|".join(phrases) + r""")["':=\s]{0,6}(\d+)""", 1), F.lit("")).cast("double")


def iso_second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def map_get(m: Column, key: Column | str, default: Column) -> Column:
    """m[key], or the default where it is missing."""
    return F.coalesce(F.try_element_at(m, key if isinstance(key, Column) else F.lit(key)), default)


def map_update(m: Column, newer: Column) -> Column:
    """m with the entries of newer in place of its own."""
    return F.map_zip_with(m, newer, lambda _, old, new: F.coalesce(new, old))
