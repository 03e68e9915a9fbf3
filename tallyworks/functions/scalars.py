"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how missing entries are written
MISSING = ("", "NA", "N/A", "NULL", ".", "-")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x) -> Column:
    """Trimmed, inner white space as one space."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def parse_na(x) -> Column:
    """Null where the trimmed text says missing."""
    t = F.trim(_c(x))
    return F.when(F.upper(t).isin(*MISSING), None).otherwise(t)


def parse_na_number(x) -> Column:
    return parse_na(x).try_cast("double")


def parse_int(x, default: int | None = None) -> Column:
    v = F.round(parse_na_number(x)).cast("int")
    return v if default is None else F.coalesce(v, F.lit(default))


def parse_number(x, decimal: str = ",") -> Column:
    """value and converted: a number in a dialect of decimal mark and thousands mark; strict digits."""
    thousands = "." if decimal == "," else ","
    t = F.trim(_c(x))
    plain = F.replace(F.replace(t, F.lit(thousands), F.lit("")), F.lit(decimal), F.lit("."))
    ok = plain.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.struct(F.when(ok, plain.try_cast("double")).alias("value"), F.coalesce(ok & (plain != t), F.lit(False)).alias("converted"))


def parse_date(x) -> Column:
    """dd/mm/yyyy or yyyy-mm-dd; impossible dates are null."""
    t = F.trim(_c(x))
    slash = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy")))
    dash = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M-d")))
    return F.coalesce(slash, dash).cast("date")


def fold_key(x, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, without accents and anything but letters and digits; then the alias, if any."""
    t = F.translate(F.lower(_c(x)), "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc")
    t = F.regexp_replace(t, "[^a-z0-9]", "")
    if not aliases:
        return t
    return F.coalesce(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[t], t)


def split_codes(x) -> Column:
    """The non-empty trimmed entries of a;b;c."""
    return F.filter(F.transform(F.split(_c(x), ";"), lambda v: F.trim(v)), lambda v: v != "")


def split_pairs(x) -> Column:
    """The pairs of a | b; c | d, as structs (a, b)."""
    parts = F.transform(split_codes(x), lambda p: F.transform(F.split(p, r"\|"), lambda v: F.trim(v)))
    return F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("a"), p[1].alias("b")))


def round_significant(x, digits: int = 10) -> Column:
    """Rounded to significant digits, half away from zero; 0 stays 0."""
    v = _c(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale)


def format_result(x) -> Column:
    """Six decimals after rounding to ten significant digits; null is empty, minus zero is zero."""
    v = round_significant(x)
    t = F.when(v.isNotNull(), F.format_string("%.6f", v))
    return F.coalesce(F.regexp_replace(t, r"^-(0\.0+)$", "$1"), F.lit(""))


def format_flag(x) -> Column:
    return F.when(_c(x), "Sí").when(~_c(x), "No").otherwise("")


def format_es(x, decimals: int = 2) -> Column:
    """Thousands dot, decimal comma."""
    return F.translate(F.format_number(_c(x).cast("double"), decimals), ",.", ".,")


def last_digit_code(x) -> Column:
    return F.pmod(_c(x), F.lit(10)).cast("int")


def log_safe(x) -> Column:
    """Natural logarithm, null where there is none."""
    return F.when(_c(x) > 0, F.ln(_c(x)))


def logistic_safe(z) -> Column:
    """1 / (1 + exp(-z)) without overflow at either end."""
    z = _c(z)
    return F.when(z >= 0, 1 / (1 + F.exp(-F.least(z, F.lit(700.0))))).otherwise(F.exp(F.greatest(z, F.lit(-700.0))) / (1 + F.exp(F.greatest(z, F.lit(-700.0)))))


def hash_uniform(seed: str, *parts) -> Column:
    """A reproducible number in [0, 1) for each row (and replicate); 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(seed), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def label_codes(x, labels: dict, missing: str = "Sin dato", unknown: str = "Código ") -> Column:
    """The label of a code; a code without one says so, null is missing."""
    m = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.coalesce(m[_c(x)], F.when(_c(x).isNull(), missing).otherwise(F.concat(F.lit(unknown), _c(x).cast("string"))))


def band(x, edges: list[tuple[float, float | None, str]]) -> Column:
    """The name of the closed band [low, high] that holds x; an open last band has no high."""
    out = None
    for low, high, name in edges:
        hit = (_c(x) >= low) if high is None else _c(x).between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def normalize_group_label(x) -> Column:
    t = clean_text(x)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1_000_000)))
