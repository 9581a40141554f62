"""Lenient typed comparison of an expected and an actual value, as one column expression.

Values are text with a kind (``string``, ``number`` or ``bool``); null text is a null value. Parsed forms are
projected once by :func:`parsed` so that the decision in :func:`match` stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import casefold, is_absent, strip

#: What a plain decimal looks like; guards casts that would also take ``12d`` or ``1f``.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SYMBOLS = "$€£¥"
REL_TOL = 1e-9


def decimal(text: Column) -> Column:
    """A double from decimal text, NaN and infinities by name; else null."""
    low = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(text.rlike(NUMBER), text.try_cast("double"))
        .when(low == "nan", F.lit(float("nan")))
        .when(low.isin("inf", "infinity"), sign * F.lit(float("inf")))
    )


def plain_number(text: Column, kind: Column) -> Column:
    t = strip(text)
    refused = t.endswith("%") | t.rlike(f"[{SYMBOLS}]")
    return F.when(kind == "number", decimal(text)).when((kind == "string") & ~refused, decimal(F.translate(t, ",", "")))


def currency(text: Column, kind: Column) -> Column:
    t = F.regexp_replace(strip(text), rf"(?U)[{SYMBOLS}\s]", "")
    return F.when(kind == "number", decimal(text)).otherwise(decimal(F.regexp_replace(t, r",(?=\d{3}(\D|$))", "")))


def percent(text: Column, kind: Column) -> Column:
    t = strip(text)
    x = F.when(kind == "number", decimal(text)).otherwise(decimal(t))
    bare = F.when(x.between(-1.0, 1.0), x).when((x > 0) & (x <= 100.0), x / 100.0).otherwise(x)
    marked = decimal(strip(F.substring(t, F.lit(1), F.length(t) - 1))) / 100.0
    return F.when((kind != "number") & t.endswith("%"), marked).otherwise(bare)


def numbers_close(a: Column, b: Column, rel_tol: float = REL_TOL) -> Column:
    near = F.abs(a - b) <= rel_tol * F.greatest(F.abs(a), F.abs(b))
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise((a == b) | (finite & near))


_ISO_TIME = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
#: Day patterns tried in order: what the text looks like and how to read it.
_DAYS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
)


def date_key(text: Column) -> Column:
    """ISO text of a date or a time (whole seconds, offset kept), or null; times are never turned to instants."""
    t = strip(text)
    part = lambda i, default="00": F.coalesce(F.nullif(F.regexp_extract(t, _ISO_TIME, i), F.lit("")), F.lit(default))
    zone = F.regexp_replace(F.replace(part(5, ""), F.lit("Z"), F.lit("+00:00")), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    clock = F.concat_ws(":", part(2), part(3), part(4))
    moment = F.concat(part(1, ""), F.lit("T"), clock)
    real = F.try_to_timestamp(F.when(t.rlike(_ISO_TIME), moment), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    month = F.initcap(t)
    days = [F.try_to_timestamp(F.when(t.rlike(look), month), F.lit(fmt)) for look, fmt in _DAYS]
    return F.when(real, F.concat(moment, zone)).otherwise(F.date_format(F.coalesce(*days), "yyyy-MM-dd"))


def parsed(df: DataFrame, expected: str, actual: str, kinds: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the parsed forms of both columns, named ``_e_*`` and ``_a_*``."""
    out = {}
    for side, name, kind in (("_e", expected, kinds and kinds[0]), ("_a", actual, kinds and kinds[1])):
        x, k = F.col(name), F.col(kind) if kind else F.lit("string")
        out |= {
            f"{side}_text": x,
            f"{side}_gone": is_absent(x),
            f"{side}_number": plain_number(x, k),
            f"{side}_currency": currency(x, k),
            f"{side}_percent": percent(x, k),
            f"{side}_date": date_key(x),
            f"{side}_fold": casefold(strip(x)),
            f"{side}_bare": strip(x),
        }
    return df.withColumns(out)


def match(hint: str | None = None) -> Column:
    """``exact``, ``normalized``, ``mismatch`` or ``missing`` over the columns of :func:`parsed`."""
    e, a = (lambda n, s=s: F.col(f"{s}_{n}") for s in ("_e", "_a"))
    both = lambda n: e(n).isNotNull() & a(n).isNotNull()
    same = lambda n: (e(n) == a(n)) & ~F.isnan(e(n))
    absent = lambda first: F.when(e("gone") & a("gone"), first).when(a("gone"), "missing").when(e("gone"), "mismatch")
    out = absent("exact")
    if hint == "strict":
        return out.when(e("text") == a("text"), "exact").otherwise("mismatch")
    if hint in (None, "number"):
        out = out.when(both("number"), F.when(~numbers_close(e("number"), a("number")), "mismatch").when(same("number"), "exact").otherwise("normalized"))
        if hint == "number":
            out = out.when(F.lit(True), "mismatch")
    for kind in ("currency", "percent"):
        if hint in (None, kind):
            close = both(kind) & numbers_close(e(kind), a(kind))
            out = out.when(F.coalesce(close, F.lit(False)), F.when(same(kind), "exact").otherwise("normalized"))
    if hint in (None, "date"):
        out = out.when(both("date") & (e("date") == a("date")), F.when(e("bare") == a("bare"), "exact").otherwise("normalized"))
        if hint == "date":
            out = out.when(~both("date"), "mismatch")
    return out.when(e("text") == a("text"), "exact").when(e("fold") == a("fold"), "normalized").otherwise("mismatch")


def compare(df: DataFrame, expected: str, actual: str, hint: str | None = None, kinds: tuple[str, str] | None = None, out: str = "match") -> DataFrame:
    """``df`` with the verdict ``out`` on two of its columns.

    Equal text is exact without a look at what it means, unless a hint asks for a number or date; only the rest is parsed.
    """
    names = df.columns
    if kinds is not None or hint in ("number", "date"):
        return parsed(df, expected, actual, kinds).withColumn(out, match(hint)).select(*names, out)
    same = F.col(expected).eqNullSafe(F.col(actual))
    left = df.withColumns({"_same": same, "_expected": F.when(~same, F.col(expected)), "_actual": F.when(~same, F.col(actual))})
    verdict = F.when(F.col("_same"), "exact").otherwise(match(hint))
    return parsed(left, "_expected", "_actual", None).withColumn(out, verdict).select(*names, out)
