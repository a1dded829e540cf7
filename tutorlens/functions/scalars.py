"""Column -> Column functions: rounding, labels, risk levels, text parsers.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Every function that depends on thresholds takes them as a plain dict; the
values become literals and Catalyst folds them.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, NumericType, StringType,
                               TimestampNTZType, TimestampType)

from ..config import (DATE_FORMATS, DATE_SHAPES, DEFAULT_THRESHOLDS, LEVEL_CODE, LEVELS_BY_SEVERITY, NO_DATA,
                      NULL_TOKENS, TIMESTAMP_SUFFIX_SHAPES, TIMESTAMP_SUFFIXES, TRUE_TOKENS)

ColumnOrName = Column | str

# A finite decimal number, the only text a grade or weight parser accepts.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# rounding and number formatting
# ---------------------------------------------------------------------------

def round_half_even(c: ColumnOrName, digits: int = 2) -> Column:
    """NumPy-style rounding: scale, round half to even, unscale (``rint(x*100)/100``).

    Spark's ``round``/``bround`` go through a decimal string and give other
    results on values such as 84.125.
    """
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def round2(c: ColumnOrName) -> Column:
    return round_half_even(c, 2)


def _round1_exact(c: Column) -> Column:
    """Round to one decimal the way printf-style formatting does: half to even
    on the exact binary value. ``x*10`` is split as ``x*8 + x*2`` (both exact)
    and the rounding error of the sum decides ties."""
    a = c * F.lit(8.0)
    b = c * F.lit(2.0)
    s = a + b
    bb = s - a
    err = (a - (s - bb)) + (b - bb)
    fl = F.floor(s).cast("double")
    tie = (s - fl) == F.lit(0.5)
    scaled = (F.when(tie & (err > 0), fl + F.lit(1.0))
              .when(tie & (err < 0), fl)
              .otherwise(F.rint(s)))
    return scaled / F.lit(10.0)


def format_fixed(c: ColumnOrName, digits: int) -> Column:
    """``f'{x:.Nf}'`` as text. One decimal is exact for all doubles; for more
    decimals the value is expected to be pre-rounded (as all 2dp metrics are)."""
    c = _col(c)
    rounded = _round1_exact(c) if digits == 1 else round_half_even(c, digits)
    return F.format_string(f"%.{digits}f", rounded)


def pct_label(count: ColumnOrName, total: ColumnOrName) -> Column:
    """``'{:.1f}%'`` of count/total*100, or ``'0%'`` when total is 0."""
    total = _col(total)
    pct = _col(count).cast("double") / total.cast("double") * F.lit(100.0)
    return F.when(total > 0, F.concat(format_fixed(pct, 1), F.lit("%"))).otherwise(F.lit("0%"))


# ---------------------------------------------------------------------------
# risk levels
# ---------------------------------------------------------------------------

def _th(th: dict | None) -> dict:
    return DEFAULT_THRESHOLDS if th is None else th


def risk_attendance(pct: ColumnOrName, th: dict | None = None) -> Column:
    """pct < riesgo ALTO, < alerta MEDIO, < optima ALERTA, else OPTIMO (strict)."""
    t = _th(th)
    p = _col(pct)
    return (F.when(p < F.lit(float(t["asistencia_riesgo"])), "ALTO")
            .when(p < F.lit(float(t["asistencia_alerta"])), "MEDIO")
            .when(p < F.lit(float(t["asistencia_optima"])), "ALERTA")
            .otherwise("OPTIMO"))


def risk_grade(nota: ColumnOrName, th: dict | None = None) -> Column:
    """nota < riesgo ALTO, < alerta MEDIO, < excelente ALERTA, else OPTIMO;
    a missing mark (all weights zero) has no level."""
    t = _th(th)
    n = _col(nota)
    return (F.when(n.isNull(), NO_DATA)
            .when(n < F.lit(float(t["nota_riesgo"])), "ALTO")
            .when(n < F.lit(float(t["nota_alerta"])), "MEDIO")
            .when(n < F.lit(float(t["nota_excelente"])), "ALERTA")
            .otherwise("OPTIMO"))


def severity(level: ColumnOrName) -> Column:
    """Severity code of a level; unknown and SIN_DATOS count as 0."""
    lv = _col(level)
    expr = F.when(lv == "ALTO", LEVEL_CODE["ALTO"])
    for name in ("MEDIO", "ALERTA"):
        expr = expr.when(lv == name, LEVEL_CODE[name])
    return expr.otherwise(0)


def level_of(code: ColumnOrName) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS_BY_SEVERITY]), _col(code) + 1)


def risk_combined(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The more severe of two levels."""
    return level_of(F.greatest(severity(a), severity(b)))


def risk_order(level: ColumnOrName) -> Column:
    """Sort key ALTO, MEDIO, ALERTA, OPTIMO, then anything else."""
    lv = _col(level)
    return (F.when(lv == "ALTO", 0).when(lv == "MEDIO", 1).when(lv == "ALERTA", 2)
            .when(lv == "OPTIMO", 3).otherwise(4))


# ---------------------------------------------------------------------------
# text parsers (input columns are strings when read from CSV)
# ---------------------------------------------------------------------------

def null_tokens(c: ColumnOrName, tokens: list[str] | None = None) -> Column:
    c = _col(c)
    return F.when(c.isin(tokens if tokens is not None else NULL_TOKENS), F.lit(None)).otherwise(c)


def parse_bool(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """Flag parser: null -> False; text in the truth set or a nonzero number -> True."""
    c = _col(c)
    if isinstance(dtype, BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, NumericType):
        return F.coalesce(c != 0, F.lit(False))
    t = F.lower(F.trim(c.cast("string")))
    numeric_true = t.rlike(NUMBER_PATTERN) & (t.try_cast("double") != 0)
    return F.coalesce(t.isin(TRUE_TOKENS) | numeric_true, F.lit(False))


def parse_number(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """Text -> double; anything that is not a finite decimal number -> null.
    NaN in numeric input becomes null too (Spark orders NaN above all numbers)."""
    c = _col(c)
    if isinstance(dtype, NumericType):
        d = c.cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def parse_grade(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    return parse_number(c, dtype)


def grade_in_range(nota: ColumnOrName) -> Column:
    """0 <= Nota <= 10; null fails."""
    n = _col(nota)
    return F.coalesce((n >= 0) & (n <= 10), F.lit(False))


def parse_weight(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    return F.coalesce(parse_number(c, dtype), F.lit(1.0))


# Characters removed around competency codes: every character Python's
# ``str.isspace`` accepts.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def normalize_competency(c: ColumnOrName) -> Column:
    """UPPER then strip surrounding whitespace. Plain spaces go with ``trim``;
    the full whitespace set is only applied when an end character needs it."""
    t = F.trim(F.upper(_col(c)))
    ws = F.lit(WHITESPACE)
    edge = (F.instr(ws, F.substring(t, 1, 1)) > 0) | (F.instr(ws, F.substring(t, -1, 1)) > 0)
    return F.when((F.length(t) > 0) & edge, F.btrim(t, ws)).otherwise(t)


def _shaped_parse(t: Column, with_time_of_day: bool) -> Column:
    """One parse per row: the text's shape (a cheap regex) picks the single
    pattern that can read it. Failed ``try_to_*`` calls are costly (an
    exception each), so no pattern is tried on text of another shape."""
    expr = None
    for fmt, shape in zip(DATE_FORMATS, DATE_SHAPES):
        d = F.try_to_date(t, fmt)
        branch = (t.rlike(f"^{shape}$"), d.cast("timestamp") if with_time_of_day else d)
        expr = F.when(*branch) if expr is None else expr.when(*branch)
        for suf, suf_shape in zip(TIMESTAMP_SUFFIXES, TIMESTAMP_SUFFIX_SHAPES):
            ts = F.try_to_timestamp(t, F.lit(fmt + suf))
            expr = expr.when(t.rlike(f"^{shape}{suf_shape}$"), ts if with_time_of_day else ts.cast("date"))
    return expr


def parse_date(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """Text -> date in one of the accepted shapes (day first); a time part is
    accepted and dropped; anything else -> null."""
    c = _col(c)
    if isinstance(dtype, DateType):
        return c
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return c.cast("date")
    return _shaped_parse(F.trim(c.cast("string")), with_time_of_day=False)


def format_student_id(rank: ColumnOrName, prefix: str = "EST", width: int = 4) -> Column:
    """``EST`` + rank zero-padded to ``width`` digits; longer ranks are kept whole
    (``lpad`` would cut them)."""
    return F.format_string(f"{prefix}%0{width}d", _col(rank))
