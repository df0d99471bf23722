"""Scalar column expressions.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.  Timestamps are ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket import config as C

__all__ = [
    "strip", "blank_to_null", "is_blank", "parse_ts", "parse_stripped", "ts_parse_failed", "hours_between", "ts_lit",
    "iso_text", "canonical_code_rule", "norm_value", "fingerprint", "pack_hex", "unpack_hex", "calendar_features",
    "sla_hours", "is_delayed", "duration_hours", "split_label", "risk_score", "risk_level",
    "delay_decision", "clamp_hours", "prob_interval", "hours_interval", "elapsed_hours", "logit",
    "threshold_cuts",
]


#: Characters that count as white space at the ends of a text.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def ts_lit(value: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


# --- P1 ---------------------------------------------------------------------
def blank_to_null(c: Column | str) -> Column:
    """strip, then '' -> NULL."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


# --- P2 ---------------------------------------------------------------------
_DATE_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$"
_BASIC_DATE = r"^[0-9]{8}$"


def parse_ts(c: Column | str) -> Column:
    """Tolerant timestamp parse; NULL for blank *and* for garbage.

    Accepted: ``yyyy-M-d``, ``yyyy-M-d[ T]H:m[:s[.f]]``, ``yyyyMMdd``; a zone
    suffix is dropped (wall time kept).  Year-only and year-month texts are
    refused although Spark's cast accepts them (shape guard).  Use
    :func:`ts_parse_failed` to tell blank from garbage.
    """
    return parse_stripped(strip(c))


def parse_stripped(t: Column | str) -> Column:
    """:func:`parse_ts` of a text without white space at its ends; it names ``t`` often, so ``t`` should be a column."""
    t = _c(t)
    basic = F.regexp_replace(t, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    # the last character or a sign five or six from the end tells whether there can be a zone
    zoned = t.endswith("Z") | F.substring(t, -6, 1).isin("+", "-") | F.substring(t, -5, 1).isin("+", "-")
    no_zone = F.when(zoned, F.regexp_replace(t, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")).otherwise(t)
    return (
        F.when((F.length(t) == 8) & t.rlike(_BASIC_DATE), basic.try_cast("timestamp_ntz"))
        .when(t.rlike(_DATE_SHAPE), no_zone.try_cast("timestamp_ntz"))
        .otherwise(F.lit(None).cast("timestamp_ntz"))
    )


def ts_parse_failed(c: Column | str) -> Column:
    """True when the text is non-blank and does not parse."""
    return (~is_blank(c)) & parse_ts(c).isNull()


def hours_between(start: Column | str, end: Column | str) -> Column:
    """(end - start) in hours as double; exact microsecond difference."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(3.6e9)


def iso_text(c: Column | str) -> Column:
    """ISO-8601 text like Python ``datetime.isoformat()`` (micros only if non-zero)."""
    ts = _c(c)
    # only a text with a fraction is formatted with one
    return F.when(F.unix_micros(ts.cast("timestamp")) % 1000000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


# --- P3 ---------------------------------------------------------------------
def canonical_code_rule(raw: Column | str) -> Column:
    """snake_case code for a raw catalog label ('&' and '/' read as 'and')."""
    t = F.lower(strip(raw))
    t = F.regexp_replace(t, "[&/]", " and ")
    t = F.regexp_replace(t, "[^a-z0-9]+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


# --- P6 / P7 / P8 -------------------------------------------------------------
def norm_value(c: Column | str, is_timestamp: bool = False) -> Column:
    """None -> <<null>>, '' -> <<empty>>, datetime -> ISO, else trimmed text."""
    col = _c(c)
    if is_timestamp:
        return F.coalesce(iso_text(col), F.lit(C.NULL_TOKEN))
    return norm_stripped(col, strip(col.cast("string")))


def norm_stripped(col: Column, t: Column) -> Column:
    """:func:`norm_value` of ``col``, whose stripped text is ``t``."""
    return F.when(col.isNull(), F.lit(C.NULL_TOKEN)).when(t == "", F.lit(C.EMPTY_TOKEN)).otherwise(t)


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact, key-sorted JSON of already-normalised text fields."""
    keys = sorted(fields)
    whole = F.lit(True)
    for k in keys:
        whole = whole & fields[k].isNotNull()
    return F.when(whole, F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in keys])), 256))


_NO_DIGEST = bytes(33)  # longer than a packed digest


def pack_hex(c: Column | str) -> Column:
    """A SHA-256 text of 64 lower-case hex digits as its 32 bytes; any other text as 33 zero bytes and itself.  Equal texts, and only they, pack equally."""
    t = _c(c)
    return F.when(t.rlike("^[0-9a-f]{64}\\z"), F.unhex(t)).when(t.isNotNull(), F.concat(F.lit(_NO_DIGEST), t.cast("binary")))


def unpack_hex(c: Column | str) -> Column:
    """The text that :func:`pack_hex` packed."""
    b = _c(c)
    return F.when(F.length(b) == 32, F.lower(F.hex(b))).otherwise(F.substring(b, len(_NO_DIGEST) + 1, 2**31 - 1).cast("string"))


# --- P11 / P12 ----------------------------------------------------------------
def calendar_features(created_at: Column | str) -> dict[str, Column]:
    ts = _c(created_at)
    wd = F.weekday(ts)
    return {
        "open_month": F.month(ts),
        "open_weekday": wd,
        "open_hour": F.hour(ts),
        "is_weekend": (wd >= 5).cast("int"),
    }


def sla_hours(created_at: Column | str, deadline: Column | str) -> Column:
    """Hours from open to deadline; negative or missing -> NULL (never NaN)."""
    h = hours_between(created_at, deadline)
    return F.when(h >= 0, h)


# --- P14 / P15 / P16 ------------------------------------------------------------
def is_delayed(completed_at: Column | str, deadline: Column | str, cutoff: _dt.datetime) -> Column:
    done, dl = _c(completed_at), _c(deadline)
    return (
        F.when(dl.isNull(), F.lit(None))
        .when(done.isNotNull(), F.when(done <= dl, 0).otherwise(1))
        .when(dl < ts_lit(cutoff), 1)
        .otherwise(F.lit(None))
        .cast("int")
    )


def duration_hours(created_at: Column | str, completed_at: Column | str) -> Column:
    h = hours_between(created_at, completed_at)
    return F.when(h >= 0, h)


def split_label(created_at: Column | str, splits: Sequence[tuple[str, _dt.datetime, _dt.datetime]]) -> Column:
    ts = _c(created_at)
    out = None
    for name, start, end in splits:
        cond = (ts >= ts_lit(start)) & (ts < ts_lit(end))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


# --- P17 - P22 ---------------------------------------------------------------
def risk_score(p: Column | str) -> Column:
    """clamp(round_half_even(100 p), 0, 100); NULL stays NULL."""
    # least/greatest skip NULLs, so guard NULL explicitly
    return F.when(_c(p).isNotNull(),
                  F.least(F.greatest(F.bround(_c(p) * 100, 0), F.lit(0.0)), F.lit(100.0))).cast("int")


def risk_level(score: Column | str) -> Column:
    s = _c(score)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s <= C.RISK_LOW_MAX, "low")
        .when(s <= C.RISK_MEDIUM_MAX, "medium")
        .otherwise("high")
    )


def delay_decision(p: Column | str, has_sla: Column, threshold: float = C.DEFAULT_THRESHOLD) -> Column:
    return F.when(has_sla & _c(p).isNotNull(), (_c(p) >= F.lit(threshold)).cast("int"))


def clamp_hours(raw: Column | str) -> Column:
    """max(0, raw); non-finite input -> NULL (callers route it to rejects)."""
    r = _c(raw)
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) != F.lit(float("inf")))
    return F.when(finite, F.greatest(r, F.lit(0.0)))


def prob_interval(p: Column | str, std: Column | str) -> tuple[Column, Column]:
    p, s = _c(p), _c(std)
    ok = p.isNotNull() & s.isNotNull()
    return F.when(ok, F.greatest(p - 2 * s, F.lit(0.0))), F.when(ok, F.least(p + 2 * s, F.lit(1.0)))


def hours_interval(h: Column | str, std: Column | str) -> tuple[Column, Column]:
    h, s = _c(h), _c(std)
    ok = h.isNotNull() & s.isNotNull()
    return F.when(ok, F.greatest(h - 2 * s, F.lit(0.0))), F.when(ok, F.greatest(h + 2 * s, F.lit(0.0)))


def elapsed_hours(created_at: Column | str, completed_at: Column | str) -> Column:
    h = hours_between(created_at, completed_at)
    return F.when(h.isNotNull(), F.round(F.greatest(h, F.lit(0.0)), 2))


# --- P24 --------------------------------------------------------------------------
def logit(p: Column | str, eps: float = C.LOGIT_EPS) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.when(_c(p).isNotNull(), F.ln(q / (F.lit(1.0) - q)))


def threshold_cuts() -> list[float]:
    """0.10, 0.15, ... 0.90 computed as start + i*step (double)."""
    return [C.THRESHOLD_START + i * C.THRESHOLD_STEP for i in range(C.THRESHOLD_CUTS)]
