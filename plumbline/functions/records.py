"""Small scalar helpers shared by the findings and report operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Citation token with optional line and range end.
CITE_RE = (
    r"([\w@$()./\\-]+\.(?:tsx?|mjs|cjs|jsx?|sql|css|scss|json|ya?ml|toml|md))(?::(\d+)(?:-(\d+))?)?"
)
# Tokens that are never citations.
EXEMPT_RE = r"^https?:|node_modules|\{|\}|^-|\*"


def pct(covered: Column, total: Column) -> Column:
    """Rounded percentage; an empty denominator counts as fully covered."""
    return F.when(total > 0, F.floor(covered * 100.0 / total + 0.5).cast("bigint")).otherwise(F.lit(100).cast("bigint"))


def layer_key(layer: Column) -> Column:
    """Numeric ordering key of ``N`` or ``N.M``; a missing minor sorts first."""
    parts = F.split(layer, r"\.")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("major"),
        F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(-1)).alias("minor"),
    )


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def iso_slug(ts: Column) -> Column:
    """File-safe timestamp."""
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def clamp(c: Column, low: Column | int, high: Column | int) -> Column:
    lo = F.lit(low) if isinstance(low, int) else low
    hi = F.lit(high) if isinstance(high, int) else high
    return F.least(hi, F.greatest(lo, c))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("bigint")


def citations(text: Column, exempt: str = EXEMPT_RE) -> Column:
    """``array<struct<raw, tok, line, end>>`` of every non-exempt citation in a text."""
    raws = F.regexp_extract_all(text, F.lit(CITE_RE), F.lit(0))
    parsed = F.transform(raws, parse_citation)
    return F.filter(parsed, lambda c: ~c["tok"].rlike(exempt))


def parse_citation(raw: Column) -> Column:
    number = lambda g: F.nullif(F.regexp_extract(raw, CITE_RE, g), F.lit("")).try_cast("bigint")
    return F.struct(
        raw.alias("raw"),
        F.regexp_extract(raw, CITE_RE, 1).alias("tok"),
        number(2).alias("line"),
        number(3).alias("end"),
    )
