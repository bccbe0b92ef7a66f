"""Hashes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import ODD_RUN, rtrim_ws, trim_ws

# Fixed value: stands in for an absent symbol.
NO_SYMBOL = "<no-symbol>"
# 32-bit FNV-1a offset basis and prime.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units; the exact small-data hash."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"))
    return F.aggregate(
        units,
        F.lit(FNV_BASIS).cast("bigint"),
        lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def line_hash(c: Column, algorithm: str = "xxhash64") -> Column:
    """BIGINT hash of a string.

    ``xxhash64`` (64 bits) is the choice at scale; ``md5`` gives a value other
    engines can reproduce; ``fnv1a`` gives the 32-bit value used for exact
    comparison on small inputs.
    """
    if algorithm == "xxhash64":
        return F.xxhash64(c)
    if algorithm == "md5":
        return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")
    if algorithm == "fnv1a":
        return fnv1a(c)
    raise ValueError(f"unknown hash: {algorithm}")


def body_hash(c: Column) -> Column:
    return F.sha2(rtrim_ws(F.regexp_replace(c, r"\r\n", "\n")), 256)


def fingerprint_norm(line: Column) -> Column:
    """Structural skeleton of a quoted line: comments and layout removed."""
    s = F.regexp_replace(trim_ws(line), r"(?<!:)//[^\n]*\z", "")
    s = F.regexp_replace(s, ODD_RUN, " ")
    s = F.regexp_replace(s, r" +([()\[\]{},;:=]) *|([()\[\]{},;:=]) +", "$1$2")
    s = F.regexp_replace(s, r"([,;:])", "$1 ")
    return F.trim(F.regexp_replace(s, r"  +", " "))


def fingerprint_lines(quoted: Column) -> Column:
    return F.filter(F.transform(quoted, fingerprint_norm), lambda l: F.length(l) > 0)


def fingerprint(lens: Column, quoted: Column, symbol: Column) -> Column:
    """16 hex digits of SHA-256 over lens, normalised lines and symbol, NUL-joined."""
    parts = F.concat(F.array(lens), fingerprint_lines(quoted), F.array(F.coalesce(symbol, F.lit(NO_SYMBOL))))
    return F.substring(F.sha2(F.array_join(parts, "\0"), 256), 1, 16)


def fingerprint_error(lens: Column, quoted: Column) -> Column:
    """NULL when the record can be fingerprinted, else a code: which part is absent, empty or of another type."""
    no_quote = F.coalesce(F.size(quoted) == 0, F.lit(True))
    return (
        F.when(F.coalesce(F.length(trim_ws(lens)) == 0, F.lit(True)), F.lit("lens_empty"))
        .when(no_quote, F.when(quoted.isNull(), F.lit("quoted_absent")).otherwise(F.lit("quoted_empty")))
        .when(F.exists(quoted, F.isnull), F.lit("quoted_not_text"))
        .when(F.size(fingerprint_lines(quoted)) == 0, F.lit("quoted_blank"))
    )
