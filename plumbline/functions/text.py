"""Text expressions.

Patterns avoid ``\\b`` because the JVM's word boundary is Unicode-aware; the
ASCII look-arounds below keep the wanted ASCII meaning on accented text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as trimmed and collapsed in source text (Unicode set).
WS_SET = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{WS_SET}]"
WS_CHARS = (
    " \t\n\u000b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Runs that differ from one plain space; text is mostly single spaces, which need no rewriting.
ODD_RUN = f"[{WS_SET}&&[^ ]]{WS}*| {WS}+"
# A non-blank line, from its first visible character to its end.
NON_BLANK_LINE = f"[^{WS_SET}][^\\n]*+"

NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"

# Keywords kept verbatim by the token normaliser.
KEYWORDS = (
    "const let var function return if else for while switch case break continue new class extends super this "
    "import export default from async await yield try catch finally throw typeof instanceof in of do delete void "
    "null undefined true false interface type enum implements public private protected readonly static as "
    "satisfies keyof namespace abstract get set"
).split(" ")

# Token pattern of the normaliser.
TOKEN_RE = (
    r"//[^\n]*|/\*[\s\S]*?\*/|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[A-Za-z_$][\w$]*|\d[\w.]*"
    r"|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.\.\.|[{}()\[\];,.<>+\-*/%=!&|^~?:]"
)

# Lines that carry no duplication signal.
MIN_INTERESTING = 12
DULL_PREFIX_RE = (
    r"^(?:import(?![A-Za-z0-9_])|export\s+\{|export\s+\*|export\s+type(?![A-Za-z0-9_])|//|/\*|\*|@)"
)
BARE_NAME_RE = r"^[A-Za-z_$][\w$]*,?$"
PUNCTUATION_RE = r"^[)}\];,{(]+$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may inline a computed column at each of its uses; a lambda
    variable is never inlined. For values that are costly and used repeatedly.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rtrim_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def norm_ws(c: Column) -> Column:
    """Collapse white space to single spaces and trim."""
    return F.trim(F.regexp_replace(c, ODD_RUN, " "))


def strip_ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*(\.\.\.|…)\z", "")


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def non_blank_loc(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NON_BLANK_LINE)).cast("bigint")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def extract_tokens(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def words(c: Column) -> Column:
    """ASCII identifier-like runs."""
    return extract_tokens(c, r"[A-Za-z0-9_]+", 0)


def is_interesting(line: Column) -> Column:
    """Predicate on an already white-space-normalised line."""
    return (
        (F.length(line) >= MIN_INTERESTING)
        & ~line.rlike(DULL_PREFIX_RE)
        & ~line.rlike(BARE_NAME_RE)
        & ~line.rlike(PUNCTUATION_RE)
    )


def interesting_lines(c: Column) -> Column:
    """Ordered array of the normalised lines worth comparing."""
    return F.filter(F.transform(lines(c), norm_ws), is_interesting)


def strip_code(c: Column) -> Column:
    """Drop fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(c, r"```[\s\S]*?```", ""), r"`[^`\n]*`", "")


def raw_tokens(c: Column) -> Column:
    """Tokens as they stand, without comments."""
    return F.filter(extract_tokens(c, TOKEN_RE, 0), lambda t: ~(t.startswith("//") | t.startswith("/*")))


def normal_tokens(raw: Column) -> Column:
    """``raw`` tokens as I identifiers, N numbers, S strings, the rest verbatim."""

    def begins(t: Column, first: str, last: str) -> Column:
        """The first character lies from ``first`` to ``last`` (ASCII): strings compare by it, without a pattern."""
        return (t >= first) & (t < chr(ord(last) + 1))

    def normal(t: Column) -> Column:
        name = begins(t, "a", "z") | begins(t, "A", "Z") | begins(t, "_", "_") | begins(t, "$", "$")
        quote = begins(t, "`", "`") | begins(t, "'", "'") | begins(t, '"', '"')
        return F.when(name & ~t.isin(KEYWORDS), F.lit("I")).when(begins(t, "0", "9"), F.lit("N")).when(quote, F.lit("S")).otherwise(t)

    return F.transform(raw, normal)


def token_stream(c: Column) -> Column:
    """Normalised token array: I identifiers, N numbers, S strings, the rest verbatim."""
    return normal_tokens(raw_tokens(c))


def shingles(tokens: Column, k: int = 9) -> Column:
    """Distinct k-grams of a token array, each joined by a space."""
    return bind(
        tokens,
        lambda t: F.when(
            F.size(t) >= k,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.size(t) - F.lit(k - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " ")
                )
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def front_matter_block(c: Column) -> Column:
    """Text between the opening and closing ``---``; NULL when there is none."""
    block = F.regexp_extract(c, r"(?s)\A---(.*?)\n---", 1)
    return F.when(c.rlike(r"(?s)\A---.*?\n---"), block)


def unquote(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)\A\".*\"\z") | c.rlike(r"(?s)\A'.*'\z"), F.regexp_replace(c, r"(?s)\A.|.\z", "")).otherwise(c)


def front_matter(c: Column) -> Column:
    """Flat key to value map; the last of repeated keys wins."""
    pairs = F.transform(
        F.filter(F.split(front_matter_block(c), "\n"), lambda l: l.rlike(r"^[A-Za-z0-9_-]+:")),
        lambda l: F.struct(
            F.regexp_extract(l, r"^([A-Za-z0-9_-]+):", 1).alias("key"),
            unquote(trim_ws(F.regexp_replace(l, r"^[A-Za-z0-9_-]+:", ""))).alias("value"),
        ),
    )
    # Bound, as the pairs would otherwise be read from the text again for each of them.
    last_of_key = lambda ps: F.filter(
        ps,
        lambda p, i: ~F.exists(F.slice(ps, i + F.lit(2), F.size(ps)), lambda q: q["key"] == p["key"]),
    )
    return F.coalesce(F.map_from_entries(bind(pairs, last_of_key)), F.create_map().cast("map<string,string>"))


def body_of(c: Column) -> Column:
    """Text after the front matter, or the whole text."""
    return F.when(
        c.rlike(r"(?s)\A---.*?\n---"), F.regexp_replace(c, r"(?s)\A---.*?\n---[^\n]*(?:\n|\z)", "")
    ).otherwise(c)


def sections(c: Column, heading_re: str = r"##[ \t]+") -> Column:
    """``array<struct<heading, body>>``: text cut before each heading line, preamble first."""
    chunks = F.split(c, f"(?md)(?=^{heading_re})")
    return F.transform(
        F.filter(chunks, lambda s: F.length(s) > 0),
        lambda s: F.when(
            s.rlike(f"\\A{heading_re}"),
            F.struct(
                trim_ws(F.regexp_replace(F.regexp_extract(s, r"\A[^\n]*", 0), f"\\A{heading_re}", "")).alias("heading"),
                F.regexp_replace(s, r"\A[^\n]*\n?", "").alias("body"),
            ),
        ).otherwise(F.struct(F.lit("(preamble)").alias("heading"), s.alias("body"))),
    )


def table_cells(c: Column) -> Column:
    """Trimmed cells of a pipe-table row; outer pipes dropped."""
    bare = F.regexp_replace(trim_ws(c), r"\A\||\|\z", "")
    return F.transform(F.split(bare, r"\|"), trim_ws)


def is_table_row(c: Column) -> Column:
    """Pipe rows other than the separator row."""
    return c.rlike(r"^\|") & ~c.rlike(r"^\|[\s|:-]+\|?$")
