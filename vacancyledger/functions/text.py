"""Text expressions: cleaning, HTML to text, case folding, tokens, phrases."""

from __future__ import annotations

import html
import sys
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space (Unicode's plus the four information separators), line ends, what a
# token is, and what counts as a tag in a text.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TOKEN = r"[a-z0-9+#.]{2,}"
TAG_IN_TEXT = r"<\s*[a-zA-Z][^>]*>"

# Words that never count as evidence of overlap.
STOPWORDS = (
    "and", "are", "for", "from", "has", "have", "into", "job", "our", "role", "team",
    "that", "the", "their", "this", "will", "with", "work", "years", "you", "your",
)

_MARKUP = (
    r"(?s)<!--.*?-->"
    r"|(?i)<(script|style|template)\b[^>]*>.*?</\1\s*>"
    r"|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"""|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"|</?[a-zA-Z][^>]*>"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """Compute the columns of ``df`` here, once, and drop rows that fail ``keep``.

    Spark moves a filter below the projection that feeds it and then evaluates the filtered
    expressions twice, Python steps included. A generator of zero or one row is not moved. It
    also stops column pruning, so select what is needed first.
    """
    row = F.array(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(F.inline(row if keep is None else F.when(keep, row)))


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` strips only spaces)."""
    return F.regexp_replace(col, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def strip_long(col: Column) -> Column:
    """``strip_ws`` of a long text, which is searched only if its first or last character is white space.
    The value is read more than once, so hand in a plain column."""
    ends = F.concat(F.substring(col, 1, 1), F.substring(col, -1, 1))
    return F.when(ends.rlike(WHITESPACE), strip_ws(col)).otherwise(col)


def not_blank(col: Column) -> Column:
    """Whether ``strip_ws`` leaves something; reads no further than the first character that stays."""
    return col.rlike(rf"[^{WHITESPACE[1:]}")


def blank_to_null(col: Column) -> Column:
    return let(col, lambda v: F.when(F.length(v) > 0, v))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if v is not None else None)


@F.pandas_udf(T.StringType())
def _unescape_twice(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(html.unescape(v)) if v is not None else None)


def unescape(col: Column, twice: bool = False) -> Column:
    """Resolve character references; only values holding an ampersand reach Python. The value is
    read more than once, so hand in a plain column (see ``with_unescaped``)."""
    resolve = _unescape_twice if twice else _unescape
    return F.coalesce(resolve(F.when(col.contains("&"), col)), col)


def with_unescaped(
    df: DataFrame, values: dict[str, Column], twice: tuple[str, ...] = ()
) -> DataFrame:
    """Add computed columns with their character references resolved, all in one Python step.
    The values are computed in a projection of their own, so each is computed once."""
    staged = df.withColumns(values)
    return staged.withColumns({n: unescape(F.col(n), n in twice) for n in values})


def collapse_ws(col: Column) -> Column:
    """Runs of white space become one space; empty becomes null. No entity handling."""
    # Single spaces, by far the most common run, are left in place rather than replaced.
    run = rf" {WHITESPACE}+|[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]{WHITESPACE}*"
    return blank_to_null(F.trim(F.regexp_replace(col, run, " ")))


def clean_text(col: Column) -> Column:
    """Resolve entities, collapse white space, strip; empty becomes null."""
    return collapse_ws(unescape(col))


def strip_markup(col: Column) -> Column:
    """Replace comments, scripts, styles and tags by a space."""
    return F.when(col.contains("<"), F.regexp_replace(col, _MARKUP, " ")).otherwise(col)


def with_html_text(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add the visible text of HTML columns: markup out, entities resolved in the text and once
    more after, white space collapsed."""
    staged = with_unescaped(
        df, {n: strip_markup(v) for n, v in values.items()}, twice=tuple(values)
    )
    return staged.withColumns({n: collapse_ws(F.col(n)) for n in values})


def cap(col: Column, limit: int) -> Column:
    """First ``limit`` characters: a length rule of the data model, see callers."""
    return F.substring(col, 1, limit)


# Letters of Western texts that fold to something else; replaced directly.
_COMMON_FOLDS = {"ß": "ss", "ſ": "s", "µ": "μ", "ŉ": "ʼn"}


def _fold_common(col: Column) -> Column:
    out = F.lower(col)
    for char, folded in _COMMON_FOLDS.items():
        out = F.replace(out, F.lit(char), F.lit(folded))
    return out


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Where full case folding differs from lower-casing, derived from the running Unicode data."""
    single_from, single_to, multi = [], [], {}
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        lowered, folded = char.lower(), char.casefold()
        if lowered != char or lowered == folded or char in _COMMON_FOLDS:
            continue
        if len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        else:
            multi[char] = folded
    return "".join(single_from), "".join(single_to), multi


def _char_class(chars: list[str]) -> str:
    """Regular-expression class of characters, neighbours joined to ranges."""
    points = sorted(ord(c) for c in chars)
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def fold(col: Column) -> Column:
    """Case folding: ``lower`` plus the characters whose folded form differs from it. Texts
    within Latin letters skip the second part after one cheap test."""
    single_from, single_to, multi = _fold_tables()
    lowered, common = F.lower(col), _fold_common(col)
    special = [*single_from, *multi]
    rare = lowered.rlike(_char_class(special))
    pairs = ",".join(f"{char}={folded}" for char, folded in multi.items())
    mapping = F.str_to_map(F.lit(pairs), F.lit(","), F.lit("="))
    expanded = F.array_join(
        F.transform(F.split(common, ""), lambda c: F.coalesce(F.try_element_at(mapping, c), c)), ""
    )
    ascii_only = F.octet_length(col) == F.length(col)
    latin = [c for c in _COMMON_FOLDS if ord(c) < 256]
    after = min(ord(c) for c in [*special, *_COMMON_FOLDS] if ord(c) >= 256)
    # Searching and replacing cost far more than lower-casing, so most texts should need neither.
    other = lowered.rlike(f"[{''.join(latin)}\\x{{{after:x}}}-\\x{{10ffff}}]")
    first = lowered.rlike(f"[\\x{{{min(map(ord, special)):x}}}-\\x{{10ffff}}]")
    return (
        F.when(ascii_only | ~other, lowered)
        .when(first & rare, F.translate(expanded, single_from, single_to))
        .otherwise(common)
    )


@lru_cache(maxsize=1)
def _ascii_folds() -> dict[str, str]:
    """Characters whose case folding holds a token character that lower-casing does not give:
    sharp s, long s, ligatures and a few letters with marks, derived from the Unicode data."""
    plain = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+#.")
    return {
        c: c.casefold()
        for c in map(chr, range(128, sys.maxunicode + 1))
        if c == c.lower() != c.casefold() and plain & set(c.casefold())
    }


def fold_simple(col: Column) -> Column:
    """``fold`` restricted to what can change an ASCII token: lower-casing and the characters that
    fold to ASCII letters. Texts without one of these pay one test."""
    folds = _ascii_folds()

    def replaced(lowered: Column) -> Column:
        out = lowered
        for char, folded in folds.items():
            out = F.replace(out, F.lit(char), F.lit(folded))
        return F.when(lowered.rlike(_char_class(list(folds))), out).otherwise(lowered)

    return let(F.lower(col), replaced)


def tokens(col: Column) -> Column:
    """Distinct tokens of two or more of ``a-z0-9+#.``, stop words removed."""
    found = F.regexp_extract_all(fold_simple(col), F.lit(TOKEN), 0)
    return F.array_except(found, F.split(F.lit(",".join(STOPWORDS)), ","))


def drop_stopwords(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: ~t.isin(*STOPWORDS))


def phrase_present(phrase: Column, text: Column) -> Column:
    """Case-insensitive substring test of the stripped phrase."""
    return F.contains(fold(text), strip_ws(fold(phrase)))


def clean_list(values: Column) -> Column:
    """Strip items, drop blanks, drop case-insensitive repeats; the first spelling stays."""
    stripped = F.filter(F.transform(values, strip_ws), lambda v: F.length(v) > 0)

    # Array positions are 1-based, lambda indexes 0-based.
    def first_spellings(items: Column) -> Column:
        return let(
            F.transform(items, fold),
            lambda keys: F.filter(
                items, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1
            ),
        )

    return let(stripped, first_spellings)


def split_list(col: Column) -> Column:
    """Comma-separated text to a list of trimmed non-empty items."""
    return F.filter(F.transform(F.split(col, ","), strip_ws), lambda v: F.length(v) > 0)


def text_lines(col: Column) -> Column:
    """Stripped non-blank lines."""
    return F.filter(F.transform(F.split(col, LINE_BREAK), strip_ws), lambda v: F.length(v) > 0)


def missing_terms(required: Column, found: Column) -> Column:
    """Required terms that were not found, repeats kept."""
    return F.filter(required, lambda t: ~F.array_contains(found, t))


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    normalised = values.str.normalize("NFKD")
    return normalised.str.encode("ascii", "ignore").str.decode("ascii")


def slug(col: Column) -> Column:
    """ASCII letters and digits joined by '-', or 'job'. Only non-ASCII values reach Python."""
    plain = F.when(~col.rlike(r"^[\x00-\x7f]*$"), col)
    ascii_text = F.coalesce(_ascii_fold(plain), F.when(plain.isNull(), col))
    dashed = F.regexp_replace(F.regexp_replace(ascii_text, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(dashed), F.lit("job"))
