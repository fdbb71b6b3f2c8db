"""Scalar expressions: numbers, dates, text and hash-based randomness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from . import words

# Every character that Java's (?U)\s matches, and the four ASCII separators.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def q(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace (SQL ``trim`` removes spaces only).

    A pattern would be tried at every place of every cell.
    """
    return F.trim(text, F.lit(_SPACES))


def strict_number(text: Column) -> Column:
    """Plain number text to double; anything else is NULL.

    The pattern guard keeps engine-specific spellings such as ``1d`` out.
    """
    return F.when(text.rlike(rf"(?U)^\s*{words.NUMBER}\s*$"), text.try_cast("double"))


def starts_within(text: Column, first: str, after: str) -> Column:
    """Whether the first character is from ``first`` on and before ``after``: a comparison, far cheaper than a pattern."""
    return (text >= F.lit(first)) & (text < F.lit(after))


def coerce_numeric(text: Column) -> Column:
    """Number text with currency signs, thousands commas or accounting brackets.

    The sign is taken from brackets around the *original* text, so ``($5)`` is
    -5 while ``$(5)`` is +5. Ordinary words are rejected at their first letter, so
    long texts cost next to nothing, and plain numbers are read as they are.
    """
    plain = starts_within(text, "0", ":") & text.rlike(r"^[0-9]+\.?[0-9]*\z")
    word = starts_within(text, "A", "I") | starts_within(text, "J", "i") | starts_within(text, "j", "{")  # but for ``inf``
    bare = F.regexp_replace(text, r"(?U)[$€£¥,\s]", "")
    value = F.when(
        bare.rlike(rf"^(\({words.NUMBER}\)|{words.NUMBER})$"), F.translate(bare, "()", "").try_cast("double")
    )
    sign = F.when(text.rlike(r"(?U)^\s*\(.*\)\s*$"), -1.0).otherwise(1.0)
    # A sign after a digit (most dates): no number, whatever is taken out.
    spelt = ~word & ~text.rlike("[0-9][-+]") & text.rlike(r"(?U)^[-+$€£¥,\s().0-9eEinftyINFTY]+$")
    return F.when(plain, text.try_cast("double")).when(spelt, sign * value)


def title_case(text: Column) -> Column:
    """Capital after every non-letter. ``initcap`` alone only looks at spaces."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.when(text.rlike(r"[^\p{L} ]"), F.array_join(F.transform(pieces, F.initcap), "")).otherwise(
        F.initcap(text)
    )


# English month names by their first three letters.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MONTH_WORD = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_TIME = (
    r"(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?(?: ?([ap]m))?(?:Z)?)?"
)

# (pattern, rewrite to year|month|day|hour|minute|second|half); first match wins.
_DATE_SHAPES = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + "$", "$1|$2|$3"),
    (r"^(\d{4})(\d{2})(\d{2})" + _TIME + "$", "$1|$2|$3"),
    (r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})" + _TIME + "$", "$3|$2|$1"),
    (r"^(\d{1,2})(?:st|nd|rd|th)?[-/., ]+" + _MONTH_WORD + r"[-/., ]+(\d{4}|\d{2})" + _TIME + "$", "$3|$2|$1"),
    (r"^" + _MONTH_WORD + r"[-/., ]+(\d{1,2})(?:st|nd|rd|th)?[-/., ]+(\d{4})" + _TIME + "$", "$3|$1|$2"),
    (r"^(\d{4})[-/., ]+" + _MONTH_WORD + r"[-/., ]+(\d{1,2})" + _TIME + "$", "$1|$2|$3"),
]


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside ``body``: keeps long expressions small."""
    return F.transform(F.array(value), body)[0]


def _canonical_date(t: Column) -> Column:
    out = None
    for pattern, rewrite in _DATE_SHAPES:
        hit, text = t.rlike("(?i)" + pattern), F.regexp_replace(t, "(?i)" + pattern, rewrite + "|$4|$5|$6|$7")
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def _build_date(a: Column) -> Column:
    word = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(a[1], 1, 3))).cast("int")
    short = F.length(a[0]) == 2
    half = F.lower(a[6])
    # The decimal parser throws on empty text, which is the usual case.
    second = F.when(a[5] != "", a[5].try_cast(T.DecimalType(16, 6))).otherwise(F.lit(0).cast(T.DecimalType(16, 6)))

    def build(v: Column) -> Column:
        year = v[0] + F.when(short & (v[0] < 70), 2000).when(short, 1900).otherwise(0)
        swap = (v[1] > 12) & (v[2] <= 12)
        hour = F.coalesce(v[3], F.lit(0)) + (
            F.when((half == "pm") & (v[3] < 12), 12).when((half == "am") & (v[3] == 12), -12).otherwise(0)
        )
        return F.try_make_timestamp_ntz(
            year,
            F.when(swap, v[2]).otherwise(v[1]),
            F.when(swap, v[1]).otherwise(v[2]),
            hour,
            F.coalesce(v[4], F.lit(0)),
            second,
        )

    number = lambda i: F.when(a[i] != "", a[i].try_cast("int"))
    return let(F.array(number(0), F.coalesce(number(1), word), number(2), number(3), number(4)), build)


def _fixed_date(t: Column, year: int, month: int, day: int) -> Column:
    """Date of a text with its parts at fixed places, month and day swapped where only that can be meant."""
    part = lambda at, n: F.substring(t, at, n).try_cast("int")
    m, d, zero = part(month, 2), part(day, 2), F.lit(0)
    swap = (m > 12) & (d <= 12)
    return F.try_make_timestamp_ntz(
        part(year, 4), F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d), zero, zero, zero.cast(T.DecimalType(16, 6))
    )


def parse_mixed_date(text: Column) -> Column:
    """Date text in mixed layouts, day first, to ``timestamp_ntz``; else NULL.

    Pattern guards rewrite each layout to one order before a single
    ``try_make_timestamp_ntz``; a chain of ``try_to_timestamp`` formats would pay
    an exception per failed format and cell. Two-digit years mean 1970-2069, and a
    bare time of day is not a date, so no result depends on the clock. The two
    commonest layouts, of ten characters, are cut at their places instead.
    """
    canonical = let(strip(text), _canonical_date)
    parsed = let(F.split(canonical, r"\|"), _build_date)
    ten = starts_within(text, "0", ":") & (F.octet_length(text) == 10)
    return (
        F.when(ten & text.rlike(r"^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}\z"), _fixed_date(text, 1, 6, 9))
        .when(ten & text.rlike(r"^[0-9]{2}[-/. ][0-9]{2}[-/. ][0-9]{4}\z"), _fixed_date(text, 7, 4, 1))
        .when(text.rlike(r"(?U)^\s*[0-9A-Za-z][0-9A-Za-z:., /+-]{5,39}\s*$"), parsed)
    )


def hash52(*parts) -> Column:
    """52-bit non-negative integer from the text of its parts.

    md5 rather than xxhash64 because any SQL engine can repeat it; the value
    depends on the cells alone, never on partitioning.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    # A gap has a mark of its own, else (NULL, 1) and (1, NULL) would draw alike.
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """Hash-based number in [0, 1)."""
    return hash52(*parts) / F.lit(float(2**52))


def gaussian(*parts) -> Column:
    """Hash-based standard normal value (Box-Muller on two hashes)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - unit("r", *parts)))
    return radius * F.cos(2.0 * 3.141592653589793 * unit("a", *parts))


def digamma(n: Column) -> Column:
    """Digamma for n >= 1: recurrence up to n + 6, then the asymptotic series."""
    x = n.cast("double")
    shift = reduce(lambda a, b: a + b, [1.0 / (x + float(i)) for i in range(6)])
    z = x + 6.0
    z2 = z * z
    series = F.log(z) - 0.5 / z - 1.0 / (12.0 * z2) + 1.0 / (120.0 * z2 * z2) - 1.0 / (252.0 * z2 * z2 * z2)
    return series - shift
