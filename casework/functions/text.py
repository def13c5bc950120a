"""Column functions for cleaning text, labels, flags, numbers and ids."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions import terms

# Every character Python's str.strip() removes; SQL trim alone removes the space only.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_column(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.trim(as_column(c), F.lit(BLANKS))


def normalize_label(c) -> Column:
    """Strip blanks and lower-case."""
    return F.lower(strip(c))


def normalize_bool(c, variant: str = "harness") -> Column:
    """Read a text flag.

    ``harness`` strips blanks, also knows ``t`` and reads null as false;
    ``dashboard`` only lower-cases and keeps null. Anything unknown is false.
    """
    words = terms.TRUE_WORDS[variant]
    c = as_column(c).cast("string")
    if variant == "harness":
        return F.coalesce(normalize_label(c).isin(*words), F.lit(False))
    return F.lower(c).isin(*words)


def flag(df, name: str, variant: str = "harness") -> Column:
    """``normalize_bool`` that respects the column's type: booleans pass, numbers test != 0.

    A half-labelled table reloaded with 1.0 / 0.0 therefore keeps its true rows.
    """
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    if kind == "string":
        return normalize_bool(c, variant)
    value = c if kind == "boolean" else c != 0
    return F.coalesce(value, F.lit(False)) if variant == "harness" else value


def normalize_id(c) -> Column:
    """Float-like id text (``1.23e18``, ``12.0``) to bigint without passing through double."""
    exact = strip(as_column(c).cast("string")).try_cast("decimal(32,6)")
    whole = exact.try_cast("decimal(26,0)")
    return F.when(exact == whole, whole.try_cast("bigint"))


def numeric_or_null(c) -> Column:
    """Number, or null for anything else; NaN counts as null."""
    text = as_column(c).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def min_length(c, chars: int = terms.MIN_TWEET_CHARS) -> Column:
    """Strictly longer than ``chars`` characters; null is not."""
    return F.length(as_column(c)) > chars


def has_reply(c) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def preview(c, chars: int = 100, ellipsis: bool = False) -> Column:
    head = F.substring(F.coalesce(as_column(c), F.lit("")), 1, chars)
    return F.concat(head, F.lit("...")) if ellipsis else head


def clip_reply(c, limit: int = terms.MAX_REPLY_CHARS) -> Column:
    """Remove one pair of enclosing quotes, then shorten to ``limit`` characters."""
    c = strip(c)
    quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    bare = F.when(quoted, strip(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    cut = F.rtrim(F.substring(bare, 1, limit - 3), F.lit(BLANKS))
    return F.when(F.length(bare) > limit, F.concat(cut, F.lit("..."))).otherwise(bare)


def message_status(c, limit: int | None = terms.MAX_MESSAGE_CHARS) -> Column:
    """``ok``, ``missing``, ``empty`` or, if there is a limit, ``too_long`` for one message."""
    size = F.length(strip(c))
    status = F.when(as_column(c).isNull(), "missing").when(size == 0, "empty")
    if limit is not None:
        status = status.when(size > limit, "too_long")
    return status.otherwise("ok")


def any_term(lowered, words) -> Column:
    """True if the lower-cased text contains any of the words (plain substrings)."""
    lowered = as_column(lowered)
    return reduce(or_, [lowered.contains(w) for w in terms.shortest(words)])


def escalation_class(c) -> Column:
    c = as_column(c)
    return F.when(c, terms.ESCALATE_CLASS).when(~c, terms.REPLY_CLASS)


def case_id(prefix: str, number) -> Column:
    """``#FN-007`` style id from a prefix and a row number."""
    return F.format_string(prefix + "%03d", as_column(number))


def error_class(c) -> Column:
    """``model``, ``quota`` or ``other`` from the text of a failed request."""
    low = F.lower(as_column(c))
    return (
        F.when(any_term(low, terms.MODEL_ERROR_TERMS), "model")
        .when(any_term(low, terms.QUOTA_ERROR_TERMS), "quota")
        .otherwise("other")
    )


def half_even(c, digits: int) -> Column:
    """Round half to even; for displayed payloads only."""
    return F.bround(as_column(c), digits)


def percent(c, digits: int = 2) -> Column:
    return half_even(as_column(c) * 100, digits)
