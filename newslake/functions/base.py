"""Small Column helpers shared by the text, URL and tagging functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_META = set("\\.^$|?*+()[]{}")


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnOrName) -> Column:
    """Null-safe text: null counts as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: ColumnOrName) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c: ColumnOrName) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def squeeze(c: ColumnOrName) -> Column:
    """Collapse whitespace runs to one space and strip the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def lines(c: ColumnOrName) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(col(c), r"\R"), strip), lambda ln: ln != "")


def words(c: ColumnOrName) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: ColumnOrName) -> Column:
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def quote(literal: str) -> str:
    """Escape a literal for a regular expression."""
    return "".join("\\" + ch if ch in _META else ch for ch in literal)


def any_of(phrases: Iterable[str]) -> str:
    """One alternation that matches any of the literal phrases."""
    return "|".join(quote(p) for p in phrases)


def contains_any(c: ColumnOrName, phrases: Iterable[str]) -> Column:
    """True if the (already lower-cased) text contains one of the phrases.

    Phrases that contain another phrase add nothing, so only the minimal ones are
    tested; ``contains`` stays inside generated code.
    """
    unique = list(dict.fromkeys(phrases))
    minimal = [p for p in unique if not any(q != p and q in p for q in unique)]
    found = F.lit(False)
    for p in minimal:
        found = found | F.contains(col(c), F.lit(p))
    return found


def hits(c: ColumnOrName, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur in the text (each counted once)."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(col(c), F.lit(p)).cast("int")
    return total


def blank_to_null(c: ColumnOrName) -> Column:
    return F.when(strip(c) != "", col(c))


def first_filled(*cols: ColumnOrName) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(col(c) != "", col(c)) for c in cols])


def count_chars(c: ColumnOrName, char_class: str) -> Column:
    """Number of characters of the class, e.g. ``а-яё``."""
    return F.length(F.regexp_replace(col(c), f"[^{char_class}]+", ""))


def rfind(c: ColumnOrName, needle: str) -> Column:
    """Zero-based position of the last occurrence of one character, -1 if absent."""
    pos = F.instr(F.reverse(col(c)), needle)
    return F.when(pos > 0, F.length(col(c)) - pos).otherwise(F.lit(-1))


def prefix(c: ColumnOrName, n: int | Column) -> Column:
    return F.substring(col(c), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def keep_first(arr: Column, key: Callable[[Column], Column] = lambda x: x, limit: int | None = None) -> Column:
    """Order-preserving distinct by a key of each element, or the first ``limit`` of it; elements with a null key are left out."""

    def kept(p: Column) -> Column:
        found = F.filter(F.array_distinct(p["keys"]), lambda k: k.isNotNull())
        found = found if limit is None else F.slice(found, 1, limit)
        return F.transform(found, lambda k: F.get(p["arr"], F.array_position(p["keys"], k).cast("int") - 1))

    return let(let(arr, lambda a: F.struct(a.alias("arr"), F.transform(a, key).alias("keys"))), kept)


def lookup(c: ColumnOrName, table: dict[str, str], default: Column | None = None) -> Column:
    """Map a value through a small constant table."""
    key = col(c)
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times.

    Repeating a Column repeats its whole expression tree; binding it to a lambda
    variable keeps plans small and evaluates the value a single time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
