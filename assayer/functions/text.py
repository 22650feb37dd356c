"""Text expressions. All run on the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F, types as T


# The characters that count as white space when a value is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Texts that stand for "no value" once trimmed and upper-cased.
PLACEHOLDERS = ["", "NULL", "NONE", "NA", "N/A", "NAN", "BLANK", "-", "--", "---"]

CASED = r"\p{Lu}\p{Ll}\p{Lt}"
# A lower-case letter at the start of a run of letters, or a capital inside one.
NOT_TITLE = rf"(?:^|[^{CASED}])\p{{Ll}}|[{CASED}][\p{{Lu}}\p{{Lt}}]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def meaningful(c: Column) -> Column:
    """A value that is neither null nor a placeholder."""
    return F.coalesce(~F.upper(strip(c)).isin(PLACEHOLDERS), F.lit(False))


def stringify(c: Column, data_type: T.DataType) -> Column:
    """String form for pattern matching: whole doubles lose ``.0`` and a missing double is empty."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e18))
        shown = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(shown)
    return c if isinstance(data_type, T.StringType) else c.cast("string")


def from_start(pattern: str) -> str:
    """The pattern bound to the start of the value, as a prefix match."""
    flags = re.match(r"^\(\?[a-zA-Z]+\)", pattern)
    head = flags.group(0) if flags else ""
    return f"{head}^(?:{pattern[len(head):]})"


def java_pattern(pattern: str) -> str:
    """Named groups are the one construct users write that Java spells differently."""
    return pattern.replace("(?P<", "(?<")


def java_replacement(replacement: str) -> str:
    r"""``\1`` group references become ``$1``; a literal dollar is escaped."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(from_start(java_pattern(pattern)))


def title_case(c: Column) -> Column:
    """Every run of letters capitalised (``O'neil`` becomes ``O'Neil``)."""
    runs = F.regexp_extract_all(c, F.lit(f"([{CASED}]+|[^{CASED}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(r.substr(1, 1)), F.lower(F.substring(r, 2, 2147483647)))), "")


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def is_lower(c: Column) -> Column:
    return c.rlike(r"\p{Ll}") & ~c.rlike(r"[\p{Lu}\p{Lt}]")


def is_title(c: Column) -> Column:
    return c.rlike(f"[{CASED}]") & ~c.rlike(NOT_TITLE)


def case_class(c: Column) -> Column:
    """upper, lower, title, mixed or other (no letters); null stays null."""
    has_upper, has_lower = c.rlike(r"\p{Lu}"), c.rlike(r"\p{Ll}")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(~c.rlike(r"\p{L}"), "other")
        .when(has_upper & ~has_lower, "upper")
        .when(has_lower & ~has_upper, "lower")
        .when(~c.rlike(NOT_TITLE), "title")
        .otherwise("mixed")
    )


def mask(c: Column) -> Column:
    """Character mask used by the format rule.

    Digits are marked first and letters second, so the digit mark is itself overwritten by
    the letter mark: the mask tells alphanumeric positions from the rest.
    """
    return F.regexp_replace(F.regexp_replace(c, r"\d", "N"), "[A-Za-z]", "A")


def decimals(c: Column) -> Column:
    """Digits after the point when the number is printed with 15 significant digits."""
    shown = F.format_string("%.14e", c.cast("double"))
    digits = F.length(F.rtrim(F.regexp_replace(F.substring_index(shown, "e", 1), "[.-]", ""), F.lit("0")))
    power = F.substring_index(shown, "e", -1).cast("int")
    # Outside this range the printed form is scientific and its exponent counts as well.
    exponent_text = F.length(F.regexp_replace(F.substring_index(shown, "e", -1), r"^([+-])", "e$1"))
    plain = F.greatest(F.lit(0), digits - 1 - power)
    scientific = F.when(digits > 1, digits - 1 + exponent_text).otherwise(0)
    return F.when(c == 0, 0).when(power.between(-4, 14), plain).otherwise(scientific)


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form is ASCII once combining marks are dropped."""
    source, target, longer = [], [], {}
    for point in range(0x80, 0x10000):
        char = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
        if plain == char or not plain.isascii() or not plain.isalnum():
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif unicodedata.category(char).startswith("L"):
            longer[char] = plain
    return "".join(source), "".join(target), longer


def unaccent(c: Column) -> Column:
    source, target, longer = _accents()
    plain = F.translate(c, source, target)
    spelled = plain
    for char, letters in longer.items():
        if char < "\u2000" or char >= "\ufb00":
            spelled = F.replace(spelled, F.lit(char), F.lit(letters))
    rare = "".join(ch for ch in longer if ch < "\u2000" or ch >= "\ufb00")
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).when(c.rlike(f"[{rare}]"), spelled).otherwise(plain)


def fold_key(c: Column) -> Column:
    """Spelling key: no accents, lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "")


def normal_form(c: Column) -> Column:
    """Form in which two texts are compared: lower, no punctuation, single spaces, no accents."""
    words = F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s]", "")
    return unaccent(strip(F.regexp_replace(words, r"(?U)\s+", " ")))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy"]


def to_time(c: Column, data_type: T.DataType, formats: list[str] | None = None) -> Column:
    """Timestamp, or null when the text fits none of the formats."""
    if not isinstance(data_type, T.StringType):
        return c.cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(strip(c), F.lit(f)) for f in (formats or DATE_FORMATS)])


def whitespace_issues(c: Column) -> dict[str, Column]:
    return {
        "leading": c.rlike(r"^(?U)\s"),
        "trailing": c.rlike(r"(?U)\s$|\n\z"),
        "doublespace": c.rlike(r"(?U)\s{2,}"),
        "control_chars": c.rlike(r"[\x00-\x1f\x7f]"),
    }
