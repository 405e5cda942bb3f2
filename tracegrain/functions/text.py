"""Row-level text functions. Everything here is a native Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masking patterns (applied in this order) and the names they leave behind.
MASK_RULES = (
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "TIMESTAMP"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "IP"),
    (r"\b[0-9]+\b", "NUM"),
)

# Severity words in the order they are tried, and the names shown for each code.
LEVEL_WORDS = (
    ("DEBUG", 0),
    ("INFO", 1),
    ("WARN", 2),
    ("WARNING", 2),
    ("ERROR", 3),
    ("CRITICAL", 4),
    ("FATAL", 4),
)
LEVEL_NAMES = {0: "DEBUG", 1: "INFO", 2: "WARNING", 3: "ERROR", 4: "CRITICAL"}
DEFAULT_LEVEL = 1

HOUR_PATTERN = r"\b(\d{2}):\d{2}:\d{2}\b"
WILDCARD = "<*>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask(raw: Column | str, rules=MASK_RULES, prefix: str = "<", suffix: str = ">") -> Column:
    """Replace variable fields by their mask name, one rule after the other."""
    out = _col(raw)
    for pattern, name in rules:
        replacement = f"{prefix}{name}{suffix}".replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, pattern, replacement)
    return out


def tokens(text: Column | str, lower: bool = False) -> Column:
    """Whitespace-separated words; an empty or blank text has none."""
    text = _col(text)
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(r"\S+"), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def generalize_digits(token: Column) -> Column:
    return F.when(has_digit(token), F.lit(WILDCARD)).otherwise(token)


def fast_template(masked: Column | str) -> Column:
    """Template without any clustering: every word that holds a digit becomes a wildcard."""
    return F.array_join(F.transform(tokens(masked), generalize_digits), " ")


def extract_level(raw: Column | str, word_match: bool = False) -> Column:
    """Severity code 0-4. The first word of LEVEL_WORDS found anywhere in the line decides.

    ``word_match`` asks for whole words instead, so that "information" is no INFO.
    """
    return level_of_upper(F.upper(_col(raw)), word_match)


def level_of_upper(upper: Column | str, word_match: bool = False) -> Column:
    """``extract_level`` of a line that is upper case already."""
    upper, found = _col(upper), F
    for word, code in LEVEL_WORDS:
        hit = upper.rlike(rf"\b{word}\b") if word_match else upper.contains(word)
        found = found.when(hit, F.lit(code))
    return found.otherwise(F.lit(DEFAULT_LEVEL)).cast("int")


def extract_hour(raw: Column | str, strict: bool = False) -> Column:
    """Hour of the first hh:mm:ss in the line, -1 if there is none.

    The value is not range checked unless ``strict``, which turns 24-99 into -1.
    """
    hour = F.coalesce(
        F.regexp_extract(_col(raw), HOUR_PATTERN, 1).try_cast("int"), F.lit(-1)
    )
    return F.when(hour > 23, F.lit(-1)).otherwise(hour) if strict else hour


def level_name(code: Column | str, default: str | None = None) -> Column:
    """Name of a severity code; unknown codes give ``default`` (null unless set)."""
    code = _col(code)
    name = F
    for value, text in LEVEL_NAMES.items():
        name = name.when(code == value, F.lit(text))
    return name.otherwise(F.lit(default).cast("string"))


def is_severe(code: Column | str) -> Column:
    return F.coalesce(_col(code).isin(3, 4), F.lit(False))


def severity_pct(score: Column | str) -> Column:
    """Bar length of a score in percent, at most 100."""
    return F.least(F.abs(_col(score)) * 100, F.lit(100.0))


def is_highlighted(score: Column | str) -> Column:
    return F.abs(_col(score)) > 0.5


def snippet(text: Column | str, length: int, ellipsis: str = "") -> Column:
    """The first ``length`` characters; ``ellipsis`` is added only when something was cut."""
    text = _col(text)
    cut = F.substring(text, 1, length)
    if not ellipsis:
        return cut
    return F.when(F.length(text) > length, F.concat(cut, F.lit(ellipsis))).otherwise(text)


def round_score(score: Column | str, digits: int = 4) -> Column:
    return F.round(_col(score), digits)


def extract_parameters(masked: Column | str, template: Column | str) -> Column:
    """Words of the line that stand where its template has a wildcard."""
    picked = F.zip_with(
        tokens(masked), tokens(template), lambda word, slot: F.when(slot == WILDCARD, word)
    )
    return F.filter(picked, lambda word: word.isNotNull())
