"""Text cleaning as Column expressions (all of it stays inside the JVM)."""

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv

# Every character Python's str.strip() removes.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

_ASCII_DROPPED = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


@lru_cache(maxsize=1)
def _fold_tables():
    """Split characters by what compatibility decomposition leaves of them in ASCII.

    Returns ``(source, target, wide, ranges)``: one-to-one pairs for ``translate``, a dict
    for the few characters (ligatures, fractions, unit signs) that become several, and a
    short character class covering those few.
    """
    source, target, wide = [], [], {}
    for point in range(128, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char)
                        if c.isascii() and c.isalnum())
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            wide[char] = plain
    # A class of few ranges is searched far faster than one naming each character.  Letters
    # with accents lie below U+2000 and stay outside; symbols in the gaps above do no harm.
    ranges = []
    for point in map(ord, wide):
        if ranges and point - ranges[-1][1] <= (1 if point < 0x2000 else 0x400):
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    covering = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return "".join(source), "".join(target), wide, f"[{covering}]"


def constant_map(mapping: dict) -> Column:
    """A map literal, as one constant rather than a node per entry."""
    packed = "\x1e".join(f"{key}\x1f{value}" for key, value in mapping.items())
    return F.str_to_map(F.lit(packed), F.lit("\x1e"), F.lit("\x1f"))


def normalise_key(c: Column) -> Column:
    """Accent-free, alphanumeric, upper-case join key; null becomes the empty string."""
    source, target, wide, ranges = _fold_tables()
    text = F.coalesce(c.cast("string"), F.lit(""))
    # One pass folds accents and drops plain punctuation; mostly nothing else is left.
    plain = F.translate(text, source + _ASCII_DROPPED, target)
    table = constant_map(wide)
    widened = F.array_join(
        F.transform(F.split(plain, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
    rest = F.when(plain.rlike(ranges), widened).otherwise(plain)
    cleaned = F.regexp_replace(rest, "[^0-9A-Za-z]+", "")
    return F.upper(F.when(plain.rlike("[^0-9A-Za-z]"), cleaned).otherwise(plain))


def strip(c: Column) -> Column:
    """Trim every kind of white space, tabs and line ends included."""
    return F.btrim(c, F.lit(WHITESPACE))


def contains_any(c: Column, pattern: str) -> Column:
    """Case-blind pattern search; null counts as no match."""
    return F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False))


def holds_word(columns, word: str = fv.SUBTOTAL_WORD) -> Column:
    """True where any of the columns holds ``word`` as a whole word.

    The columns are joined by a line end (which is no word character), so a row costs one
    pattern search however many columns there are.
    """
    joined = F.lower(F.concat_ws("\n", *[c.cast("string") for c in columns]))
    # The plain search settles nearly every row before the pattern is tried.
    return joined.contains(word) & joined.rlike(r"(?U)\b" + re.escape(word) + r"\b")


def drop_subtotals(df, columns=None, word: str = fv.SUBTOTAL_WORD):
    """Remove subtotal rows; columns the input lacks are ignored."""
    present = [c for c in (columns or fv.SUBTOTAL_COLUMNS) if c in df.columns]
    return df.filter(~holds_word([F.col(f"`{c}`") for c in present], word)) if present else df


def exclude_matching(df, column: str, pattern: str = fv.OWN_INSTITUTION):
    """Remove rows whose column holds the pattern in any case; nulls stay."""
    return df.filter(~contains_any(F.col(column), pattern))


def strip_unit_name(c: Column) -> Column:
    """Training-unit name without institution prefix, capital sites merged."""
    c = F.regexp_replace(c, "(?U)" + fv.UNIT_PREFIX_PATTERN, "")
    c = F.regexp_replace(c, "(?U)" + fv.UNIT_CAPITAL_PATTERN, fv.UNIT_CAPITAL)
    return strip(c)


def strip_course_prefix(c: Column) -> Column:
    """Upper-case course title without its leading qualification."""
    return F.upper(strip(F.regexp_replace(F.upper(c), "(?iuU)" + fv.COURSE_PREFIX_PATTERN, "")))


def strip_titles(c: Column) -> Column:
    """Upper-case catalogue title with qualification words removed wherever they stand."""
    return ordered_rules(F.upper(c), [(prefix, "") for prefix in fv.TITLE_PREFIXES])


def clean_institution(c: Column) -> Column:
    """Institution name: upper case, no leading digits, dashes and slashes as one space."""
    c = F.regexp_replace(F.upper(c), r"(?U)^\d+", "")
    c = F.regexp_replace(c, "[-–/]", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _java_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def ordered_rules(c: Column, rules=None) -> Column:
    """Apply pattern rules in order, each only where it matched the original value.

    ``rules`` is a list of ``(pattern, replacement)``.  A rule replaces the matching part
    of what the rules before it left.  ``c`` should be a plain column: it is read once per
    rule.  Every link of the chain reads its predecessor once, so the expression grows
    linearly with the rules; a value no rule matches costs one search.
    """
    rules = fv.SCRAPED_INSTITUTIONS if rules is None else rules
    never = F.lit("(?!)")
    chain = c
    for pattern, replacement in rules:
        armed = F.when(c.rlike(pattern), F.lit(pattern)).otherwise(never)
        chain = F.regexp_replace(chain, armed, F.lit(_java_replacement(replacement)))
    any_rule = "|".join(f"(?:{pattern})" for pattern, _ in rules)
    return F.when(c.rlike(any_rule), chain).otherwise(c)


def first_match(c: Column, arms=None) -> Column:
    """Map a value by the first arm that fits (``=`` or ``LIKE``); others stay as they are."""
    arms = fv.CENSUS_INSTITUTIONS if arms is None else arms
    chain = F
    for kind, value, label in arms:
        chain = chain.when(c == F.lit(value) if kind == "=" else c.like(value), F.lit(label))
    return chain.otherwise(c)


def recode(c: Column, mapping: dict) -> Column:
    """Exact recode; values outside the mapping stay."""
    return F.coalesce(F.element_at(constant_map(mapping), c), c)


def keyword_class(c: Column, classes, other: str) -> Column:
    """Label of the first keyword list found in the text (case-blind), else ``other``."""
    chain = F
    for pattern, label in classes:
        chain = chain.when(contains_any(c, pattern), F.lit(label))
    return chain.otherwise(F.lit(other))


def keyword_repair(c: Column, repairs=None) -> Column:
    """Replace the whole value where a keyword is found in it."""
    chain = F
    for keyword, value in (fv.ITINERARY_REPAIRS if repairs is None else repairs):
        chain = chain.when(contains_any(c, keyword), F.lit(value))
    return chain.otherwise(c)


def occupation_code(c: Column) -> Column:
    """Digits of the first occupation code in the text, null where there is none."""
    found = F.regexp_extract(c, "(?U)" + fv.OCCUPATION_CODE_PATTERN, 1)
    return F.nullif(F.regexp_replace(found, r"(?U)\D", ""), F.lit(""))


def occupation_family(c: Column) -> Column:
    """Part of the code before a dash."""
    return F.split(c, "-")[0]


def code_family(c: Column) -> Column:
    """First four characters of the code."""
    return F.substring(c.cast("string"), 1, 4)


def display_name(c: Column, names: dict = None) -> Column:
    """Name shown to people; the raw name where none is set."""
    return recode(c, names or fv.DISPLAY_NAMES)


def student_key(document: Column, registration: Column) -> Column:
    """Student key; personal data leaves this function only as a digest."""
    return F.sha2(F.concat_ws("|", document.cast("string"), registration.cast("string")), 256)


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (strip(c) != "")
