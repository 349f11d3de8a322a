"""Text normalisation, containment and rule expressions as Columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from noticeloom import rules

# Unicode white space and the four separators that also count as such. The property class is
# about three times as fast as the same characters spelt out.
_SPACE = r"\s\x{1c}-\x{1f}"
WHITESPACE = f"(?U:[{_SPACE}])"
_SPACES = "".join(chr(code) for code in range(0x110000) if chr(code).isspace())
_ASCII_BRACKETS, _TORTOISE_BRACKETS = "[]", "〔〕"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_text(value: Column | str) -> Column:
    """Collapse runs of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(col(value), f"(?U)[{_SPACE}]+", " "))


def strip(value: Column | str) -> Column:
    """Remove Unicode white space from both ends only."""
    return F.btrim(col(value), F.lit(_SPACES))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it on, for use inside the lambda of an array function.

    An expression that a lambda refers to is otherwise computed again for every array item.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_blank(value: Column | str) -> Column:
    """True for NULL and for text of white space only."""
    return F.coalesce(~col(value).rlike(f"(?U)[^{_SPACE}]"), F.lit(True))


def null_if_blank(value: Column | str) -> Column:
    return F.when(~is_blank(value), col(value))


def first_nonblank(*values: Column | str) -> Column:
    """First value that is not blank after normalisation, else the empty string."""
    candidates = [F.nullif(normalize_text(value), F.lit("")) for value in values]
    return F.coalesce(*candidates, F.lit(""))


def contains_any(value: Column | str, terms: Iterable[str]) -> Column:
    """Substring test against a short term list; short-circuits inside codegen."""
    tests = [col(value).contains(term) for term in terms]
    return reduce(or_, tests) if tests else F.lit(False)


def title_filter(title: Column | str, markers: Sequence[str] = rules.TITLE_MARKERS) -> Column:
    """Keep titles of at least four characters that contain a marker."""
    return (F.char_length(col(title)) >= 4) & contains_any(title, markers)


def term_tier(
    text: Column | str, tiers: Sequence[tuple[int, Sequence[str]]], otherwise: Column | int
) -> Column:
    """Points of the first tier with a term in the text."""
    points = F.lit(None).cast("int")
    for value, terms in reversed(tiers):
        points = F.when(contains_any(text, terms), F.lit(value)).otherwise(points)
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.coalesce(points, rest)


def support_strength(
    text: Column | str,
    tiers: Sequence[tuple[int, Sequence[str]]] = rules.SUPPORT_TIERS,
    floor: int = rules.SUPPORT_FLOOR,
) -> Column:
    return term_tier(text, tiers, floor)


def leasing_strength(
    scenarios: Column | str,
    tiers: Sequence[tuple[int, Sequence[str]]] = rules.LEASING_TIERS,
    floor: int = rules.LEASING_FLOOR,
) -> Column:
    """Points by term tier over the joined scenarios; nothing said gives zero."""
    joined = F.array_join(col(scenarios), " ")
    return term_tier(joined, tiers, F.when(is_blank(joined), 0).otherwise(floor))


@F.pandas_udf(T.StringType())
def _compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(lambda value: unicodedata.normalize("NFKC", value), na_action="ignore")


def normalize_document_number(value: Column | str) -> Column:
    """Upper-cased compatibility form with tortoise-shell brackets and no white space."""
    folded = F.upper(_compatibility_form(col(value)))
    return F.regexp_replace(
        F.translate(folded, _ASCII_BRACKETS, _TORTOISE_BRACKETS), f"{WHITESPACE}+", ""
    )


def content_hash(text: Column | str) -> Column:
    return F.sha2(normalize_text(text), 256)


#: Lower-case letters in wide use whose case folding is another text.
_FOLDED_LOWER = {"ß": "ss", "ς": "σ", "µ": "μ", "ſ": "s"}
#: Blocks where lower case folds all but a few letters: Latin to Armenian, Latin additional, punctuation,
#: signs, Chinese and other scripts without case, full-width forms, pictures.
_COMMON_BLOCKS = (
    (0x00, 0x588), (0x1E00, 0x1EFF), (0x2000, 0x20FF), (0x2200, 0x24B5), (0x2500, 0x2BFF), (0x3000, 0xA63F),
    (0xAC00, 0xD7FF), (0xE000, 0xFAFF), (0xFE00, 0xFFFF), (0x1F000, 0x3FFFF),
)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str], str]:
    """Letters that folding changes, one to one and one to several, and a pattern of the rare ones.

    Rare is what lies outside the common blocks, and in them what lower case, then ``_FOLDED_LOWER``, does
    not fold.
    """
    changed, safe = {}, []
    for code in range(sys.maxunicode + 1):
        letter = chr(code)
        folded = letter.casefold()
        if folded != letter and not 0xD800 <= code <= 0xDFFF:
            changed[letter] = folded
    for low, high in _COMMON_BLOCKS:
        rare = [
            code
            for code in range(low, high + 1)
            if (folded := changed.get(chr(code)))
            and (len(chr(code).lower()) > 1 or _FOLDED_LOWER.get(chr(code).lower(), chr(code).lower()) != folded)
        ]
        safe += zip([low, *(code + 1 for code in rare)], [*(code - 1 for code in rare), high], strict=True)
    ranges = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in safe if low <= high)
    single = {letter: folded for letter, folded in changed.items() if len(folded) == 1}
    several = {letter: folded for letter, folded in changed.items() if len(folded) > 1}
    return "".join(single), "".join(single.values()), several, f"[^{ranges}]"


def case_folded(text: Column | str) -> Column:
    """Full Unicode case folding: lower case, and letter by letter only where a text has a rare letter."""
    before, after, several, rare = _folds()
    plain = F.lower(col(text))
    for letter, folded in _FOLDED_LOWER.items():
        plain = F.replace(plain, F.lit(letter), F.lit(folded))
    spelled = F.translate(col(text), before, after)
    for letter, folded in several.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(folded))
    return F.when(col(text).rlike(rare), spelled).otherwise(plain)


def search(
    query: str,
    columns: Sequence[Column | str],
    source: Column | str | None = None,
    source_id: str = "",
) -> Column:
    """Case-folded substring over the space-joined columns; a blank query passes all."""
    wanted = query.casefold().strip()
    hit = F.lit(True)
    if wanted:
        joined = F.concat_ws(
            " ", *[F.coalesce(col(name).cast("string"), F.lit("")) for name in columns]
        )
        hit = case_folded(joined).contains(wanted)
    if source is not None and source_id:
        hit = (col(source) == source_id) & hit
    return hit


def _either(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def overpromise_pattern(promises: Sequence[str], benefits: Sequence[str], gap: int = 12) -> str:
    """A promise word and a benefit word at most ``gap`` characters apart, in either order."""
    promise, benefit = _either(promises), _either(benefits)
    near = f".{{0,{gap}}}"
    return f"(?s){promise}{near}{benefit}|{benefit}{near}{promise}"


def backstop_pattern(
    authorities: Sequence[str], financing: Sequence[str], backstops: Sequence[str], gap: int = 16
) -> str:
    """Authority, financing and backstop words near each other, in the three flagged orders."""
    authority, finance, backstop = map(_either, (authorities, financing, backstops))
    near = f".{{0,{gap}}}"
    orders = (
        (authority, finance, backstop),
        (finance, authority, backstop),
        (authority, backstop, finance),
    )
    return "(?s)" + "|".join(near.join(order) for order in orders)


def is_compliant_script(
    script: Column | str,
    promises: Sequence[str] = rules.PROMISE_WORDS,
    benefits: Sequence[str] = rules.BENEFIT_WORDS,
    authorities: Sequence[str] = rules.AUTHORITY_WORDS,
    financing: Sequence[str] = rules.FINANCING_WORDS,
    backstops: Sequence[str] = rules.BACKSTOP_WORDS,
    phrases: Sequence[str] = rules.ENDORSEMENT_PHRASES,
) -> Column:
    """False for a blank script and for one with a guarantee or an endorsement."""
    text = col(script)
    flagged = (
        contains_any(text, phrases)
        | text.rlike(overpromise_pattern(promises, benefits))
        | text.rlike(backstop_pattern(authorities, financing, backstops))
    )
    return ~is_blank(text) & ~flagged


def append_disclaimer(script: Column | str, disclaimer: str = rules.DISCLAIMER) -> Column:
    return F.concat(strip(script), F.lit("\n\n" + disclaimer))


def evidence_location(
    text: Column, quote: Column, prefix: str = rules.LOCATION_PREFIX
) -> Column:
    """One-based inclusive character range of the quote; both sides are normalised text."""
    start = F.instr(text, quote)
    found = F.concat(
        F.lit(prefix),
        start.cast("string"),
        F.lit("-"),
        (start + F.char_length(quote) - 1).cast("string"),
    )
    return F.when((F.char_length(quote) > 0) & (start > 0), found)


def template_missing(template: str) -> list[str]:
    """Reasons why a prompt template cannot be used; empty when it can."""
    text = template.strip()
    if not text:
        return [rules.PROMPT_BLANK_ERROR]
    return [item for item in rules.PROMPT_PLACEHOLDERS if item not in text]


def template_missing_column(template: Column | str) -> Column:
    """The same check for a table of templates."""
    text = strip(template)
    absent = F.filter(
        F.array(*[F.lit(item) for item in rules.PROMPT_PLACEHOLDERS]),
        lambda item: ~F.contains(text, item),
    )
    return F.when(text == "", F.array(F.lit(rules.PROMPT_BLANK_ERROR))).otherwise(absent)


def render_prompt(
    document_text: Column | str, catalog: str, tags: str, schema: str, template: str
) -> Column:
    """Fill the placeholders in order; a later one is also filled inside an earlier value."""
    missing = template_missing(template)
    if missing:
        raise ValueError("prompt template: " + ", ".join(missing))
    rendered = F.lit(template.strip())
    values = (col(document_text), F.lit(catalog), F.lit(tags), F.lit(schema))
    for placeholder, value in zip(rules.PROMPT_PLACEHOLDERS, values, strict=True):
        rendered = F.replace(rendered, F.lit(placeholder), value)
    return rendered
