"""Column functions on turn and answer text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that decide results: markers, patterns and word lists

STALE_MARK = "[Note: the following was later revised — see below]\n"

SIGNPOST_PATTERNS = (
    r"\bon a (completely |totally |slightly )?(different|separate|unrelated) (note|topic|subject|matter)\b",
    r"\bseparately\b",
    r"\bunrelated(ly)?\b",
    r"\bswitching (topics|gears|subjects)\b",
    r"\bchanging (the )?(topic|subject)\b",
    r"\b(going|coming|getting|circling|jumping|moving) back to\b",
    r"\bback to (the|our|my)\b",
    r"\bback on (the|our|my)\b",
    r"\bas a separate (matter|question|thing)\b",
    r"\bone more (thing|question)\b",
    r"\bwhile (I|we)('re| are) at it\b",
    r"\bdifferent question\b",
    r"\bnew topic\b",
    r"\bside note\b",
    r"\bmeanwhile\b",
)

RETRACTION_PATTERN = (
    r"(?i)fabricat|I (?:have )?(?:been )?invent|made up|I need to (?:stop|be transparent|be honest|correct)"
    r"|I (?:don't|do not) (?:actually )?have (?:any )?(?:record|information|access)|cannot verify"
    r"|not a real person|I should not continue|there is no (?:record|prior)"
)

ENTITY_PATTERNS = {
    "backtick_code": (r"`([^`\n]{2,80})`", 1),
    "double_quoted_phrase": ("[\"“]([^\"”\n]{3,80})[\"”]", 1),
    "snake_case_identifier": (r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", 0),
    "camel_case_identifier": (r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b", 0),
}

STOP_ITEMS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "first", "second", "third",
    "today", "tomorrow", "yesterday", "a few", "half", "a couple", "one day", "the day", "next week", "last week",
    "this week", "a week", "a month", "a year", "monday", "tuesday", "wednesday", "thursday", "friday",
    "saturday", "sunday", "morning", "afternoon", "evening", "night", "daily", "weekly", "monthly", "annual",
)

ITEM_EDGE_CHARS = ".,;:!?'\""
TOKEN_PATTERN = r"\w+|[^\w\s]"


def token_count(text: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a text; ``counter`` plugs in another column expression."""
    if counter is not None:
        return counter(text)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN)).cast("bigint")


def render_turn(user: Column, assistant: Column, stale: Column | None = None) -> Column:
    body = F.concat(F.lit("User: "), user, F.lit("\nAssistant: "), F.coalesce(assistant, F.lit("")), F.lit("\n"))
    return body if stale is None else F.concat(F.when(stale, F.lit(STALE_MARK)).otherwise(F.lit("")), body)


def turn_text(user: Column, assistant: Column) -> Column:
    return F.concat(user, F.lit("\n"), F.coalesce(assistant, F.lit("")))


def assemble_prompt(context: Column, query: Column) -> Column:
    return F.concat(context, F.lit("\n\nUser: "), query)


def signposting(text: Column) -> Column:
    """All topic-switch phrases in a message."""
    pattern = "(?i)(?:" + "|".join(SIGNPOST_PATTERNS) + ")"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def is_retraction(response: Column) -> Column:
    """Whether the start of an answer disowns earlier turns.

    The first 600 characters are the rule itself, not a shortcut.
    """
    return F.substring(F.coalesce(response, F.lit("")), 1, 600).rlike(RETRACTION_PATTERN)


def normalise_item(item: Column) -> Column:
    trimmed = F.btrim(F.lower(F.btrim(item, F.lit(" \t\n\r\f\x0b"))), F.lit(ITEM_EDGE_CHARS))
    return F.regexp_replace(trimmed, r"\s+", " ")


def regex_items(text: Column, extra: Column | None = None) -> Column:
    """Identifiers and quoted phrases of a text, normalised, without generic ones.

    ``extra`` is an optional array of further items, such as named entities.
    """
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ENTITY_PATTERNS.values()]
    if extra is not None:
        found.append(F.coalesce(extra, F.array().cast("array<string>")))
    norm = F.transform(F.concat(*found), normalise_item)
    kept = F.filter(norm, lambda x: F.length(x) >= 2)
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(s) for s in STOP_ITEMS]))


def bare_name(text: Column) -> Column:
    """A registry entry without a trailing bracket, dash or colon description."""
    cut = F.regexp_replace(text, r"(?s)(\s*[\(\[]|\s+[-–—]\s+|:\s).*$", "")
    return F.btrim(F.btrim(cut), F.lit("'\""))


def truncate_tokens(text: Column, n: Column) -> Column:
    """The text up to and including its n-th token, blanks between tokens kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s*(?:\w+|[^\w\s])"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def span_variant(spans: Column) -> Column:
    """Alphabetically first description among the evidence spans."""
    return F.array_min(F.map_values(spans))


def display_name(col: Column, names: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.get(F.array(F.create_map(*pairs)[col]), F.lit(0)), col)


def one_decimal(x: Column) -> Column:
    """A double with one decimal as ``%.1f`` prints it: the nearest to its binary value, of two as near the even one.

    Spark's own formats round the shortest decimal form instead, so that 49.65, in binary a little less, becomes 49.7.
    """
    a = F.abs(x)
    whole = F.floor(a)
    part = a - whole
    high = F.floor(part * 2**20) / F.lit(2.0**20)
    n = F.floor(part * 10)
    over = (high * 10 - n - 0.5) + (part - high) * 10  # its sign is exact: both products are
    tenths = whole * 10 + n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
