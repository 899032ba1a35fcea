"""Text expressions (C1-C8). All are built-in Column expressions: they run inside whole-stage
codegen, never in a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's text cleaning (patterns as written there).
LETTERS_ONLY = r"[^a-zA-Z]"
URL_PATTERN = r"https?://\S+|www\.\S+"
# (?d): UNIX_LINES, so '.' stops only at \n as in Python's re (Java's '.' also stops at \r).
TAG_PATTERN = r"(?d)<.*?>"
EMOJI_RANGES = [
    ("1F600", "1F64F"),  # emoticons
    ("1F300", "1F5FF"),  # symbols & pictographs
    ("1F680", "1F6FF"),  # transport & map symbols
    ("1F1E0", "1F1FF"),  # flags
    ("2702", "27B0"),
    ("24C2", "1F251"),
]
EMOJI_PATTERN = "[" + "".join(f"\\x{{{lo}}}-\\x{{{hi}}}" for lo, hi in EMOJI_RANGES) + "]+"
STANCE_PHRASES = {1: " is positive", -1: " is negative"}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_text(col) -> Column:
    """Text coercion before cleaning. Null becomes the empty string (the reference turns it
    into the word 'nan'; see the semantics ledger L4)."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def strip_urls(col) -> Column:
    """Remove http(s) URLs and www. hosts up to the next whitespace."""
    return F.regexp_replace(_c(col), URL_PATTERN, "")


def strip_tags(col) -> Column:
    """C4: remove <...> tags, shortest match, not crossing a newline."""
    return F.regexp_replace(_c(col), TAG_PATTERN, "")


def strip_emoji(col) -> Column:
    """Remove runs of emoji / symbol code points (the last range also covers CJK)."""
    return F.regexp_replace(_c(col), EMOJI_PATTERN, "")


_PRE_STEPS = {"urls": strip_urls, "tags": strip_tags, "emoji": strip_emoji}


def clean_text(col, pre: tuple[str, ...] = ()) -> Column:
    """C1+C2: lower-case, then every code point that is not an ASCII letter becomes one space
    (no collapsing, no trimming). In the reference the URL / tag / emoji patterns run after the
    letter filter and can never match (ledger L1); ``pre`` runs them first when wanted."""
    out = as_text(col)
    for step in pre:
        out = _PRE_STEPS[step](out)
    return F.regexp_replace(F.lower(out), LETTERS_ONLY, " ")


def words(col) -> Column:
    """Cleaned text as an array of non-empty words (the default tokenizer): the maximal runs
    of ASCII letters of the lower-cased text, i.e. ``clean_text`` split on spaces without the
    empty fields. Split on letter runs + ``array_remove`` stays in generated code (a
    ``filter`` lambda would not)."""
    return F.array_remove(F.split(F.lower(as_text(col)), "[^a-zA-Z]+"), "")


def word_count(col) -> Column:
    """``len(text.split(' '))``: empty fields between repeated spaces count."""
    return F.size(F.split(as_text(col), " "))


def topic_id(col, strict: bool = True) -> Column:
    """The integer after the first '_' of '<prefix>_<topic>_<n>'. Strict raises on a
    malformed id (as the reference does); lenient gives null."""
    parts = F.split(_c(col), "_")
    if strict:
        return F.element_at(parts, 2).cast("int")
    return F.try_element_at(parts, F.lit(2)).try_cast("int")


def stance_text(col) -> Column:
    """1 -> ' is positive', -1 -> ' is negative', anything else fails the job."""
    c = _c(col)
    out = F.when(c == 1, F.lit(STANCE_PHRASES[1])).when(c == -1, F.lit(STANCE_PHRASES[-1]))
    return out.otherwise(F.raise_error(F.concat(F.lit("invalid stance: "),
                                                F.coalesce(c.cast("string"), F.lit("null")))))


def extra_segments(topic=None, stance=None, others: tuple = ()) -> Column:
    """The extra text segments appended after the pair: cleaned topic (with the stance
    phrase when stance is given) and any other cleaned columns, as an array<string>.
    Stance needs topic, as in the reference."""
    if stance is not None and topic is None:
        raise ValueError("stance info has to be combined with topic")
    segs = []
    if topic is not None:
        t = clean_text(topic)
        segs.append(F.concat(t, stance_text(stance)) if stance is not None else t)
    segs.extend(clean_text(o) for o in others)
    return F.array(*segs) if segs else F.array().cast("array<string>")
