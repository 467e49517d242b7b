"""Further signs of a bad reading as Column expressions: scripts, lost characters, broken words, loops, remarks of a model, declared language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions import text as X

# Patterns and limits of the signs below.
PRIVATE = r"\p{Co}"
PRIVATE_BULLET = r"(?m)^\s*\p{Co}(?:\s|$)"
HOME = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsInherited}\x{2b0}-\x{2ff}\x{2100}-\x{214f}\x{1d400}-\x{1d7ff}µªºˇ]"
MIXED_MIN_TOKENS, MIXED_MIN_RATIO = 20, 0.05
PRIVATE_MIN = 3
FOREIGN_MIN, FOREIGN_MAX_SHARE = 3, 0.1
MARKS = r"\x{300}-\x{36f}\x{483}-\x{489}"
CYRILLIC_TOKEN = rf"(?<![\p{{L}}{MARKS}])[\x{{400}}-\x{{482}}\x{{48a}}-\x{{4ff}}][\x{{400}}-\x{{4ff}}{MARKS}]*(?![\p{{L}}])"
ONE_LETTER_WORDS = "абвжикосуяійзўАБВЖИКОСУЯІЙЗЎ"
SPLIT_MIN_TOKENS, SPLIT_MIN_SHARE = 50, 0.10
CAPITAL_SIGN = r"[а-яёѣіѳѵ][ЪЬ]"
CAPITAL_SIGN_MIN, CAPITAL_SIGN_MIN_SHARE = 5, 0.01
LEADER = r"(?:\.{4,}|\.(?: \.){2,})"
ROMAN = r"(?i)[ivxlcdm]+"
LEADERS_MIN = 10
LOOP_MIN_LINES, LOOP_MIN_SHARE, LOOP_MIN_TAIL_REPEATS, LOOP_MAX_TAIL_UNIT, LOOP_MIN_LETTER_RUN = 20, 0.30, 20, 200, 40
NOTE_LINE = r"(?i)^[\s>*_(\[]*(?:note|n\.\s?b\.|disclaimer)\b"
ABOUT_THE_IMAGE = (
    r"(?i)\b(?:legib\w*|illegib\w*|resolution|too small|blurr\w*|microfilm|(?:the|this) (?:image|scan|photo\w*)|transcri\w+"
    r"|(?:I|we) (?:cannot|can't|could not|couldn't|am unable|was unable)|unable to (?:read|make out))"
)
OMITTED = (
    r"(?i)\[[^\]\n]{0,300}?\b(?:omitted|not transcribed|remaining (?:lines|text|columns?|entries)|rest of (?:the )?(?:page|column|text)"
    r"|(?:transcription|text) (?:truncated|incomplete))[^\]\n]{0,300}\]"
)
LANGUAGE_MIN_LETTERS, SCRIPT_MIN_SHARE, PRE_REFORM_MIN_LETTERS, HARD_SIGN_MIN_SHARE = 200, 0.5, 300, 0.01
HARD_SIGN = r"[ъЪ](?:[^\p{L}]|$)"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def mixed_script_ratio(text: Column) -> Column:
    """Share of the tokens that hold letters of two of Latin, Cyrillic and Greek."""
    tokens = F.regexp_extract_all(_text(text), F.lit(f"({X.TOKEN})"), 1)
    mixed = F.filter(tokens, lambda t: sum((t.rlike(rf"\p{{Is{s}}}").cast("int") for s in ("Latin", "Cyrillic", "Greek")), F.lit(0)) > 1)
    return X.ratio(F.size(mixed), F.size(tokens))


def private_use(text: Column) -> Column:
    """Private-use characters, bullets at the beginning of a line aside."""
    t = _text(text)
    return X.count(t, PRIVATE) - X.count(t, PRIVATE_BULLET)


def foreign_script(text: Column) -> Column:
    """Letters and marks of scripts a Latin, Cyrillic or Greek page doesn't carry; mathematical alphabets aside."""
    return X.count(F.regexp_replace(_text(text), HOME, ""), r"[\p{L}\p{M}]")


def letter_run(text: Column) -> Column:
    """Length of the longest run of one letter, 0 if no letter stands twice on end."""
    runs = F.regexp_extract_all(_text(text), F.lit(r"((\p{L})\2+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("bigint")


def repeated_tail(text: Column) -> Column:
    """Length of the ending made of one unit said twenty times or more, 0 for none or for a last line of leaders.

    The text is read backwards, so that its ending is tried once for each
    length of unit; the shortest unit that repeats gives the longest ending.
    """
    t = F.rtrim(F.regexp_replace(_text(text), r"\s+$", ""))
    ending = F.regexp_extract(F.reverse(t), rf"(?s)^(.{{1,{LOOP_MAX_TAIL_UNIT}}}?)\1{{{LOOP_MIN_TAIL_REPEATS - 1},}}", 0)
    return F.when(F.regexp_extract(t, r"([^\n]*)$", 1).rlike(X.RULE_LINE), 0).otherwise(F.length(ending)).cast("bigint")


def cyrillic_tokens(text: Column) -> Column:
    return X.count(_text(text), CYRILLIC_TOKEN)


def stray_letters(text: Column) -> Column:
    """Lone Cyrillic letters that are no words, abbreviations or units: pieces of broken words."""
    lone = rf"(?<![\p{{L}}{MARKS}])[\x{{400}}-\x{{482}}\x{{48a}}-\x{{4ff}}&&[^{ONE_LETTER_WORDS}]](?![\p{{L}}{MARKS}.])"
    unit = r"(?:(?<=\d[^\S\n]{1,32})|(?<=(?<!\p{L})(?:млн|млрд|тыс|трлн)\.?[^\S\n]{1,32})|(?<=[·/]))"
    small = rf"{unit}[\x{{400}}-\x{{482}}\x{{48a}}-\x{{4ff}}&&[^{ONE_LETTER_WORDS}]&&\p{{Ll}}](?![\p{{L}}{MARKS}.\p{{Nd}}])"
    t = _text(text)
    return X.count(t, lone) - X.count(t, small)


def capital_signs(text: Column) -> Column:
    """Capital hard or soft signs after a small letter, as no orthography has them."""
    return X.count(_text(text), CAPITAL_SIGN)


def unfinished_leaders(text: Column) -> Column:
    """Lines whose last dot leader leads to no number."""
    value = lambda x: F.trim(F.regexp_extract(x, rf"^.*{LEADER}(.*)$", 1))
    return F.size(F.filter(X.lines(_text(text)), lambda x: x.rlike(LEADER) & ~value(x).rlike(r"\p{Nd}") & ~value(x).rlike(f"^(?:{ROMAN})$"))).cast("bigint")


def numeric_lines(text: Column) -> Column:
    return F.size(F.filter(X.lines(_text(text)), lambda x: x.rlike(r"\p{Nd}") & ~x.rlike(r"\p{L}"))).cast("bigint")


def partial_transcription(text: Column) -> Column:
    """Whether a bracket says what was left out."""
    return _text(text).rlike(OMITTED)


def model_commentary(text: Column) -> Column:
    """Whether a paragraph is a note about the image or its reading."""
    return F.exists(F.split(_text(text), r"\n\s*\n"), lambda p: p.rlike(NOTE_LINE) & p.rlike(ABOUT_THE_IMAGE))


def historical_letters_lost(text: Column) -> Column:
    """Whether a page declared as old Russian print has lost the old spelling."""
    t = _text(text)
    return (
        (X.count(t, r"\p{L}") >= LANGUAGE_MIN_LETTERS) & (X.count(t, r"[\p{L}&&\p{IsCyrillic}]") >= PRE_REFORM_MIN_LETTERS) & ~t.rlike(X.PRE_REFORM)
        & (X.count(t, HARD_SIGN) <= F.greatest(F.lit(1.0), HARD_SIGN_MIN_SHARE * F.size(X.tokens(t))))
    )


def codes(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, joined by a semicolon."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules])), ";")
