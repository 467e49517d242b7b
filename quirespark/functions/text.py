"""Text measures as Column expressions: all inside the JVM, one projection over the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits of the page measures.
TOKEN = r"\p{L}[\p{L}\p{M}\x{200c}\x{200d}]*"
JOINERS = r"[\x{200c}\x{200d}]"
LISTED_SYMBOLS = r"[_|\\/{}\[\]•]"
ODD_SYMBOLS = r"[\p{S}\p{Cf}\p{Co}\p{Cc}]"
PLAIN_SYMBOLS = r"[$+<=>^`|~\x00-\x1f\x7f№°]"
#: The listed symbols, and the odd ones that aren't plain: one class, counted in one pass.
SUSPICIOUS = rf"[{LISTED_SYMBOLS[1:-1]}[{ODD_SYMBOLS[1:-1]}&&[^{PLAIN_SYMBOLS[1:-1]}]]]"
CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f]"
PRE_REFORM = r"[ѣѢѳѲѵѴ]"
FINAL_HARD_SIGN = r"\p{L}[ъЪ](?:[^\p{L}\p{M}]|$)"
WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INSTRUCTION_MARKERS = ("<think>", "</think>", "<|channel", "<|im_start|>", "<|im_end|>", "[inst]", "[/inst]")
RULE_LINE = r"^[ .·_\-=—–]+$"
OMISSION = r"(?i)\[[^\]]*(?:omitted|truncated|continues|not transcribed|remaining|illegible section)[^\]]*\]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def tokens(text: Column) -> Column:
    """Alphabetic tokens: a letter, then letters and marks; joiners keep a token together but add no length."""
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)
    return F.transform(found, lambda t: F.regexp_replace(t, JOINERS, ""))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double"), digits)).otherwise(F.lit(0.0))


def lines(text: Column) -> Column:
    """Lines of a text; no empty one after a final line end."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def metrics(text: Column) -> dict[str, Column]:
    """The page's measures; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lengths = F.transform(tokens(t), F.length)
    n, chars = F.size(lengths), F.length(t)
    suspicious = count(t, SUSPICIOUS)
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    letters = count(t, r"\p{L}")
    return {
        "character_count": chars.cast("bigint"),
        "replacement_count": (chars - F.length(F.replace(t, F.lit("�"), F.lit("")))).cast("bigint"),
        "control_count": count(t, CONTROLS),
        "suspicious_count": suspicious,
        "suspicious_ratio": ratio(suspicious, chars),
        "token_count": n.cast("bigint"),
        "token_mean": F.when(n > 0, F.round(total.cast("double") / n.cast("double"), 4)),
        "token_max": F.coalesce(F.array_max(lengths), F.lit(0)).cast("bigint"),
        "token_short_ratio": F.when(n > 0, F.round(F.size(F.filter(lengths, lambda x: x <= 2)).cast("double") / n.cast("double"), 4)),
        "whitespace_ratio": ratio(count(t, WHITESPACE), chars),
        "latin_ratio": ratio(count(t, r"\p{IsLatin}"), letters),
        "letter_count": letters,
        "digit_count": count(t, r"\p{Nd}"),
        "pre_reform_count": count(t, PRE_REFORM),
        "final_hard_signs": count(t, FINAL_HARD_SIGN),
    }


PROSE_ONLY = ("suspicious_symbol_density", "fragmented_text", "joined_text", "digits_only_text")
STRUCTURED = ("json", "csv", "markdown_table")


def warnings(m: dict[str, Column], text: Column, fmt: Column, confidence: Column | None = None) -> Column:
    """Ordered distinct warning codes from the measures; prose-only codes are dropped for structured formats."""
    t = F.coalesce(text, F.lit(""))
    alnum = t.rlike(r"[\p{L}\p{N}]")
    n, mean = m["token_count"], F.coalesce(m["token_mean"], F.lit(0.0))
    prose = ~F.coalesce(fmt.isin(*STRUCTURED), F.lit(False))
    rules = [
        (~alnum, "empty_text"),
        (alnum & (m["character_count"] < 10), "short_text"),
        (m["replacement_count"] > 0, "replacement_characters"),
        (m["control_count"] > 0, "control_characters"),
        (prose & (m["suspicious_ratio"] >= 0.03) & (m["suspicious_count"] >= 5), "suspicious_symbol_density"),
        (prose & (mean < 3.0) & (n >= 20), "fragmented_text"),
        (prose & (mean >= 10) & (m["token_max"] >= 80) & (n >= 20) & (m["whitespace_ratio"] <= 0.03) & (m["latin_ratio"] >= 0.8), "joined_text"),
        ((m["pre_reform_count"] >= 2) | ((n >= 20) & (m["final_hard_signs"] >= 2) & (m["final_hard_signs"] >= n / 100)), "historical_orthography"),
        (prose & (m["digit_count"] >= 20) & (m["letter_count"] < 0.05 * (m["letter_count"] + m["digit_count"])), "digits_only_text"),
    ]
    if confidence is not None:
        rules.append((F.coalesce(confidence < 0.6, F.lit(False)), "low_confidence"))
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules])))


def signals(text: Column) -> dict[str, Column]:
    """Structural signals: shares of nonblank lines with pipes or column gaps, share of digits."""
    t = F.coalesce(text, F.lit(""))
    full = F.filter(lines(t), lambda x: x.rlike(r"\S"))
    n = F.size(full)
    digits = count(t, r"\p{Nd}")
    solid = count(t, r"\S")
    return {
        "line_count": n.cast("bigint"),
        "pipe_line_ratio": ratio(F.size(F.filter(full, lambda x: x.contains("|"))), n),
        "column_line_ratio": ratio(F.size(F.filter(full, lambda x: x.rlike(r"\S {2,}\S"))), n),
        "digit_ratio": ratio(digits, solid),
    }


def classify(m: dict[str, Column], s: dict[str, Column], text: Column, fmt: Column) -> Column:
    """First rule that holds gives struct(type, confidence, reason)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n, mean = m["token_count"], F.coalesce(m["token_mean"], F.lit(0.0))

    def out(kind: str, confidence: float | None, reason: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).cast("double").alias("confidence"), F.lit(reason).alias("reason"))

    table = (s["line_count"] >= 3)
    return (
        F.when(F.length(t) <= 2, out("blank", 0.95, "blank"))
        .when(F.coalesce(fmt.isin(*STRUCTURED), F.lit(False)), out("table_likely", 0.85, "structured_format"))
        .when((mean >= 10) & (m["token_max"] >= 80) & (n >= 20) & (m["whitespace_ratio"] <= 0.03) & (m["latin_ratio"] >= 0.8), out("unknown", None, "joined_text"))
        .when(table & (s["pipe_line_ratio"] >= 0.3), out("table_likely", 0.75, "pipe_lines"))
        .when(table & (s["column_line_ratio"] >= 0.015) & (s["digit_ratio"] >= 0.25), out("table_likely", 0.6, "column_digits"))
        .when((mean < 3.0) & (n >= 20), out("unknown", None, "fragmented_text"))
        .when(n <= 25, out("sparse", 0.6, "few_words"))
        .otherwise(out("prose", 0.7, "running_text"))
    )


def band(value: Column, bands: tuple[tuple[str, float], ...], floor: str) -> Column:
    """Letter earned at or above each limit; null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for letter, limit in bands:
        out = out.when(value >= limit, F.lit(letter))
    return out.otherwise(F.lit(floor))


CONFIDENCE_BANDS = (("A", 0.90), ("B", 0.80), ("C", 0.70), ("D", 0.55))
COVERAGE_BANDS = (("A", 1.0), ("B", 0.9), ("C", 0.7))
PASS_BANDS = (("A", 0.98), ("B", 0.90), ("C", 0.75))


def grade_signals(warnings_: Column, confidence: Column) -> Column:
    """Worst of the confidence band and the number of warnings; an empty text is F."""
    n = F.size(F.array_except(warnings_, F.array(F.lit("low_confidence"))))
    by_count = F.when(n == 0, "A").when(n == 1, "B").when(n == 2, "C").otherwise("D")
    return F.when(F.array_contains(warnings_, "empty_text"), "F").otherwise(F.greatest(by_count, F.coalesce(band(confidence, CONFIDENCE_BANDS, "F"), F.lit("A"))))


def instruction_markers(text: Column) -> Column:
    """Chat markers the text holds, case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(x), F.lit(x)) for x in INSTRUCTION_MARKERS]))


def rejoin(text: Column) -> Column:
    """Words hyphenated at a line end joined where the next line begins lower-case."""
    return F.regexp_replace(text, r"(\p{L}\p{M}*)[-‐]\s*\n\s*(\p{Ll})", "$1$2")


#: Yat words a reading needs to set the measure for others of its page; adapters that write text anew.
YAT_WORDS_MIN = 10
GENERATIVE = ("vision",)


def yat_words(text: Column) -> Column:
    """Number of words of three letters or more with a yat."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}{3,})"), 1), lambda w: w.contains("ѣ"))).cast("bigint")


def modern_orthography(text: Column) -> Column:
    """Old Russian letters replaced by today's, final hard signs dropped."""
    swapped = F.translate(F.lower(text), "ѣіѳѵ", "еифи")
    return F.regexp_replace(swapped, r"ъ(?=[^\p{L}]|$)", "")


def graphemes(text: Column) -> Column:
    """Base characters with their marks."""
    return F.regexp_extract_all(text, F.lit(r"(\P{M}[\p{M}\x{200c}\x{200d}]*)"), 1)


def strip_thoughts(text: Column) -> Column:
    """Text without closed or dangling thought blocks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)^.*?</think>|<think>.*$", ""))


def clean_for_scoring(text: Column) -> Column:
    """Editorial marks, pipes and leaders removed, blanks collapsed."""
    t = F.regexp_replace(text, r"\{hw:([^}]*)\}", "$1")
    t = F.regexp_replace(t, r"\[(?:\?|illegible)\]|\||\.{3,}|(?: \.){3,}", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def spreadsheet_safe(value: Column) -> Column:
    """A quote before values that a spreadsheet would take for a formula."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), value)).otherwise(value)


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def page_range(expression: Column, last: int = 1_000_000) -> Column:
    """``1-3,7`` -> sorted distinct numbers; null if a bound is no number, out of order or beyond ``last``, so that nothing is spread out that no document has."""
    pieces = F.transform(F.split(expression, ","), lambda p: F.trim(p))
    bounds = F.transform(pieces, lambda p: F.struct(F.split(p, "-")[0].try_cast("int").alias("a"), F.element_at(F.split(p, "-"), -1).try_cast("int").alias("b")))
    good = F.forall(bounds, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] >= 1) & (x["a"] <= x["b"]) & (x["b"] <= last))
    spans = F.transform(bounds, lambda x: F.sequence(x["a"], x["b"]))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(spans))))
