"""Text normalisation, tokens, patterns and hashes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a statistic in a text.
STAT_PATTERNS = (
    r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b",
    r"\b\d+\.?\d*%",
    r"\b(?:19|20)\d{2}\b",
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"\$\d+(?:,\d{3})*(?:\.\d{2})?",
    r"\b\d+(?:\.\d+)?[BMKbmk]\b",
)
#: Words that open a question.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "which", "who", "can", "does", "is", "are", "should", "will", "do")
CODE_MARKS = r"```|</\w+>|\bdef \w+\(|\bfunction\s*\(|\{\s*\"|;\s*$"


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def neutral_brackets(text: Column) -> Column:
    return F.translate(text, "[]", "()")


def dedup_key(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def sha(*parts: Column, length: int = 64, prefix: str = "") -> Column:
    """Hex digest of the parts joined by ":", cut, with a prefix."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    out = F.substring(F.sha2(text, 256), 1, length)
    return F.concat(F.lit(prefix), out) if prefix else out


def word_count(text: Column) -> Column:
    """White-space separated words; null for blank text."""
    t = collapse(text)
    return F.when(t != "", F.size(F.split(t, " ")))


def regex_words(text: Column) -> Column:
    """Count of word tokens with inner apostrophes and hyphens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"))


def eligible(text: Column, low: int = 3, high: int = 100) -> Column:
    return regex_words(text).between(low, high)


def latin_share(text: Column) -> Column:
    """Share of ASCII letters among letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[A-Za-z]")), letters), F.lit(0.0))


def printable_share(text: Column) -> Column:
    n = F.char_length(text)
    return F.coalesce(F.try_divide(n - F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")), n), F.lit(0.0))


def rejection_reason(text: Column, low: int = 3, high: int = 100) -> Column:
    """The first rule a prompt text breaks, else null."""
    t = collapse(text)
    n = regex_words(t)
    return (
        F.when(t == "", "empty")
        .when(n < low, "too-short")
        .when(n > high, "too-long")
        .when(t.rlike(r"https?://|www\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "external-identifier")
        .when(t.rlike(CODE_MARKS), "code")
        .when(printable_share(t) < 0.98, "non-printable")
        .when(latin_share(t) < 0.80, "non-english")
    )


def has_stats(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in STAT_PATTERNS])


def stats_density(text: Column) -> Column:
    """Distinct matched statistics for each 500 words, rounded to 2 digits; null for blank text."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"({p})"), 1) for p in STAT_PATTERNS])))
    return F.round(F.size(found) / (word_count(text) / 500.0), 2)


def question_heading(heading: Column) -> Column:
    h = F.lower(F.trim(heading))
    return h.endswith("?") | F.split(h, r"[^a-z]").getItem(0).isin(*QUESTION_WORDS)


def keyword_tokens(keyword: Column, least: int = 3) -> Column:
    return F.filter(F.split(F.lower(collapse(keyword)), " "), lambda t: F.char_length(t) >= least)


def title_has_keyword(title: Column, keyword: Column, least: int = 3) -> Column:
    return F.exists(keyword_tokens(keyword, least), lambda t: F.contains(F.lower(F.coalesce(title, F.lit(""))), t))


def ablate(text: Column, pattern: str) -> Column:
    return collapse(F.regexp_replace(text, pattern, " "))


def strip_keyword(text: Column, keyword: Column) -> Column:
    """Removes the keyword's tokens, whole words only, in any case."""
    out = F.aggregate(
        keyword_tokens(keyword),
        F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", "  "), F.lit(" ")),
        lambda acc, t: F.regexp_replace(acc, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), t, F.lit("(?![A-Za-z0-9_])")), F.lit("")),
    )
    return collapse(out)


def token_tags(token: Column) -> Column:
    """Labels of a token: number, percent, year, money."""
    rules = {"number": r"^\d[\d,.]*$", "percent": r"^\d+(?:\.\d+)?%$", "year": r"^(?:19|20)\d{2}$", "money": r"^[$€£]\d"}
    return F.array_compact(F.array(*[F.when(token.rlike(p), F.lit(k)) for k, p in rules.items()]))


def surface(text: Column) -> dict[str, Column]:
    """Sentence form, length band, perspective, opening word and clause band of a prompt."""
    t = collapse(text)
    n = regex_words(t)
    first = F.regexp_extract(F.lower(t), r"^[^a-z]*([a-z]+)", 1)
    clauses = F.regexp_count(t, F.lit(r"[,;:]")) + 1
    return {
        "form": F.when(t.endswith("?") | first.isin(*QUESTION_WORDS), "question").when(first.isin("write", "give", "list", "make", "explain", "describe", "tell", "find", "show"), "command").otherwise("statement"),
        "length_band": F.when(n <= 12, "short").when(n <= 30, "medium").otherwise("long"),
        "perspective": F.when(F.lower(t).rlike(r"\b(i|me|my|we|our)\b"), "first").when(F.lower(t).rlike(r"\b(you|your)\b"), "second").otherwise("third"),
        "opening": first,
        "clause_band": F.when(clauses <= 1, "one").when(clauses <= 3, "few").otherwise("many"),
    }


def ranked_lines(output: Column) -> Column:
    """Items of a ranker's answer: reasoning blocks, bullets, numbers and backticks go, in lower case, no empties."""
    body = F.regexp_replace(output, r"(?s)<think>.*?</think>", "")
    lines = F.transform(F.split(body, r"\n"), lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.):])\s*", ""), "`", ""))))
    return F.filter(lines, lambda x: x != "")


def permutation(output: Column, n: Column) -> Column:
    """Tokens C001.. of a strict answer of n tokens without repeats or strangers; null where it isn't one."""
    tokens = F.regexp_extract_all(output, F.lit(r"\b(C\d{3})\b"), 1)
    known = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("C"), F.lpad(i.cast("string"), 3, "0")))
    good = (F.size(tokens) == n) & (F.size(F.array_distinct(tokens)) == n) & (F.size(F.array_except(tokens, known)) == 0)
    return F.when(good, tokens)
