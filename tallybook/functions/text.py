"""Text expressions: slugs, rule chains, labels, tokens, figures in prose, highlights, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallybook import fixed_values as V


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def reason_category(reason: Column) -> Column:
    """First rule that matches wins; no reason, or none that matches, is 'other'."""
    chain = F.when(F.coalesce(reason, F.lit("")) == "", "other")
    for name, pattern in V.REASON_RULES:
        chain = chain.when(reason.rlike("(?i)" + pattern), name)
    return chain.otherwise("other")


def clean_description(raw: Column) -> Column:
    """Display text: control asterisks and footnote codes removed, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\*", ""), V.FOOTNOTE_CODE, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def footnote_codes(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(V.FOOTNOTE_CODE), F.lit(1))


def footnote_flag(raw: Column) -> Column:
    return raw.contains("*")


def glued_pay_range(raw: Column, group: int) -> Column:
    """Group 1 the text, group 2 the pay range, of a description with its pay range stuck to it."""
    return F.nullif(F.regexp_extract(raw, V.GLUED_PAY, group), F.lit(""))


def tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "’", "'")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def any_words(query: Column) -> Column:
    return F.array_join(words(query), " or ")


def light_stem(token: Column) -> Column:
    """Plural, -ing and -ed endings removed.  Spark ships no Snowball stemmer; this rule is ours.  Most words have another last
    letter and meet no pattern."""
    short = F.regexp_replace(F.regexp_replace(token, r"(?<=[a-z]{3})(ies)$", "y"), r"(?<=[a-z]{3})(ing|ed|es|s)$", "")
    return F.when(F.right(token, F.lit(1)).isin("s", "g", "d"), short).otherwise(token)


def search_terms(text: Column, stop_words: list[str]) -> Column:
    """Distinct stemmed search terms of a text, stop words dropped."""
    kept = F.filter(words(text), lambda w: ~w.isin(stop_words))
    return F.array_distinct(F.transform(kept, light_stem))


def norm_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def label_hit(line_text: Column, label: Column, n: int = 2) -> Column:
    """Do the first n words of the label stand together on the line?"""
    want = F.array_join(F.slice(F.split(norm_label(label), " "), 1, n), " ")
    return (want != "") & norm_label(line_text).contains(want)


def figures(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.ANSWER_FIGURE), F.lit(0))


def statement_figures(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.STATEMENT_FIGURE), F.lit(0))


def quoted_phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.QUOTED), F.lit(1))


def passage_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.PASSAGE_NUMBER), F.lit(0))


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def mark_terms(text: Column, terms: Column) -> Column:
    """Wrap whole-number occurrences of the terms in <mark>; never inside a longer number."""
    wanted = F.filter(terms, lambda t: t.isNotNull() & (t != ""))
    quoted = F.transform(wanted, lambda t: F.regexp_replace(escape_html(t), r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?<![\d.,])("), F.array_join(quoted, "|"), F.lit(r")(?![\d]|[.,]\d)"))
    safe = escape_html(text)
    return F.when(F.size(wanted) == 0, safe).otherwise(F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>")))


def excerpt(text: Column, size: int = 220) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, size), r"\s\S*\z", "…")
    return F.when(F.length(text) <= size, text).otherwise(cut)


def is_tabular(line: Column) -> Column:
    """Half or more of a line's tokens are numbers, or it is a short line with one."""
    toks = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    n, hits = F.size(toks), F.size(F.filter(toks, lambda t: t.rlike(V.TABULAR_TOKEN)))
    return (n > 0) & ((hits * 2 >= n) | ((n <= 3) & (hits >= 1)))


def context_header(*parts: Column) -> Column:
    return F.concat_ws(" — ", *parts)


def short_context(header: Column) -> Column:
    """The second part of a context header, or the whole header when it has one part."""
    return F.coalesce(F.get(F.split(header, " — "), F.lit(1)), header)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def zero_pad_account(account: Column) -> Column:
    """Six digits at least; a longer code stays whole."""
    return F.when(F.length(account) < 6, F.lpad(account, 6, "0")).otherwise(account)


def like_pattern(query: str, literal: bool = False) -> str:
    """A contains pattern.  By default % and _ typed by the user stay wildcards."""
    q = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else query
    return f"%{q}%"
