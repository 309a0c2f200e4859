"""Trigram word similarity: the best Jaccard overlap of a phrase's trigrams with any run of another text's trigrams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_trigrams(text: Column) -> Column:
    """Trigrams in text order; each alphanumeric word is padded with two blanks before and one after."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(tokens, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def trigrams(text: Column) -> Column:
    return F.array_distinct(ordered_trigrams(text))


def let(value: Column, use) -> Column:
    """use(value) with value worked out once.  A column named inside a lambda is worked out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_similarity(phrase_grams: Column, text_grams: Column) -> Column:
    """Best |A ∩ E| / |A ∪ E| over runs E of text_grams.  A run that starts or ends outside A can be trimmed for a
    score at least as good, so only runs between two shared trigrams are scored."""

    def score(g: Column, start: Column, end: Column) -> Column:
        run = F.array_distinct(F.slice(g["b"], start, end - start + 1))
        return let(F.struct(F.size(F.array_intersect(run, g["a"])).alias("shared"), F.size(run).alias("n")),
                   lambda x: x["shared"].cast("double") / (F.size(g["a"]) + x["n"] - x["shared"]).cast("double"))

    def best(g: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(g["b"]), F.lit(1))),
                      lambda i: F.array_contains(g["a"], F.get(g["b"], i - 1)))
        return let(at, lambda hits: F.array_max(F.transform(hits, lambda s: F.array_max(
            F.transform(F.filter(hits, lambda e: e >= s), lambda e: score(g, s, e))))))

    return F.coalesce(let(F.struct(phrase_grams.alias("a"), text_grams.alias("b")), best), F.lit(0.0))


def word_similarity(phrase: Column, text: Column) -> Column:
    return run_similarity(trigrams(phrase), ordered_trigrams(text))
