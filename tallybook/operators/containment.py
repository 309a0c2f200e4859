"""Which texts hold which phrases: one reading of each text by an automaton over a block of phrases."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from tallybook.operators.blocks import block_count, meet

BLOCK_PHRASES = 50_000
BLOCK_TEXTS = 50_000


def _automaton(phrases: pd.Series) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, phrase)
    found.make_automaton()
    return found


def _hits(held: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    pairs: list[tuple[str, str]] = []
    if len(held) and len(block):
        automaton = _automaton(block["phrase"])
        for text in held["text"]:
            pairs += [(phrase, text) for phrase in {phrase for _, phrase in automaton.iter(text)}]
    return pd.DataFrame(pairs, columns=["phrase", "text"], dtype="object")


def held_phrases(phrases: DataFrame, texts: DataFrame, block_phrases: int = BLOCK_PHRASES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """phrases(phrase), texts(text), both distinct: the pairs where the text holds the phrase, each once.  A blank phrase and NULL
    meet nothing.  No pair is made that is not a hit."""
    some, whole = phrases.where("phrase <> ''"), texts.where("text <> ''")
    return meet(whole.select("text"), "text", block_count(whole.count(), block_texts), some.select("phrase"), "phrase",
                block_count(some.count(), block_phrases), _hits, "phrase string, text string")
