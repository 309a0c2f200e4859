"""Keyword scores over inverted lists: the k best passages of each query leave a shard, never every pair that shares a word.

Passages are cut into shards and queries into blocks, both of bounded size.  A shard's lists are read in the order of their
greatest count; once the lists still to come cannot lift an unseen passage into the first k, they are only looked up for
passages that can still get there.  Ranks are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallybook.operators.blocks import block_count, meet

SHARD_PASSAGES = 4096
BLOCK_QUERIES = 4096


class Lists:
    """The inverted lists of one shard: for each term the passages that hold it, by number, and how often."""

    def __init__(self, terms: np.ndarray, ids: np.ndarray, vocabulary: pd.Index):
        self.ids, passage = np.unique(ids, return_inverse=True)
        code = vocabulary.get_indexer(pd.Index(terms))
        pairs, n = np.unique(code[code >= 0].astype(np.int64) * max(len(self.ids), 1) + passage[code >= 0], return_counts=True)
        self.passage, self.n = pairs % max(len(self.ids), 1), n
        self.start = np.searchsorted(pairs // max(len(self.ids), 1), np.arange(len(vocabulary) + 1))
        self.most = np.array([n[a:b].max() if b > a else 0 for a, b in zip(self.start[:-1], self.start[1:])], dtype=np.int64)

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Passage numbers and scores of the k best, equal scores by id."""
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        left = np.cumsum(self.most[terms][::-1])[::-1] if len(terms) else np.empty(0, dtype=np.int64)
        scores, rest = np.zeros(len(self.ids), dtype=np.int64), len(terms)
        for j, t in enumerate(terms):
            if j and len(scores) > k and np.partition(scores, len(scores) - k)[len(scores) - k] > left[j]:
                rest = j
                break
            a, b = self.start[t], self.start[t + 1]
            scores[self.passage[a:b]] += self.n[a:b]
        held = np.flatnonzero(scores)
        for j in range(rest, len(terms)):
            reach = np.partition(scores[held], len(held) - k)[len(held) - k]
            held = held[scores[held] + left[j] >= reach]
            a, b = self.start[terms[j]], self.start[terms[j] + 1]
            at = np.minimum(np.searchsorted(self.passage[a:b], held), b - a - 1)
            scores[held] += np.where(self.passage[a:b][at] == held, self.n[a:b][at], 0)
        held = held[np.lexsort((held, -scores[held]))][:k]
        return held, scores[held]


def shard_ranks(wanted: DataFrame, terms: DataFrame, k: int, passages: int, queries: int, shard_passages: int = SHARD_PASSAGES,
                block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, id, score of the k best passages of each query in every shard.

    wanted(query_id, term): distinct words of the queries; terms(id, term): a row for each word a passage holds.  `passages` and
    `queries` are the numbers of distinct ids, which set the number of shards and blocks."""
    lists = terms.join(wanted.select("term").distinct(), "term", "left_semi").select("id", "term")
    kind = {f.name: f.dataType.simpleString() for f in (*wanted.schema, *terms.schema)}

    def rank(held: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        vocabulary = pd.Index(block["term"].unique())
        lists = Lists(held["term"].to_numpy(), held["id"].to_numpy(), vocabulary)
        codes = pd.Series(vocabulary.get_indexer(block["term"]))
        found = [(q, *lists.best(c.to_numpy(), k)) for q, c in codes.groupby(block["query_id"].to_numpy())] if len(held) else []
        found = [f for f in found if len(f[1])]
        if not found:
            return pd.DataFrame({"query_id": block["query_id"][:0], "id": held["id"][:0], "score": pd.Series(dtype="int64")})
        return pd.DataFrame({"query_id": np.repeat(np.array([f[0] for f in found]), [len(f[1]) for f in found]),
                             "id": np.concatenate([lists.ids[f[1]] for f in found]), "score": np.concatenate([f[2] for f in found])})

    return meet(lists, "id", block_count(passages, shard_passages), wanted.select("query_id", "term"), "query_id", block_count(queries, block_queries),
                rank, f"query_id {kind['query_id']}, id {kind['id']}, score long")
