"""Models as parameters: what embeds, reranks, answers and judges, with deterministic offline forms.

An embedder maps a text column to a vector column; a reranker and a judge are column expressions too. Models plug in as pandas
UDFs of the same shape.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import ID_ANY, ids_in


_WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    def embed_query(self, text: Column) -> Column: ...
    def embed_document(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class HashedTerms:
    """The mean of signed hashed word vectors at unit length, over the first `limit` words (an embedder's window) of the prefixed,
    lower-cased text; a text without words is the zero vector. An Arrow batch at a time: models plug in as the same kind of UDF."""

    def __init__(self, dims: int = 64, query_prefix: str = "", document_prefix: str = "", limit: int = 512):
        self.dims, self.prefixes, self.limit = dims, (query_prefix, document_prefix), limit

    def _embed(self, text: Column, prefix: str) -> Column:
        dims, limit = self.dims, self.limit

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            known: dict[str, int] = {}
            out = []
            for t in texts:
                words = [m[0] for m in islice(_WORD.finditer(t.lower()), limit)]
                h = np.array([known.get(w) or known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace"))) for w in words], np.int64)
                v = np.bincount(h % dims, 1.0 - 2.0 * (h >> 31), dims) if len(h) else np.zeros(dims)
                out.append(v / (np.sqrt((v * v).sum()) or 1.0))
            return pd.Series(out)

        return embed(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))

    def embed_query(self, text: Column) -> Column:
        return self._embed(text, self.prefixes[0])

    def embed_document(self, text: Column) -> Column:
        return self._embed(text, self.prefixes[1])


class TermOverlap:
    """Share of the query's distinct words that the text holds, of its first `limit` characters if a limit is given."""

    def __init__(self, limit: int | None = None):
        self.limit = limit

    def score(self, query: Column, text: Column) -> Column:
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        seen = F.substring(text, 1, self.limit) if self.limit else text
        return F.size(F.array_intersect(words(query), words(seen))) / F.greatest(F.lit(1), F.size(words(query)))


class QuoteFirst:
    """Answers with the first n ids of the context, a pure function of the ordered context."""

    def __init__(self, n: int = 3):
        self.n = n

    def answer(self, query: Column, ids: Column) -> Column:
        cited = F.transform(F.slice(ids, 1, self.n), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))
        return F.when(F.size(ids) == 0, "ERROR: no context").otherwise(F.concat(F.lit("According to "), F.array_join(cited, ", "), F.lit(".")))


class CitedInContext:
    """Faithful if every id that the answer cites is in the context; null (no verdict) for error answers."""

    def faithful(self, answer: Column, context_ids: Column) -> Column:
        cited = ids_in(answer, ID_ANY)
        return F.when(~F.startswith(F.coalesce(answer, F.lit("ERROR:")), F.lit("ERROR:")), F.size(F.array_except(cited, context_ids)) == 0)


EMBEDDERS = {"local": HashedTerms(64, "query: ", "passage: "), "bge": HashedTerms(64), "remote": HashedTerms(128)}
RERANKERS = {"local": TermOverlap(), "remote": TermOverlap(200)}


def embedder(name: str) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]
