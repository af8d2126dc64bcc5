"""Citations: which known identifiers a text names, and which it makes up.

An identifier is two or more words joined by hyphens; its first word is its family. A text is cut into hyphenated tokens. From the
left of a token, the longest run of words that is an identifier is a citation; in what is left, a family's name followed by words in
capitals and digits, up to the last that ends in a digit, is an invented one.

Two ways to the same rows. A vocabulary of up to MOST_IDS identifiers of up to LONGEST characters (measured, not assumed) becomes a
trie of words that is sent to the tasks, which walk it over Arrow batches: no shuffle, and a frequent identifier is no hot key. A larger
one stays a table: tokens are cut into runs of words, and the runs meet the identifiers in an equi-join.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUNS = """flatten(transform(sequence(0, size(parts) - 1), i -> transform(sequence(i, least(i + {most}, size(parts)) - 1), j ->
             named_struct('i', i, 'j', j, 'run', array_join(slice(parts, i + 1, j - i + 1), '-')))))"""
_CITED = """aggregate(filter(hits, h -> h.kind = 'id'), named_struct('end', -1, 'runs', cast(array() AS array<struct<i: int, j: int, run: string>>)),
              (s, h) -> if(h.i > s.end, named_struct('end', -h.back, 'runs', concat(s.runs, array(named_struct('i', h.i, 'j', -h.back, 'run', h.run)))), s)).runs"""
_STOP = "coalesce(array_min(transform(filter(cites, c -> c.i > h.i), c -> c.i)), size(parts))"
_LAST = f"""array_max(filter(if({_STOP} > h.i + 1, sequence(h.i + 1, {_STOP} - 1), cast(array() AS array<int>)),
              x -> parts[x] RLIKE '[0-9]$' AND forall(slice(parts, h.i + 2, x - h.i), p -> p RLIKE '^[A-Z0-9_]+$')))"""
_INVENTED = f"""aggregate(filter(transform(filter(hits, h -> h.kind = 'family' AND NOT exists(cites, c -> h.i BETWEEN c.i AND c.j)),
                  h -> named_struct('i', h.i, 'last', {_LAST})), h -> h.last IS NOT NULL),
                named_struct('end', -1, 'runs', cast(array() AS array<string>)),
                (s, h) -> if(h.i > s.end, named_struct('end', h.last, 'runs', concat(s.runs, array(array_join(slice(parts, h.i + 1, h.last - h.i + 1), '-')))), s)).runs"""


#: The largest vocabulary that is sent to the tasks: some tens of megabytes.
MOST_IDS, LONGEST = 100_000, 256

_TOKEN = re.compile(r"\w+(?:-\w+)+", re.ASCII)
_CAPITALS = re.compile(r"[A-Z0-9_]+")


class Trie:
    """Identifiers by their words: a node is a dict from a word to the next node, with None in it where an identifier ends."""

    def __init__(self, ids):
        self.root: dict = {}
        for x in ids:
            node = self.root
            for word in x.split("-"):
                node = node.setdefault(word, {})
            node[None] = True

    def cited(self, parts: list[str]) -> list[tuple[int, int]]:
        """The runs (begin, end) of words that are identifiers: from the left, the longest first, none within another."""
        out, i = [], 0
        while i < len(parts):
            node, end = self.root, 0
            for j in range(i, len(parts)):
                node = node.get(parts[j])
                if node is None:
                    break
                if None in node:
                    end = j + 1
            if end:
                out.append((i, end))
            i = end or i + 1
        return out

    def invented(self, parts: list[str], cites: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out, last, k = [], 0, 0
        for i, word in enumerate(parts):
            while k < len(cites) and cites[k][1] <= i:
                k += 1
            stop = cites[k][0] if k < len(cites) else len(parts)
            if i < last or i >= stop or word not in self.root:
                continue
            end = 0
            for x in range(i + 1, stop):
                if not _CAPITALS.fullmatch(parts[x]):
                    break
                if parts[x][-1] in "0123456789":
                    end = x + 1
            if end:
                out.append((i, end))
                last = end
        return out

    def read(self, text: str | None) -> tuple[list[str], list[str]]:
        """The identifiers that a text names, and those it makes up."""
        cited, invented = {}, {}
        for token in _TOKEN.findall(text or ""):
            parts = token.split("-")
            if self.root.keys().isdisjoint(parts):
                continue
            cites = self.cited(parts)
            for into, runs in ((cited, cites), (invented, self.invented(parts, cites))):
                into.update(("-".join(parts[a:b]), None) for a, b in runs)
        return list(cited), [x for x in invented if x not in cited]


def _small(known: DataFrame) -> list[str] | None:
    """The identifiers, if they are within the bounds."""
    found = [r[0] for r in known.select(F.substring("id", 1, LONGEST + 1)).limit(MOST_IDS + 1).collect()]
    return found if len(found) <= MOST_IDS and all(len(x) <= LONGEST for x in found) else None


def citations(texts: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """key, cited, invented: the identifiers (column id of ids) that each text names and those it makes up, each once, in order.
    key is unique; a null text names none."""
    known = ids.filter(F.contains("id", F.lit("-"))).select("id").distinct()
    found = _small(known)
    return _joined(texts, known, key, text) if found is None else _walked(texts, found, key, text)


def _walked(texts: DataFrame, ids: list[str], key: str, text: str) -> DataFrame:
    rows = texts.select(key, F.col(text).cast("string").alias("_text"))
    kind = rows.schema[key].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        trie = Trie(shared.value)
        for batch in batches:
            cited, invented = zip(*map(trie.read, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            lists = [pa.array(list(x), pa.list_(pa.string())) for x in (cited, invented)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "cited", "invented"])

    return rows.mapInArrow(run, f"`{key}` {kind}, cited array<string>, invented array<string>")


def _joined(texts: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    most = known.agg(F.max(F.size(F.split("id", "-")))).first()[0] or 1
    lexicon = known.select(F.col("id").alias("run"), F.lit("id").alias("kind")).union(known.select(F.split_part("id", F.lit("-"), F.lit(1)), F.lit("family")).distinct())
    tokens = texts.select(F.col(key).alias("_key"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\w+(?:-\w+)+"), F.lit(0))).alias("at", "token"))
    runs = tokens.withColumn("parts", F.split("token", "-")).select("_key", "at", "parts", F.explode(F.expr(_RUNS.format(most=most))).alias("r"))
    found = runs.select("_key", "at", "parts", "r.i", "r.j", "r.run").join(lexicon, "run").filter("kind = 'id' OR i = j")
    each = found.groupBy("_key", "at").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("i", (-F.col("j")).alias("back"), "kind", "run"))).alias("hits"))
    each = each.withColumn("cites", F.expr(_CITED)).select("_key", "at", F.expr("cites.run").alias("c"), F.expr(_INVENTED).alias("v"))
    whole = each.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "c", "v"))).alias("t"))
    whole = whole.select("_key", F.array_distinct(F.flatten("t.c")).alias("cited"), F.array_distinct(F.flatten("t.v")).alias("_v"))
    none = F.array().cast("array<string>")
    out = texts.select(key).join(whole, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, F.coalesce("cited", none).alias("cited"), F.coalesce(F.array_except("_v", "cited"), none).alias("invented"))
