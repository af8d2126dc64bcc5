"""A Merkle manifest of a dataset: leaf digests, a tree a group, one root; and every row verified against it.

Method. Rows are leaves, in order within their group; runs of ARITY consecutive nodes are hashed into a parent until one node is
left, the group's subroot; subroots, in order of their groups, grow the same way into the root. Both trees are built by Pregel-style
supersteps over RDDs: children send their digest to their parent, a parent that holds all its children hashes them and sends its
own digest on, a node without siblings halts. Then supersteps in reverse: a parent sends each child the path it got itself and the
child's siblings. At the leaves, a run gets its path once, and each of its leaves is proved (digest of its siblings) and folded (root
recomputed from the row as it is seen now, with the original siblings).

Scale. Texts are read once and hashed in the JVM; 32 bytes a digest travel from then on. A vertex is a run: one key never has more
than ARITY messages, so a group with most of the rows is as spread as any other. A superstep shuffles an ARITY-th of the one before;
paths are made for runs, not for leaves. Leaf places come from one range sort over (group, order) and counts by partition, with no
limit on groups either: subroots are nodes of a tree built in the same way. Levels are written to the shared folder, so a lost
executor costs the tasks of one superstep. The driver sees the largest group's size and the root.

Missing values are leaves' fields as `-`. A null group is a group, and the first; null orders come first in their group; rows with
equal order follow their digests, so repeated rows may trade places but not change a root. Repeated rows are leaves each. Extra
columns are ignored, whatever their names. A group of one row is its leaf; one group's subroot is the root; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

ARITY, FIELDS = 8, ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Vertices a task works on.
EACH = 20_000
_LEVEL = "g long, p long, n long, digest binary, children binary"


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order: `-` if null, else the value's UTF-8 byte count, a colon, the value."""

    def said(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(said, fields.values())), 256))


def _sha(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def _split(blob: bytes) -> list[bytes]:
    return [blob[i : i + 32] for i in range(0, len(blob), 32)]


def _parts(vertices: int) -> int:
    return max(8, min(1 << 16, -(-vertices // EACH)))


def _frame(spark, rdd, schema: str) -> DataFrame:
    return spark.createDataFrame(rdd, schema, verifySchema=False)


def placed(rows: DataFrame) -> DataFrame:
    """rows (name, key, leaf, seen) as leaves: g, i, n (its group's number in order, its place there, the group's rows), key, leaf,
    seen. A written table."""
    order = [F.asc_nulls_first("name"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("seen")]
    numbered = rows.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    numbered = written(_frame(rows.sparkSession, numbered, "name string, key long, leaf binary, seen binary, at long"), "leaves")
    groups = numbered.groupBy("name").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    groups = groups.orderBy("start").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    groups = written(_frame(rows.sparkSession, groups, "_name string, start long, n long, g long"), "groups")
    out = numbered.join(groups, F.col("name").eqNullSafe(F.col("_name")))
    out = written(out.select("g", (F.col("at") - F.col("start")).alias("i"), "n", "key", "leaf", "seen"), "placed")
    forget(numbered, groups)
    return out


def _complete(arity: int):
    """A parent with all its children: their digests in order, and its own."""

    def run(vertex):
        (g, p), got = vertex
        got = sorted(got)
        n = got[0][1]
        if len(got) != min(arity, n - arity * p):
            raise ValueError(f"node {p} of group {g} misses children")
        children = [d for _, _, d in got]
        return g, p, -(-n // arity), _sha(children), b"".join(children)

    return run


def climb(nodes: DataFrame, most: int, total: int, arity: int = ARITY) -> list[DataFrame]:
    """The levels over nodes (g, i, n, digest): parents of nodes, parents of parents, and so on, each a written table of g, p (place),
    n (nodes of its group on this level), digest, children. A superstep a level, until the largest group (most nodes) is one."""
    spark, levels = nodes.sparkSession, []
    active = nodes.select("g", "i", "n", "digest").filter("n > 1")
    while most > 1:
        most, total = -(-most // arity), -(-total // arity)
        messages = active.rdd.map(lambda r: ((r[0], r[1] // arity), (r[1] % arity, r[2], bytes(r[3]))))
        parents = messages.groupByKey(_parts(total)).map(_complete(arity))
        levels.append(written(_frame(spark, parents, _LEVEL), "level"))
        active = levels[-1].select("g", F.col("p").alias("i"), "n", "digest").filter("n > 1")
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, depth, digest): each group's last node, and how many levels are below it."""
    found = nodes.filter("n = 1").select("g", F.lit(0).alias("depth"), "digest")
    for k, level in enumerate(levels):
        found = found.union(level.filter("n = 1").select("g", F.lit(k + 1), "digest"))
    return found


def _told(vertex):
    """What a vertex (g, p) that got its path sends to each child: the group's digest, and the path with the child's siblings in
    front. A path is a byte string: by level upwards the node's slot, the number of nodes in its run, the others' digests."""
    (g, p), (children, paths) = vertex
    (children,), (path,) = list(children), list(paths)
    arity, children = children[0], _split(children[1])
    top, path = path[:32], path[32:]
    for c in range(len(children)):
        own = bytes([c, len(children)]) + b"".join(children[:c] + children[c + 1 :])
        yield (g, p * arity + c), top + own + path


def descend(levels: list[DataFrame], starts: DataFrame, total: int, arity: int = ARITY):
    """An RDD of ((g, p), path): the path of every parent of leaves, or of the lone leaf at p = 0. starts: g, depth, path of each
    group's last node. Reverse supersteps, from the highest level down to the second."""
    spark, above, spent = levels[0].sparkSession if levels else starts.sparkSession, None, []
    for k in range(len(levels), 0, -1):
        begun = starts.filter((F.col("depth") == k) if k > 1 else (F.col("depth") <= 1)).rdd.map(lambda r: ((r[0], 0), bytes(r[2])))
        paths = begun if above is None else above.union(begun)
        if k == 1:
            return paths, spent
        vertices = levels[k - 1].select("g", "p", "children").rdd.map(lambda r: ((r[0], r[1]), (arity, bytes(r[2]))))
        sent = vertices.cogroup(paths, _parts(total // arity ** (k - 1))).flatMap(_told)
        spent.append(written(_frame(spark, sent.map(lambda x: (*x[0], x[1])), "g long, p long, path binary"), "paths"))
        above = spent[-1].rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))
    return starts.rdd.map(lambda r: ((r[0], 0), bytes(r[2]))), spent


def _opened(path: bytes) -> list[tuple[str, str]]:
    """A path's levels upwards: the hex digests left and right of the node, joined."""
    out, at = [], 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        middle, end = at + 2 + 32 * slot, at + 2 + 32 * (size - 1)
        out.append((path[at + 2 : middle].hex(), path[middle:end].hex()))
        at = end
    return out


def _proved(root: str):
    def run(vertex):
        _, got = vertex
        path = next(x for x in got if isinstance(x, bytes))
        leaves = sorted((x for x in got if not isinstance(x, bytes)), key=lambda x: x[0])
        subroot, levels = path[:32].hex(), _opened(path[32:])
        others, digests = "".join([a + b for a, b in levels]), [x[3].hex() for x in leaves]
        for k, (_, n, key, leaf, seen) in enumerate(leaves):
            left, right = "".join(digests[:k]), "".join(digests[k + 1 :])
            node = seen.hex()
            if n > 1:
                node = hashlib.sha256((left + node + right).encode()).hexdigest()
            for a, b in levels:
                node = hashlib.sha256((a + node + b).encode()).hexdigest()
            yield key, leaf.hex(), subroot, root, hashlib.sha256((left + right + others).encode()).hexdigest(), node, node == root

    return run


def verified(docs: DataFrame, seen: Column, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row. The manifest is that of docs (columns FIELDS;
    groups by lang, in order of doc_id); seen is its text as a later reader finds it."""
    spark = docs.sparkSession
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(F.col("lang").cast("string").alias("name"), F.col("doc_id").cast("long").alias("key"), leaf_digest(fields).alias("leaf"), leaf_digest(fields | {"text": seen}).alias("seen"))
    rows = written(rows, "digests")
    leaves = placed(rows)
    forget(rows)
    nodes = leaves.select("g", "i", "n", F.col("leaf").alias("digest"))
    most, total = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    levels = climb(nodes, most, total, arity)
    subroots = written(tops(nodes, levels), "subroots")
    groups = subroots.count()
    # the tree of subroots: its leaves' paths are where the groups' paths begin
    upper = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(groups).cast("long").alias("n"), "digest")
    over = climb(upper, groups, groups, arity)
    top = tops(upper, over).first()  # one row, or none
    root = bytes(top["digest"]) if top else b""
    begin = _frame(spark, spark.sparkContext.parallelize([(0, top["depth"], root)] if top else [], 1), "g long, depth int, path binary")
    paths, spent = descend(over, begin, groups, arity)
    if over:  # the last of these supersteps: runs of subroots tell each its path
        vertices = over[0].select("g", "p", "children").rdd.map(lambda r: ((r[0], r[1]), (arity, bytes(r[2]))))
        paths = vertices.cogroup(paths, _parts(groups // arity)).flatMap(_told)
    found = _frame(spark, paths.map(lambda x: (x[0][1], x[1][32:])), "g long, path binary").withColumnRenamed("g", "_g")
    starts = subroots.join(found, F.col("g") == F.col("_g")).select("g", "depth", F.concat("digest", "path").alias("path"))
    starts = written(starts, "starts")
    paths, more = descend(levels, starts, total, arity)
    runs = leaves.rdd.map(lambda r: ((r[0], r[1] // arity), (r[1], r[2], r[3], bytes(r[4]), bytes(r[5]))))
    out = runs.union(paths).groupByKey(_parts(total // arity)).flatMap(_proved(root.hex()))
    out = written(_frame(spark, out, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), "verified")
    forget(leaves, *levels, subroots, *over, *spent, starts, *more)
    return out


def lowered_thirds() -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of doc_id in decimal, else as it is."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate(F.col("text"), _UPPER, _SMALL)).otherwise(F.col("text"))


def _said(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _climb_sql(name: str, first: str, levels: int) -> list[str]:
    """Common tables name0 to name<levels> (g, i, n, d) over first, and the siblings left and right of each node, by level."""
    out = [f"{name}0 AS ({first})"]
    for k in range(levels):
        run = f"PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (SELECT g, i, n, d, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
            CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})""")
        out.append(f"""{name}{k + 1} AS (SELECT g, i // {ARITY} AS i, (max(n) + {ARITY - 1}) // {ARITY} AS n,
            CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}{k} GROUP BY g, i // {ARITY})""")
    return out


#: Levels that the SQL writes out: enough for 8**LEVELS rows a group, and 8**UPPER groups.
LEVELS, UPPER = 8, 3


def _oracle() -> str:
    crc_table = "SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    first = " || ".join(_said(c) for c in FIELDS[:-1])
    tables = [
        f"tab AS ({crc_table})",
        f"seen AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{_UPPER}', '{_SMALL}') ELSE text END AS now FROM documents, tab)",
        f"""rows0 AS (SELECT doc_id, lang, sha256({first} || {_said("text")}) AS leaf, sha256({first} || {_said("now")}) AS now FROM seen)""",
        """leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i,
            count(*) OVER (PARTITION BY lang) AS n FROM rows0)""",
        *_climb_sql("a", "SELECT g, i, n, leaf AS d FROM leaves", LEVELS),
        *_climb_sql("b", f"SELECT 0 AS g, g AS i, (SELECT count(*) FROM a{LEVELS}) AS n, d FROM a{LEVELS}", UPPER),
    ]
    steps = [f"{t}{k}.l AS {t}l{k}, {t}{k}.r AS {t}r{k}, {t}{k}.n AS {t}n{k}" for t, most in (("a", LEVELS), ("b", UPPER)) for k in range(most)]
    joins = [f"JOIN as{k} a{k} ON a{k}.g = v.g AND a{k}.i = v.i // {ARITY**k}" for k in range(LEVELS)] + [f"JOIN bs{k} b{k} ON b{k}.i = v.g // {ARITY**k}" for k in range(UPPER)]
    tables.append(f"paths AS (SELECT v.doc_id, v.leaf, v.now AS h0, {', '.join(steps)}, s.d AS subroot, r.d AS root FROM leaves v {' '.join(joins)} JOIN a{LEVELS} s ON s.g = v.g, b{UPPER} r)")
    names = [f"a@{k}" for k in range(LEVELS)] + [f"b@{k}" for k in range(UPPER)]
    for k, x in enumerate(names):
        left, right = x.replace("@", "l"), x.replace("@", "r")
        tables.append(f"fold{k} AS (SELECT *, CASE WHEN {x.replace('@', 'n')} > 1 THEN sha256({left} || h{k} || {right}) ELSE h{k} END AS h{k + 1} FROM {'paths' if k == 0 else f'fold{k - 1}'})")
    every = " || ".join(x.replace("@", s) for x in names for s in "lr")
    return f"WITH {', '.join(tables)} SELECT doc_id, leaf, subroot, root, sha256({every}) AS proof_sha256, h{len(names)} AS folded_root, h{len(names)} = root AS verified FROM fold{len(names) - 1}"


ORACLE = _oracle()
