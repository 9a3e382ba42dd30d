"""Merkle manifest of a dataset: a hash tree in aligned blocks, and versions of it that copy only a leaf's ancestors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ranked, ready, saved

#: Nodes of a run, which have one parent; levels of a block, so a block has RUN ** DEEP nodes at its lowest level.
RUN, DEEP = 8, 4
#: So many groups are joined by a broadcast; if there are more, by a shuffle.
MOST_SMALL = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "tree long, idx long, path array<string>, subroot string, root string"


def node(parts: str) -> str:
    """The parent of a run of digests (their hex texts, concatenated)."""
    return sha256(parts.encode()).hexdigest()


class Block:
    """The nodes of one aligned block, level by level. They are never changed: a version of a leaf shares them all but
    the ancestors it copies. full: the tree goes on above the block, so the block has all its levels."""

    def __init__(self, leaves: list[str], full: bool, deep: int = DEEP) -> None:
        self.levels = [leaves]
        while len(self.levels) <= deep if full else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([node("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[str]:
        """Of leaf i and each of its ancestors below the top: the digests left of it in its run, and those right of it."""
        out = []
        for level in self.levels[:-1]:
            run = i - i % RUN
            out += ["".join(level[run:i]), "".join(level[i + 1 : run + RUN])]
            i //= RUN
        return out


def version(leaf: str, siblings: list[str]) -> list[str]:
    """The leaf and copies of its ancestors, up to the root: everything else is shared."""
    out = [leaf]
    for left, right in zip(siblings[::2], siblings[1::2]):
        out.append(node(left + out[-1] + right))
    return out


def _block(t: pa.Table, deep: int) -> tuple[pa.Table, Block]:
    """The rows of one block in order, and its nodes."""
    t = t.sort_by("idx")
    full = t.column("size")[0].as_py() > RUN**deep
    return t, Block([x.hex() for x in t.column("digest").to_pylist()], full, deep)


def _top(t: pa.Table, deep: int) -> pa.Table:
    t, block = _block(t, deep)
    n = -(-t.column("size")[0].as_py() // RUN**deep)
    return pa.table({"tree": t.column("tree")[:1], "idx": pa.array([t.column("idx")[0].as_py() // RUN**deep]), "size": pa.array([n]), "digest": pa.array([bytes.fromhex(block.top)])})


def _down(t: pa.Table, above: pa.Table, deep: int) -> pa.Table:
    """Paths of the nodes of a block: their siblings in it, then those of the block."""
    t, block = _block(t, deep)
    path, rows = above.column("path")[0].as_py(), len(t)
    paths = pa.array([block.siblings(i) + path for i in range(rows)], pa.list_(pa.string()))
    same = lambda c: pa.array([above.column(c)[0].as_py()] * rows, pa.string())
    return pa.table({"tree": t.column("tree"), "idx": t.column("idx"), "path": paths, "subroot": same("subroot"), "root": same("root")})


def _proved(t: pa.Table, above: pa.Table, deep: int) -> pa.Table:
    """Rows of leaves with their siblings up to the root, and the version that each given leaf makes."""
    t, block = _block(t, deep)
    path, leaves = above.column("path")[0].as_py(), block.levels[0]
    given = [own if x is None else x.hex() for own, x in zip(leaves, t.column("given").to_pylist())]
    siblings = [block.siblings(i) + path for i in range(len(t))]
    same = lambda c: pa.array([above.column(c)[0].as_py()] * len(t), pa.string())
    made = pa.array([version(x, s) for x, s in zip(given, siblings)], pa.list_(pa.string()))
    return pa.table({"key": t.column("key"), "leaf": pa.array(leaves, pa.string()), "subroot": same("subroot"), "root": same("root"), "siblings": pa.array(siblings, pa.list_(pa.string())), "version": made})


def _listed(t: pa.Table, deep: int) -> pa.Table:
    t, block = _block(t, deep)
    first, tree = t.column("idx")[0].as_py(), t.column("tree")[0].as_py()
    parts = [(tree, lv, first // RUN**lv + i, d) for lv, nodes in enumerate(block.levels) for i, d in enumerate(nodes)]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.table({c: pa.array(x, k) for c, x, k in zip(("tree", "level", "idx", "digest"), zip(*parts), kinds)})


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values one after another: "-" for null, else the length in UTF-8 bytes, ":" and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _blocks(layer: DataFrame, deep: int) -> DataFrame:
    return layer.withColumn("block", F.expr(f"idx div {RUN**deep}"))


def _summit(layer: DataFrame, size: int, deep: int) -> list[DataFrame]:
    """The layer of nodes (tree, idx, size, digest) and the layers above it, each of the tops of blocks, until every tree
    is one node; size: nodes of the largest tree."""
    layers = [layer]
    while size > 1:
        rows = _blocks(layers[-1].select("tree", "idx", "size", "digest"), deep)
        up = rows.groupBy("tree", "block").applyInArrow(lambda t: _top(t, deep), "tree long, idx long, size long, digest binary")
        layers.append(saved(up))
        size = -(-size // RUN**deep)
    return layers


class Manifest:
    """The tree of a dataset, as tables in the shared folder.

    Leaves are digests of `columns`. Those of one `group` value ascend by `key` (null first; rows of one key by their
    digest); every RUN of them, the last run having fewer, have one parent, up to the group's subroot. Subroots, ordered
    by group (null first, UTF-8 bytes), have the root in the same way. A block of RUN ** DEEP nodes is built in one task
    and its top is a node of the next layer, so no group is too large for any task, and n rows take log(n) / log(4096)
    layers. No rows give no leaves and no root. Keys are cast to long.
    """

    def __init__(self, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None, when: Column | None = None, deep: int = DEEP) -> None:
        """changed, when: columns and the rows in which they are tampered with; those leaves are only versions."""
        spark = docs.sparkSession
        ready(spark)
        self.key, self.deep = key, deep
        own = leaf_digest(*map(F.col, columns))
        given = F.when(F.coalesce(when, F.lit(False)), leaf_digest(*[(changed or {}).get(c, F.col(c)) for c in columns])) if when is not None else F.lit(None).cast("string")
        narrow = saved(docs.select(F.col(group).cast("string").alias("group"), F.col(key).cast("long").alias("key"), F.unhex(own).alias("digest"), F.unhex(given).alias("given")))
        placed = ranked(narrow, F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.xxhash64("given"))
        placed = saved(placed)
        groups = placed.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
        self.groups = saved(ranked(groups, F.col("group").asc_nulls_first(), rank="tree"))
        n, largest = self.groups.agg(F.count("*"), F.max("size")).first()
        known = self.groups.withColumnRenamed("group", "_group")
        if n <= MOST_SMALL:
            known = F.broadcast(known)
        rows = placed.join(known, F.col("group").eqNullSafe(F.col("_group")))
        leaves = rows.select("tree", (F.col("rank") - F.col("first")).alias("idx"), "size", "digest", "given", "key")
        self.layers = _summit(leaves, largest or 0, deep)
        tops = self.layers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("size"), "digest")
        self.upper = _summit(tops, n, deep)

    def nodes(self) -> DataFrame:
        """(upper, group, level, idx, digest) of every node. upper: false in the trees of groups, whose level 0 has the
        leaves and whose last level the subroot; true in the tree of the subroots (group null), whose last has the root."""
        parts, deep = [], self.deep
        for upper, layers in ((False, self.layers), (True, self.upper)):
            for depth, layer in enumerate(layers):
                # A tree that ends below this layer is one node here, which has been listed.
                rows = _blocks(layer.select("tree", "idx", "size", "digest").where(F.lit(depth == 0) | (F.col("size") > 1)), deep)
                rows = rows.groupBy("tree", "block").applyInArrow(lambda t: _listed(t, deep), "tree long, level int, idx long, digest string")
                parts.append(rows.select(F.lit(upper).alias("upper"), "tree", (F.col("level") + depth * deep).alias("level"), "idx", "digest"))
        # The top of a block that goes on is listed in both layers.
        nodes = reduce(DataFrame.unionByName, parts).distinct()
        named = nodes.join(self.groups.select("tree", "group"), "tree", "left")
        return named.select("upper", F.when(~F.col("upper"), F.col("group")).alias("group"), "level", "idx", "digest")

    def proofs(self) -> DataFrame:
        """(key, leaf, subroot, root, siblings, version) of every row: siblings of the leaf and its ancestors, up to the
        root, two texts a level (left of it and right of it in its run); version: the tampered leaf, or else the leaf,
        and the ancestors copied for it up to its own root. Blocks below share the siblings of the blocks above."""
        paths = self.upper[-1].select("tree", "idx", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        deep = self.deep

        def by(layer: DataFrame, above: DataFrame, f: Callable, schema: str) -> DataFrame:
            both = _blocks(layer, deep).groupBy("tree", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("tree", "block"))
            return both.applyInArrow(lambda t, a: f(t, a, deep), schema)

        for layer in self.upper[-2::-1]:
            paths = saved(by(layer, paths, _down, _PATH))
        tops = self.layers[-1].select("tree", F.lower(F.hex("digest")).alias("subroot"))
        paths = saved(paths.drop("tree", "subroot").withColumnRenamed("idx", "tree").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot", "root"))
        for layer in self.layers[-2:0:-1]:
            paths = saved(by(layer.select("tree", "idx", "size", "digest"), paths, _down, _PATH))
        schema = "key long, leaf string, subroot string, root string, siblings array<string>, version array<string>"
        return by(self.layers[0], paths, _proved, schema).withColumnRenamed("key", self.key)


def tampered_manifest(docs: DataFrame, deep: int = DEEP) -> DataFrame:
    """Proofs of documents as digests, and what a tampered text (A-Z lower-cased) of a third of them does to the root."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = Manifest(docs, changed={"text": lower_ascii(F.col("text"))}, when=chosen, deep=deep).proofs()
    folded = F.element_at("version", -1)
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(load(spark, sf_dir, "documents").select(*COLUMNS))


#: The same result in DuckDB SQL, which has no crc32: it is computed bit by bit.
_H = lambda text: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END" for c in (*COLUMNS[:4], text))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
_PARENTS = "SELECT {g} lv + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), CAST(ceil(n / 8.0) AS BIGINT) FROM {t} WHERE n > 1 GROUP BY {g} lv, i // 8, n"
ORACLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({_H("text")}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_H(_LOWER)}) END AS given,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
t(lang, lv, i, d, n) AS (SELECT lang, 0, i, leaf, n FROM leaves UNION ALL {_PARENTS.format(g="lang,", t="t")}),
langs AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, d, n) AS (SELECT 0, i, d, n FROM langs UNION ALL {_PARENTS.format(g="", t="u")}),
runs AS (SELECT l.doc_id, 0 AS part, t.lv, t.i, t.d, l.i >> (3 * t.lv) AS own FROM leaves l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.i // 8 = l.i >> (3 * t.lv + 3)
  UNION ALL SELECT l.doc_id, 1, u.lv, u.i, u.d, g.i >> (3 * u.lv) FROM leaves l JOIN langs g ON g.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.n > 1 AND u.i // 8 = g.i >> (3 * u.lv + 3)),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(d, '' ORDER BY part, lv, i) FILTER (i <> own), '')) AS proof_sha256 FROM runs GROUP BY doc_id),
steps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, lv) AS k, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > own), '') AS b FROM runs GROUP BY doc_id, part, lv),
f(doc_id, k, d) AS (SELECT doc_id, 0, coalesce(given, leaf) FROM leaves UNION ALL SELECT f.doc_id, f.k + 1, sha256(a || d || b) FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
folded AS (SELECT doc_id, arg_max(d, k) AS folded_root FROM f GROUP BY doc_id)
SELECT l.doc_id, leaf, g.d AS subroot, r.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.d AS verified
FROM leaves l JOIN langs g ON g.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT d FROM u WHERE n = 1) r ON true JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id)
"""
