"""A Merkle manifest of a table: levels built bottom-up, proofs pushed top-down.

A row's leaf is the digest of its fields. The leaves of each tree (one for each value of ``tree``)
are put in the order of their key and numbered across the cluster; every ``FAN`` consecutive nodes
become one node of the next level, until a tree has one, its subroot. Subroots, in the order of
their trees, are the leaves of one more tree, whose last node is the root. Every level is a table
in the shared folder.

Proofs go the other way: each level joins its nodes to their parents, and each node puts its own
siblings before the proof that it inherits. So a proof is a list of levels, each the siblings left
and right of the path; what is shuffled is one proof for each run of ``FAN`` leaves, not for each leaf.

Numbering uses no window over a tree: rows are sorted by range (tree, key, leaf), each takes its
place within its partition, and partitions' counts are summed. Rows that are equal in key and leaf are
first counted as one and dealt out again in chunks of ``CHUNK``, so no range holds a large group of
copies. The driver gets the largest tree's size and the root, no more.

Defined results: null fields have a digest of their own (``-``); null keys come first in their tree
and are never tampered with; rows with equal keys stand in the order of their leaves; repeated rows
each have a leaf, a place and a proof; null and empty trees are trees like others, null first; texts
of any length are digested whole; an empty table gives an empty table; columns other than the fields
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, drop, parallelism, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Copies of a row that are dealt out together, and rows to a partition of the order.
CHUNK = 4096
ROWS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    """``-`` if null, else bytes in UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The digest (binary) of a row's fields."""
    return _sha(F.concat(*[field(v) for v in values]))


def tampered_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Column:
    """The text in lower case (A-Z) where 3 divides the key's checksum, else null."""
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.translate(docs[text].cast("string"), _UPPER, _LOWER))


def _counted(rows: DataFrame) -> DataFrame:
    """Equal rows with the number ``copy`` of each, from 0; a large group is cut before it is dealt out."""
    names = rows.columns
    groups = saved(rows.groupBy(*names).agg(F.count("*").alias("copies")))
    few = groups.where(F.col("copies") <= CHUNK).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    cut = groups.where(F.col("copies") > CHUNK).select(*names, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))).alias("first"))
    many = cut.repartition(parallelism(rows.sparkSession), "first", *names)
    many = many.select(*names, F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, F.col("copies")) - 1)).alias("copy"))
    out = saved(few.unionByName(many))
    drop(groups)
    return out


def numbered(rows: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """``rows`` (a table with ``tree``, no two rows equal in ``tree`` and ``by``) with the place
    ``pos`` of each in its tree, from 0, and the tree's size ``n``."""
    parts = max(parallelism(rows.sparkSession), rows.count() // ROWS + 1)
    ordered = rows.repartitionByRange(parts, "tree", *by).sortWithinPartitions("tree", *by)
    placed = saved(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    sizes = placed.groupBy("tree", "part").agg(F.min("at").alias("least"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("size").over(Window.partitionBy("tree"))
    shifts = sizes.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"), whole.alias("n"))
    out = keep(placed.join(shifts, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n"))
    drop(placed)
    return out


def levels_of(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels above and with ``nodes(tree, pos, n, digest)``; each has these columns, all but
    the first also the digests of the ``kids``. A node is its tree's last where ``n`` is 1."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        up = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("n") / fan).alias("n")).agg(kids.alias("kids"))
        levels.append(saved(up.withColumn("digest", _sha(F.concat_ws("", F.transform("kids", _hex))))))
        most = -(-most // fan)
    return levels


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(bytearray()), lambda a, x: F.concat(a, x))


def pushed(levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """The first level's rows with their ``proof``: a list of ``(left, right)``, the joined digests
    of the siblings, from its own level up. ``tops(tree, proof, ...)`` has the proofs of the trees' last nodes and what
    else goes to all rows of a tree. The levels above the first are dropped on the way."""
    more = [c for c in tops.columns if c != "tree"]
    parents = None
    for level, here in reversed(list(enumerate(levels))):
        last = here.where("n = 1").join(tops, "tree")
        if parents is not None:
            up = parents.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), F.col("kids").alias("run"), *[F.col(c).alias(f"up_{c}") for c in more])
            own = (F.col("pos") % fan).cast("int")
            siblings = F.struct(_joined(F.slice("run", F.lit(1), own)).alias("left"), _joined(F.slice("run", own + 2, F.lit(fan))).alias("right"))
            proof = F.concat(F.array(siblings), F.col("up_proof"))
            nodes = here.where("n > 1").join(up, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("pos") / fan) == F.col("up_pos")))
            last = last.unionByName(nodes.select(*here.columns, *[proof.alias(c) if c == "proof" else F.col(f"up_{c}").alias(c) for c in more]))
        if level == 0:
            return last
        # the result reads the first level's parents, later
        below = (checkpointed if level == 1 else saved)(last.select("tree", "pos", "kids", *more))
        if parents is not None:
            drop(parents)
        drop(here)
        parents = below
    raise ValueError("no level")


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (hex) and its proof give."""
    return F.aggregate(proof, leaf, lambda a, x: F.sha2(F.concat(_hex(x["left"]), a, _hex(x["right"])), 256))


def proof_digest(proof: Column) -> Column:
    """The digest (hex) of a proof's siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda x: F.concat(_hex(x["left"]), _hex(x["right"])))), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tree, leaf, tampered, pos, proof, subroot, root`` of each row: digests in hex, ``tampered``
    null where nothing is tampered with."""
    spark = docs.sparkSession
    values = {f: docs[f] for f in fields}
    other = tampered_text(docs, text, key)
    leaf = leaf_of(*values.values())
    spoilt = F.when(other.isNotNull(), leaf_of(*(values | {text: other}).values()))
    # a tree's name is never null, and in the same order
    named = F.coalesce(F.concat(F.lit("+"), docs[tree].cast("string")), F.lit(""))
    rows = _counted(docs.select(named.alias("tree"), docs[key].alias("key"), leaf.alias("digest"), spoilt.alias("tampered")))
    leaves = numbered(rows, ["key", "digest", "copy"], checkpointed)
    drop(rows)
    lower = levels_of(leaves)
    tops = lower[0].where("n = 1").select("tree", "digest")
    for level in lower[1:]:
        tops = tops.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots = saved(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
    upper = levels_of(numbered(subroots, ["name"]))
    drop(subroots)
    root = upper[-1].where("n = 1").select("digest").first()
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    start = spark.range(1).select(F.lit("").alias("tree"), none.alias("proof"))
    found = checkpointed(pushed(upper, start).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "proof"))
    drop(upper[0])
    out = pushed(lower, found)
    whole = F.lit(None).cast("string") if root is None else F.lit(bytes(root[0]).hex())
    name = F.when(F.col("tree") != "", F.expr("substr(tree, 2)"))
    return out.select(F.col("key").alias(key), name.alias(tree), _hex(F.col("digest")).alias("leaf"), _hex(F.col("tampered")).alias("tampered"), "pos", "proof", _hex(F.col("subroot")).alias("subroot"), whole.alias("root"))
