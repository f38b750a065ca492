"""Merkle manifest of a dataset: levels built by Spark, proofs read off by a recursive query.

A leaf is the sha256 of a row's columns, each with its byte count.  Leaves of a group (``lang``) ascend by doc_id; every two
consecutive nodes become the sha256 of their hex digests (a last single one alone), until one node, the subroot, remains;
the groups' subroots, in order, likewise give the root.

* Places: leaves are range-partitioned and sorted; a row's place is its number in its partition plus the sizes of the
  partitions before (one row for each partition and group), so a group of any size is many tasks.
* Levels: blocks of 2^``BLOCK`` nodes are built by one task each, and their tops are the nodes of the next round; 1,024 times
  fewer each time.
* Stored rows are parent-linked: a node, the node ``STRIDE`` levels up (its link), and the siblings passed on that way with
  their sides.  The top of a group links to its place in the tree of subroots; the root's row has no link.
* Climb: a recursive query (``WITH RECURSIVE``) takes every leaf from link to link, appends the siblings and folds the leaf, as
  it is now, with them.  It ends after (levels / ``STRIDE``) joins, all leaves at once.
* Hot nodes: near the top all leaves pass the same few nodes.  A node that more than ``HELD`` leaves pass is there once for
  each ``HELD`` of them, and a leaf takes the copy that its place names, so no join key ever has more rows.

Defined results: nulls are ``-`` in a leaf; a null group or doc_id comes first; rows that tie in doc_id are ordered by their leaf
(equal rows have equal leaves, so any order of them gives the same tree, and each gets the proof of its own place).  A
group of one row is its own subroot, a single subroot is the root, and the proof without siblings is the digest of
nothing.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffloom.llm.common import columns_of, small, stored

STRIDE = BLOCK = 10
HELD = 4096
#: Linked nodes are sent to every task while they are no more; a row has ``STRIDE`` digests at most, so 50 MB.
BROADCAST_NODES = 100_000
TOP = -1  # the tree of subroots
NODE, ON, ROOT = 0, 1, 2  # a linked node; a block's top that goes on to the next round; the top of a tree

BUILT = (
    "kind int, tree long, n long, level int, place long, hash binary, below long, doc_id long, changed binary, "
    "up_tree long, up_level int, up_place long, up_copies long, steps array<struct<side:int,hash:binary>>, reached binary"
)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``lang, doc_id, leaf, changed``: each row's digest, and that of the row as tampering leaves it (null: the same).

    ``tampered`` says where ``n_chars`` has grown by one.
    """
    rows = columns_of(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    of = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = F.when(tampered & F.col("n_chars").isNotNull(), of(more)) if tampered is not None else F.lit(None).cast("binary")
    return rows.select("lang", "doc_id", of(F.col("n_chars")).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, group: list[str], order: list[str], facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their ``place`` (from 0) inside their group, and the groups with their size ``n``.

    The order of equal rows is that of the input.
    """
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*group, *order, "tie").sortWithinPartitions(*group, *order, "tie").drop("tie")
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "merkle-ranged")
    spans = stored(ranged.groupBy("part", *group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-spans")
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = spans.select("*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    sizes = spans.groupBy(*group).agg(F.sum("rows").alias("n"))
    if group:  # number the groups in order
        numbered, _ = placed(sizes, [], group)
        sizes = stored(numbered.withColumnRenamed("place", "tree"), "merkle-groups")
        mine = sizes.select(*(F.col(g).alias(f"its_{g}") for g in group), "tree", "n")
        same = [F.col(g).eqNullSafe(F.col(f"its_{g}")) for g in group]
        offset = offset.join(small(mine), same).drop(*(f"its_{g}" for g in group))
    held = stored(offset.withColumnsRenamed({g: f"its_{g}" for g in group}).withColumnRenamed("part", "its_part"), "merkle-offsets")
    same = [F.col("part") == F.col("its_part"), *(F.col(g).eqNullSafe(F.col(f"its_{g}")) for g in group)]
    out = ranged.join(small(held), same).withColumn("place", F.col("row") - F.col("first") + F.col("offset"))
    return out.drop("part", "row", "first", "rows", "offset", "its_part", *(f"its_{g}" for g in group)), sizes


def parent(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


def copies(below: int) -> int:
    return -(-below // HELD)


def build_block(level: int, top: bool):
    """The rows of one block of nodes of ``level``: linked nodes, and its top; ``top`` is for the tree of subroots."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree, n, first = table["tree"][0].as_py(), table["n"][0].as_py(), table["place"][0].as_py()
        height = (n - 1).bit_length()
        ups = min(BLOCK, height - level)
        hashes, below = [table["hash"].to_pylist()], [table["below"].to_pylist()]
        for _ in range(ups):
            low, few = hashes[-1], below[-1]
            hashes.append([parent(low[i], low[i + 1] if i + 1 < len(low) else None) for i in range(0, len(low), 2)])
            below.append([sum(few[i : i + 2]) for i in range(0, len(few), 2)])
        out: list[dict] = []
        payload = zip(table["doc_id"].to_pylist(), table["changed"].to_pylist())
        for s in range(0, max(ups, 1), STRIDE):
            t = min(s + STRIDE, ups)
            ends = level + t == height
            for i, own in enumerate(hashes[s]):
                j, steps = i, []
                for k in range(s, t):
                    beside = j ^ 1
                    steps.append({"side": j & 1, "hash": hashes[k][beside] if beside < len(hashes[k]) else None})
                    j >>= 1
                doc_id, changed = next(payload) if s == 0 else (None, None)
                link = (None, None, None, None) if ends and top else (TOP, 0, tree, copies(below[t][j])) if ends else (tree, level + t, (first >> t) + j, copies(below[t][j]))
                out.append(
                    {"kind": NODE, "tree": tree, "n": n, "level": level + s, "place": (first >> s) + i, "hash": own, "below": below[s][i], "doc_id": doc_id,
                     "changed": changed, "up_tree": link[0], "up_level": link[1], "up_place": link[2], "up_copies": link[3],
                     "steps": steps, "reached": hashes[t][j] if ends else None}
                )
        done = level + ups == height
        out.append({"kind": ROOT if done else ON, "tree": tree, "n": n, "level": level + ups, "place": first >> ups, "hash": hashes[ups][0], "below": below[ups][0]})
        return pa.Table.from_pylist(out, BUILT_ARROW)

    return build


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<side:int,hash:binary>>": pa.list_(pa.struct([("side", pa.int32()), ("hash", pa.binary())]))}
BUILT_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in BUILT.split(", ")])


def built(nodes: DataFrame, most: int, top: bool) -> list[DataFrame]:
    """All rounds over ``tree, n, place, hash, below, doc_id, changed``; ``most`` is the largest tree's size."""
    rounds = []
    for level in range(0, max((most - 1).bit_length(), 1), BLOCK):
        blocks = nodes.withColumn("block", F.shiftright("place", BLOCK))
        rows = blocks.groupBy("tree", "block").applyInArrow(build_block(level, top), BUILT)
        rounds.append(stored(rows, f"merkle-level-{level}"))
        nodes = rounds[-1].where(F.col("kind") == ON).select("tree", "n", "place", "hash", "below", "doc_id", "changed")
    return rounds


FOLD = """aggregate(n.steps, {start}, (own, s) -> unhex(sha2(CASE
    WHEN s.side = 1 THEN concat(lower(hex(s.hash)), lower(hex(own))) ELSE concat(lower(hex(own)), coalesce(lower(hex(s.hash)), '')) END, 256)))"""
PASSED = "aggregate(n.steps, cast('' AS binary), (own, s) -> concat(own, coalesce(s.hash, cast('' AS binary))))"
CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, own_place, at_tree, at_level, at_place, at_copy, fold, siblings, subroot, root) AS (
  SELECT n.doc_id, n.hash, n.place, n.up_tree, n.up_level, n.up_place, pmod(n.place, n.up_copies),
    {FOLD.format(start="coalesce(n.changed, n.hash)")}, {PASSED}, n.reached, cast(NULL AS binary)
  FROM {{leaves}} n
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own_place, n.up_tree, n.up_level, n.up_place, pmod(c.own_place, n.up_copies),
    {FOLD.format(start="c.fold")}, concat(c.siblings, {PASSED}), coalesce(c.subroot, n.reached),
    CASE WHEN n.up_tree IS NULL THEN n.reached END
  FROM climb c JOIN {{nodes}} n ON n.tree = c.at_tree AND n.level = c.at_level AND n.place = c.at_place AND n.copy = c.at_copy
)
SELECT doc_id, leaf, subroot, root, siblings, fold AS folded FROM climb WHERE at_tree IS NULL
"""


def climb(leaf_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, siblings, folded`` of every leaf, as one recursive query, written.

    ``siblings`` is their digests, one after another: an array of them would cost a quarter more on every step.

    The session's limit on rows of a recursive query is lifted while this one runs: it has a row a leaf and link.
    """
    spark = leaf_rows.sparkSession
    if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(CLIMB, leaves=leaf_rows, nodes=nodes), "merkle-proofs")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Every row's proof: ``doc_id, leaf, subroot, root, siblings, folded`` (binary digests, those of the siblings joined)."""
    each, groups = placed(leaves(docs, tampered), ["lang"], ["doc_id", "leaf"])
    facts = groups.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("trees")).first()
    rows = each.select("tree", "n", "place", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("below"), "doc_id", "changed")
    rounds = built(rows, facts["most"] or 1, top=False)
    tops = _all(rounds).where(F.col("kind") == ROOT)
    n_trees = F.lit(facts["trees"]).cast("long")
    subroots = tops.select(F.lit(TOP).cast("long").alias("tree"), n_trees.alias("n"), F.col("tree").alias("place"), "hash", "below", "doc_id", "changed")
    upper = built(subroots, max(facts["trees"], 1), top=True)
    linked = _all([*rounds, *upper]).where((F.col("kind") == NODE) & ((F.col("level") > 0) | (F.col("tree") == TOP)))
    share = F.expr(f"(below + {HELD - 1}L) div {HELD}L")
    nodes = linked.select("tree", "level", "place", "up_tree", "up_level", "up_place", "up_copies", "steps", "reached", F.explode(F.sequence(F.lit(0).cast("long"), share - 1)).alias("copy"))
    first = rounds[0].where((F.col("kind") == NODE) & (F.col("level") == 0))
    return climb(first.select("doc_id", "hash", "changed", "place", "up_tree", "up_level", "up_place", "up_copies", "steps", "reached"), stored(nodes, "merkle-nodes"))


def _all(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def digest(column: str) -> Column:
    """A binary digest as lowercase hex."""
    return F.lower(F.hex(column))
