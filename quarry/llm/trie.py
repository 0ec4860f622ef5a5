"""op13, conversation prefix trie by heavy-path decomposition: rebuilt conversations share nodes, subtree sums come from path arrays.

Turns of a conversation are ordered by turn (null first), then by the MD5 of role and text; a null role or text is empty. Conversation c is
rebuilt as the first h turns of conversation c - c % 5 and its own turns after its first h, where h = crc32 of the decimal c, modulo 9.
Each distinct sequence of first d rebuilt turns is a node of depth d; its members are the rebuilt conversations that start with it.
The result has one row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
A node is told by (conv_id, depth), as a member has one prefix of each length.

1. Turns are sorted once, by ranges, and their places come from ids that grow with the sort, not from a window over a conversation. From
   here on only the MD5 and the number of bytes of a turn travel.
2. A prefix is told by two 64-bit exclusive-ors of hashes of (turn, place). They run over places in two levels, blocks of BLOCK places and then
   the blocks' totals, so a conversation of any length is spread. Prefixes are grouped to nodes; a hot prefix is summed before the shuffle.
3. Runs: nodes of one (conv_id, n_convs) have the same members and lie below each other. A run's parent is found by the prefix above its top.
4. Heavy paths: each run's child run with most members (ties: the smallest conv_id) continues its path, the others start paths of their own. Their
   members are at most half of the parent's, so a node has at most log2(members) light edges above it. Pointers upwards along heavy
   edges are doubled until each run knows the head of its path: no two runs of a path point to the same run, so no key is hot.
5. Sums: a path's own sum is attached to its parent run, in logarithmic rounds over the paths (each round moves all sums one path up).
   Then suffix sums along the path arrays, in two levels like 2, give leaves and saved bytes below each node.
6. Ends: the ids of conversations that end in a node are joined in order in chunks of CHUNK ids, and the SHA-256 runs over a node's chunks as
   they stream through; only the hash's state is held.

Edge cases: rows with a null conv_id take no part; repeated rows are turns of their own, in any order as they are equal; turns of one number
follow the order stated; a conversation whose rebuilt sequence is empty is a member, and an end, of the root only; texts of
any length count by their bytes; negative ids take c % 5 with the sign of c, as SQL does; an empty table gives an empty table; extra
columns are ignored, and of the table's columns only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import parts, settle

BLOCK = 1024
#: Ids of one chunk share all bits but so many.
CHUNK_BITS = 12
SHARED, SHIFTS = 5, 9
KEY = ["depth", "k1", "k2"]


def running(rows: DataFrame, keys: list[str], place: str, totals: dict[str, tuple[Callable, Callable]], last_first: bool = False) -> DataFrame:
    """Inclusive running totals over the places of each key, in two levels: within blocks of BLOCK places, then over the blocks' totals.
    totals: column -> (aggregate, how two totals join). The column is replaced."""
    order = (lambda c: F.col(c).desc()) if last_first else F.col
    rows = rows.withColumn("block", F.floor(F.col(place) / BLOCK))
    span = Window.partitionBy(*keys, "block").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(*[total(c).alias(c) for c, (total, _) in totals.items()])
    blocks = blocks.select(*keys, "block", *[total(c).over(before).alias(f"{c}_before") for c, (total, _) in totals.items()]).where(F.col(f"{next(iter(totals))}_before").isNotNull())
    here = rows.select(*[c for c in rows.columns if c not in totals], *[total(c).over(span).alias(c) for c, (total, _) in totals.items()])
    both = here.join(blocks, [*keys, "block"], "left")
    return both.select(*[c for c in rows.columns if c not in totals and c != "block"], *[F.coalesce(join(F.col(c), F.col(f"{c}_before")), F.col(c)).alias(c) for c, (_, join) in totals.items()])


XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
SUM = (F.sum, lambda a, b: a + b)


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0) within the conversation, turn hash, bytes; settled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text)).alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"))
    turns = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts(turns.sparkSession), "conv_id", F.col("turn").asc_nulls_first(), "turn_hash", "salt")
    turns = turns.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "turn_hash").withColumn("at", F.monotonically_increasing_id())
    turns = settle(turns.drop("turn", "salt"))
    # ids of a sorted part follow each other from part * 2^33 on; a row for each part tells how many rows are before it
    part = F.shiftright("at", 33)
    sizes = turns.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    turns = turns.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before"))
    starts = turns.groupBy("conv_id").agg(F.min("at").alias("start"))
    return settle(turns.join(starts, "conv_id").select("conv_id", (F.col("at") - F.col("start")).alias("place"), "turn_hash", "bytes"))


def rebuilt(turns: DataFrame, shared: int = SHARED, shifts: int = SHIFTS) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, place, turn_hash, bytes), and each conversation with its number of them."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    convs = own.withColumn("taken", F.crc32(F.col("conv_id").cast("string")) % shifts).withColumn("base", F.col("conv_id") - F.col("conv_id") % shared)
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    convs = convs.withColumn("n_base", F.least(F.coalesce("n_base", F.lit(0)), "taken")).withColumn("n_turns", F.col("n_base") + F.greatest(F.col("n_own") - F.col("taken"), F.lit(0)))
    convs = settle(convs.select("conv_id", "base", "taken", "n_base", "n_turns"))
    rest = turns.join(convs, "conv_id").where("place >= taken").select("conv_id", (F.col("place") - F.col("taken") + F.col("n_base")).alias("place"), "turn_hash", "bytes")
    heads = turns.where((F.col("place") < shifts) & (F.col("conv_id") % shared == 0)).withColumnRenamed("conv_id", "base")
    first = heads.join(convs.select("conv_id", "base", "taken"), "base").where("place < taken").select("conv_id", "place", "turn_hash", "bytes")
    return first.union(rest), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 1: depth, k1 and k2 (the prefix), p1 and p2 (the prefix above), bytes of the last turn."""
    values = [F.xxhash64("turn_hash", "place", F.lit(k)).alias(f"v{k}") for k in (1, 2)]
    rows = turns.select("conv_id", "place", "bytes", *values).withColumn("k1", F.col("v1")).withColumn("k2", F.col("v2"))
    rows = running(rows, ["conv_id"], "place", {"k1": XOR, "k2": XOR})
    return rows.select("conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("v1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("v2")).alias("p2"), "bytes")


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "bytes")])
    grouped = rows.unionByName(root).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "bytes")])
    return settle(grouped.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"))


RUN = ["conv_id", "n_convs"]


def renamed(df: DataFrame, prefix: str, *names: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in names]


def trie_runs(nodes: DataFrame) -> DataFrame:
    """conv_id, n_convs, top, bottom, saved, and the parent run's up_conv_id and up_n_convs (null above the root)."""
    runs = nodes.groupBy(*RUN).agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"))
    above = nodes.select(F.col("depth").alias("up_depth"), F.col("k1").alias("up_k1"), F.col("k2").alias("up_k2"), *renamed(nodes, "up_", *RUN))
    same = (F.col("up_depth") == F.col("top") - 1) & (F.col("up_k1") == F.col("p.p1")) & (F.col("up_k2") == F.col("p.p2"))
    return settle(runs.join(above, same, "left").select(*RUN, "top", "bottom", "saved", "up_conv_id", "up_n_convs"))


def heavy_paths(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each run with its path (head_conv_id, head_n_convs), number of child runs, and each path with the run that it hangs from."""
    heavy = runs.where("up_conv_id is not null").groupBy("up_conv_id", "up_n_convs").agg(F.count(F.lit(1)).alias("n_below"), F.max_by(F.struct("conv_id", "n_convs"), F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    children = heavy.select(F.col("up_conv_id").alias("conv_id"), F.col("up_n_convs").alias("n_convs"), "n_below")
    follows = heavy.select(F.col("heavy.conv_id").alias("conv_id"), F.col("heavy.n_convs").alias("n_convs"), *renamed(heavy, "to_", "up_conv_id", "up_n_convs"))
    linked = runs.join(children, RUN, "left").join(follows, RUN, "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)))
    linked = settle(linked.withColumnsRenamed({"to_up_conv_id": "to_conv_id", "to_up_n_convs": "to_n_convs"}))
    heads = linked.where("to_conv_id is null").select(*RUN, *renamed(linked, "head_", *RUN))
    active = linked.where("to_conv_id is not null").select(*RUN, "to_conv_id", "to_n_convs")
    while not active.isEmpty():  # to points up 2^k heavy edges; runs whose pointer meets a run that knows its head are done
        to = [F.col("to_conv_id") == F.col("at_conv_id"), F.col("to_n_convs") == F.col("at_n_convs")]
        known = heads.select(*[F.col(c).alias(f"at_{c}") for c in RUN], "head_conv_id", "head_n_convs")
        further = active.select(*[F.col(c).alias(f"at_{c}") for c in RUN], *[F.col(f"to_{c}").alias(f"next_{c}") for c in RUN])
        step = settle(active.join(known.unionByName(further, allowMissingColumns=True), to).drop("at_conv_id", "at_n_convs"))
        heads = heads.union(step.where("head_conv_id is not null").select(*RUN, "head_conv_id", "head_n_convs"))
        active = step.where("head_conv_id is null").select(*RUN, F.col("next_conv_id").alias("to_conv_id"), F.col("next_n_convs").alias("to_n_convs"))
    placed = settle(linked.drop("to_conv_id", "to_n_convs").join(heads, RUN))
    at_head = (F.col("head_conv_id") == F.col("conv_id")) & (F.col("head_n_convs") == F.col("n_convs"))
    hangs = placed.where(at_head & F.col("up_conv_id").isNotNull()).select("head_conv_id", "head_n_convs", "up_conv_id", "up_n_convs")
    of = placed.select(*renamed(placed, "up_", *RUN), F.col("head_conv_id").alias("over_conv_id"), F.col("head_n_convs").alias("over_n_convs"))
    return placed, settle(hangs.join(of, ["up_conv_id", "up_n_convs"]))


def attached(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """What light paths, and those that hang from them, add to the run that they hang from: leaves and saved."""
    head = ["head_conv_id", "head_n_convs"]
    sums = runs.groupBy(*head).agg(F.sum((F.col("n_below") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    gained, moving = None, settle(sums.join(paths, head))
    while not moving.isEmpty():
        here = moving.groupBy("up_conv_id", "up_n_convs").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        gained = here if gained is None else gained.union(here)
        up = moving.groupBy(F.col("over_conv_id").alias("head_conv_id"), F.col("over_n_convs").alias("head_n_convs")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        moving = settle(up.join(paths, head))
    if gained is None:
        return runs.select(*RUN, F.lit(0).cast("long").alias("more_leaves"), F.lit(0).cast("long").alias("more_saved")).limit(0)
    return gained.groupBy(F.col("up_conv_id").alias("conv_id"), F.col("up_n_convs").alias("n_convs")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def end_hashes(rows: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id and depth of each node where conversations end, and the SHA-256 of their ids."""
    last = rows.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(*KEY, "conv_id")
    none = convs.where("n_turns = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id")
    chunks = last.union(none).groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    chunks = chunks.join(nodes.select(*KEY, F.col("conv_id").alias("node")), KEY).select("node", "depth", "chunk", "ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, schema = None, None, pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if of != (node, depth):
                    if of:
                        done.append((*of, state.hexdigest()))
                    of, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema)
        if of:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*of, state.hexdigest())))], schema)

    return chunks.repartition(parts(rows.sparkSession), "node", "depth").sortWithinPartitions("node", "depth", "chunk").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    turns, convs = rebuilt(sorted_turns(conversations))
    rows = settle(prefixes(turns))
    nodes = trie_nodes(rows, convs)
    runs, paths = heavy_paths(trie_runs(nodes))
    runs = settle(runs.join(attached(runs, paths), RUN, "left"))
    at_bottom, at_top = F.col("depth") == F.col("bottom"), F.col("depth") == F.col("top")
    placed = nodes.select("conv_id", "n_convs", "depth", F.col("saved").alias("own")).join(runs, RUN).select(
        "conv_id", "depth", "n_convs", "head_conv_id", "head_n_convs",
        F.when(at_top, F.col("up_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.when(at_bottom, F.col("n_below")).otherwise(1).cast("long").alias("n_children"),
        F.when(at_bottom, (F.col("n_below") == 0).cast("long") + F.coalesce("more_leaves", F.lit(0))).otherwise(0).alias("n_leaves"),
        (F.col("own") + F.when(at_bottom, F.coalesce("more_saved", F.lit(0))).otherwise(0)).alias("saved_tokens"),
    )
    summed = running(placed, ["head_conv_id", "head_n_convs"], "depth", {"n_leaves": SUM, "saved_tokens": SUM}, last_first=True)
    out = summed.join(end_hashes(rows, nodes, convs), ["conv_id", "depth"], "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


#: The unsigned crc32 of a string of digits: eight shifts for each byte.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
ORACLE = f"""
WITH own AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST,
    md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), ':', coalesce(text, '')))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_CRC.format("conv_id::VARCHAR")} % {SHIFTS} AS h FROM own),
r AS (
  SELECT h.conv_id, list_concat(coalesce(base.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % {SHARED}),
m AS (SELECT conv_id, depth, turns[1:depth] AS prefix, len(turns) = depth AS ends FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS depth)),
n AS (
  SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(prefix[depth][2])) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY depth, prefix),
e AS (SELECT p.conv_id AS up, c.* FROM n c JOIN n p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]),
k AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM e GROUP BY ALL),
w AS (SELECT n.*, e.up AS parent_conv_id, coalesce(n_children, 0) AS n_children
  FROM n LEFT JOIN e ON e.conv_id = n.conv_id AND e.depth = n.depth LEFT JOIN k ON k.up = n.conv_id AND k.depth = n.depth),
t AS (
  SELECT a.conv_id, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
  FROM w a JOIN m ON m.conv_id = a.conv_id AND m.depth = a.depth
  JOIN (SELECT d.conv_id, d.depth, d.n_children, d.saved, x.depth AS at, x.prefix AS top FROM w d JOIN m x ON x.conv_id = d.conv_id AND x.depth <= d.depth) b
    ON b.at = a.depth AND b.top = a.prefix
  GROUP BY a.conv_id, a.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256 FROM w JOIN t USING (conv_id, depth)"""
