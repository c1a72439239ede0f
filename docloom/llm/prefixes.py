"""Trie of conversation prefixes, with totals of subtrees rolled up in bands of depth.

A node is a distinct sequence of first turns. Its key holds the depth and two 64-bit sums (exclusive or) of hashes of (place,
role, text) over its turns, so keys of all prefixes come from running sums in blocks and no task holds a conversation whole.

Totals of subtrees take neither a round for each depth nor a row for each pair of node and ancestor. Depths are cut into bands of
a fixed height. Nodes explode to their ancestors inside their band only; totals of finished band roots go to the node
above them, which is the deepest of its band, and explode along with it. Band roots are a trie too, whose nodes
stand a band apart, so their totals come the same way, in bands of bands: for height 16 and a conversation of 60,000
turns there are four levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.skew import attach_per_key, running_number
from docloom.llm.tables import at_least, register, table
from docloom.session import cut_lineage

HEIGHT = 16  # depths of a band
BLOCK = HEIGHT**2  # turns whose keys are summed together; a multiple of the height
CHUNK_CHARS = 1 << 20  # characters of joined ids handed on at once
HEADS, STRIDE = 6, 100
KEY = "key struct<depth:int,x:bigint,y:bigint>"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, r (1, 2, ... in order of turn, null first), role, body (MD5 of the text) and chars (code points of the text).

    Null roles and texts are empty. Rows of an equal turn are ordered by role and MD5 of the text; repeated rows are turns of
    their own. Rows with a null conv_id name no conversation and are left out.
    """
    rows = at_least(turns, ["conv_id", "turn", "role", "text"]).where("conv_id is not null")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("body"), F.length(text).alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body"), F.col("row")]
    rows = cut_lineage(rows)
    dealt = cut_lineage(rows.repartitionByRange(_partitions(rows), "conv_id", *order).withColumn("part", F.spark_partition_id()))
    return running_number(dealt, ["conv_id"], F.col("part"), order, "r").select("conv_id", "r", "role", "body", "chars")


def rebuilt(turns: DataFrame, heads: int = HEADS, stride: int = STRIDE) -> DataFrame:
    """Turns (conv_id, p, role, body, chars, last) of conversations that open with turns of another one.

    Conversation c takes the first h = crc32(c) % heads turns of conversation c - c % stride (all if that has fewer), then its own turns
    after its first h. p counts from 1; last marks the final turn. Each conversation also has a row p = 0
    without a turn, which is last where it has no turns.
    """
    numbered = cut_lineage(numbered_turns(turns))
    convs = cut_lineage(numbered.groupBy("conv_id").agg(F.count("*").alias("n")))
    facts = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("base"))
    size_of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")
    facts = cut_lineage(facts.join(size_of_base, "base", "left").select("conv_id", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("total")))
    columns = ["conv_id", "p", "role", "body", "chars", (F.col("p") == F.col("total")).alias("last")]
    own = attach_per_key(numbered, facts.select("conv_id", "n", "h", "taken", "total"), ["conv_id"], "n", "r").where("r > h").withColumn("p", (F.col("taken") + F.col("r") - F.col("h")).cast("int"))
    opening = numbered.where((F.col("r") < heads) & (F.col("conv_id") % stride == 0)).select(F.col("conv_id").alias("base"), F.col("r").alias("p"), "role", "body", "chars")
    opening = facts.select("conv_id", "base", "h", "total").join(opening, "base").where("p <= h")
    start = facts.select("conv_id", F.lit(0).alias("p"), F.lit("").alias("role"), F.lit("").alias("body"), F.lit(0).alias("chars"), "total")
    return own.select(*columns).unionByName(opening.select(*columns)).unionByName(start.select(*columns))


def _key(depth: Column, x: Column, y: Column) -> Column:
    return F.struct(depth.cast("int").alias("depth"), x.alias("x"), y.alias("y"))


def prefixes(rows: DataFrame, height: int = HEIGHT, block: int = BLOCK) -> DataFrame:
    """conv_id, p, chars, last, key, parent (key) and path (keys from the band root down to the row itself) of each prefix of each conversation."""
    one = F.xxhash64("p", "role", "body")
    two = F.xxhash64(F.lit(7), "body", "role", "p")
    rows = rows.select("*", *[F.when(F.col("p") == 0, F.lit(0)).otherwise(lane).cast("bigint").alias(name) for name, lane in (("u", one), ("v", two))], F.floor(F.col("p") / block).cast("int").alias("block"))
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).cast("bigint").alias("before_" + c) for c in "uv"])
    inside = Window.partitionBy("conv_id", "block").orderBy("p")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, ["conv_id", "block"]).select("*", *[F.bit_xor(c).over(so_far).bitwiseXOR(F.col("before_" + c)).alias(to) for c, to in (("u", "x"), ("v", "y"))])
    parent = F.when(F.col("p") > 0, _key(F.col("p") - 1, F.col("x").bitwiseXOR(F.col("u")), F.col("y").bitwiseXOR(F.col("v"))))
    rows = rows.select("conv_id", "block", "p", "chars", "last", _key(F.col("p"), F.col("x"), F.col("y")).alias("key"), parent.alias("parent"))
    near = F.collect_list("key").over(inside.rowsBetween(1 - height, 0))
    there = (F.col("p") % height + 1).cast("int")
    return rows.withColumn("near", near).select("conv_id", "p", "chars", "last", "key", "parent", F.slice("near", F.size("near") - there + 1, there).alias("path"))


def _exploded(nodes: DataFrame) -> DataFrame:
    """Totals of leaves and saved over the part of each node's subtree that lies in its band."""
    return nodes.select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rolled_up(nodes: DataFrame, rows: DataFrame, deepest: int, height: int = HEIGHT, level: int = 0) -> DataFrame:
    """(key, leaves, saved) summed over the subtree of each node.

    nodes (key, conv_id, leaves, saved, path, up) stand height^level depths apart; path leads from the band root to the node,
    up is the node of this kind above it, and conv_id is a conversation that goes through it. rows are the prefixes of all
    conversations (conv_id, p, key).
    """
    step = height**level
    if deepest < step * height:
        return _exploded(nodes)
    within = nodes.groupBy(F.col("path")[0].alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    band = Window.partitionBy("conv_id", F.floor(F.col("p") / (step * height * height))).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    apart = rows.where(F.col("p") % (step * height) == 0).select("conv_id", "p", "key")
    paths = apart.withColumn("path", F.collect_list("key").over(band)).select("conv_id", "key", "path")
    roots = nodes.where(F.col("key.depth") % (step * height) == 0).select("key", "conv_id", "up").join(within, "key").join(paths, ["conv_id", "key"])
    over = apart.select("conv_id", (F.col("p") + step * height).alias("p"), F.col("key").alias("above"))
    roots = cut_lineage(
        roots.withColumn("p", F.col("key.depth")).join(over, ["conv_id", "p"], "left").select("key", "conv_id", "leaves", "saved", "path", F.col("above").alias("up"), F.col("up").alias("from_above"))
    )
    done = rolled_up(roots, rows, deepest, height, level + 1)
    gained = done.join(roots.where("from_above is not null").select("key", "from_above"), "key").groupBy(F.col("from_above").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    with_gains = nodes.join(gained, "key", "left").select("key", "path", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    return cut_lineage(_exploded(with_gains))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in sorted rows (key, conv_id): key, first id and ids joined by commas, some at once."""
    key, ids, size = None, [], 0
    kind = None
    rows: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([",".join(r[2]) for r in rows])], names=["key", "first", "ids"])

    held = 0
    for batch in batches:
        kind = batch.schema.field("key").type
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or size >= CHUNK_CHARS):
                rows.append((key, int(ids[0]), ids))
                held, ids, size = held + size, [], 0
                if held >= CHUNK_CHARS or len(rows) >= 10000:
                    yield batch_of(rows)
                    rows, held = [], 0
            key = k
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        rows.append((key, int(ids[0]), ids))
    if rows:
        yield batch_of(rows)


def _running_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key; rows come ordered by key and first id."""
    key, state, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("key").type
        rows: list[tuple] = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending ids (conv_id) of each key, joined by commas.

    Ids of a key with very many are joined by several tasks, in ranges; the hash is a running one, so one task reads the joined
    ranges of a key, a piece at a time.
    """
    parts = _partitions(ends)
    ends = cut_lineage(ends.select("key", "conv_id"))
    joined = ends.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined_ids, f"{KEY}, first bigint, ids string")
    joined = cut_lineage(joined)
    return joined.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_running_digest, f"{KEY}, ends_sha256 string")


def trie(turns: DataFrame, height: int = HEIGHT, heads: int = HEADS, stride: int = STRIDE) -> DataFrame:
    """One row for each node of the prefix trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, as the query op12 describes them. See numbered_turns for nulls, ties and repeated rows. Texts enter as MD5 and length, so
    very long ones are never shuffled. Other columns are ignored; an empty table has no nodes.
    """
    rows = cut_lineage(prefixes(rebuilt(turns, heads, stride), height, height**2))
    nodes = cut_lineage(rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")))
    children = rows.join(nodes, ["key", "conv_id"]).where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    children = children.withColumnRenamed("parent", "key")
    nodes = rows.select("key", "conv_id", "chars", "parent", "path").join(nodes, ["key", "conv_id"]).join(children, "key", "left")
    nodes = cut_lineage(
        nodes.select(
            "key", "conv_id", "parent", "path", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("bigint").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.col("parent").alias("up"),
        )
    )
    deepest = rows.agg(F.max("p")).first()[0]
    totals = rolled_up(nodes, rows, deepest or 0, height).select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    named = attach_per_key(
        nodes.select("key", "conv_id", "parent", "n_convs", "n_children"),
        nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_size")),
        ["parent"], "_size", "conv_id", keep_unmatched=True,
    ).drop("_size")
    ends = digests(rows.where("last"))
    nobody = hashlib.sha256(b"").hexdigest()
    return named.join(totals, "key").join(ends, "key", "left").select(
        "conv_id", F.col("key.depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")
    )


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384)))"""
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id AS c, count(*) AS n, xor({_CRC}, 4294967295) % {HEADS} AS h, conv_id - conv_id % {STRIDE} AS base FROM t GROUP BY conv_id),
facts AS (SELECT a.c, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS taken FROM convs a LEFT JOIN convs b ON b.c = a.base),
turns AS (SELECT c, r AS p, role, text FROM facts JOIN t ON t.conv_id = base AND r <= h UNION ALL SELECT c, taken + r - h, role, text FROM facts JOIN t ON t.conv_id = c AND r > h),
lists AS (SELECT facts.c, coalesce(list(md5(len(role) || ':' || role || text) ORDER BY p) FILTER (p IS NOT NULL), []) AS s FROM facts LEFT JOIN turns ON turns.c = facts.c GROUP BY facts.c),
rows AS (SELECT c, d, len(s) = d AS ends, md5(array_to_string(s[1:d], ',')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(s[1:d - 1], ',')) END AS parent FROM lists, unnest(range(0, len(s) + 1)) u(d)),
nodes AS (SELECT d, key, any_value(parent) AS parent, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM rows GROUP BY d, key),
kids AS (SELECT parent AS key, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
valued AS (SELECT nodes.*, coalesce(k, 0) AS k, (n - 1) * coalesce(len(text), 0) AS saved FROM nodes LEFT JOIN kids USING (key) LEFT JOIN turns ON turns.c = nodes.c AND turns.p = nodes.d),
totals AS (SELECT above.key, count(*) FILTER (valued.k = 0) AS n_leaves, sum(valued.saved) AS saved FROM valued JOIN rows above ON above.c = valued.c AND above.d <= valued.d GROUP BY above.key)
SELECT valued.c AS conv_id, CAST(valued.d AS BIGINT) AS depth, parents.c AS parent_conv_id, valued.n AS n_convs, valued.k AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(totals.saved AS BIGINT) AS saved_tokens, valued.ends_sha256
FROM valued JOIN totals USING (key) LEFT JOIN nodes parents ON parents.key = valued.parent
"""


@register("op12_prefix_trie", ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return trie(table(spark, folder, "conversations"))
