"""Prefix trie of conversations with totals of every subtree, rolled up by depth bands.

A node is a distinct sequence of first turns. Each turn is reduced to two hashes, its place and
its length before anything is shuffled, so no text moves. A running sum of hashes that depend on
the depth names every prefix of a conversation; equal prefixes are one node.

Totals: every node gives its own values to its ancestors inside its band of ``height`` depths and
to no other. The first nodes of the bands form a tree that is lower by that factor; its totals are
found in the same way, band by band of bands, and each completed total is then given to the
ancestors in the band above. A node gives at most ``height`` rows in either step and the number of
rounds is the logarithm of the depth.

Conversations are cut into chunks by ranges of their order, so one conversation may hold any
share of all turns. Ids of conversations that end in one node are joined in blocks and hashed in
order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import only
from riskloom.operators.scans import running_totals
from riskloom.session import settle

HEIGHT = 32  # depths in a band
FAMILY = 5  # conversations that share their first turns
LONGEST_HEAD = 8  # shared turns, at most
BLOCK = 4096  # ids that are joined in one task
HOT_PARENTS = 4096  # nodes that may have more than this share of all nodes as children
_KEY = ["ka", "kb"]
EMPTY = hashlib.sha256(b"").hexdigest()


def head_length(conv: Column) -> Column:
    """Shared turns of a conversation: CRC-32 of its decimal id, modulo 9."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(LONGEST_HEAD + 1)).cast("long")


def digests(rows: DataFrame) -> DataFrame:
    """(conv, turn, a, b, bytes): the text is replaced by 120 bits of its SHA-256 with the role."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hexed = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda start: F.conv(F.substring("hex", start, 15), 16, 10).cast("long")
    rows = rows.filter(F.col("conv").isNotNull()).select("conv", "turn", hexed.alias("hex"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.select("conv", "turn", part(1).alias("a"), part(16).alias("b"), "bytes")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, part, place, a, b, bytes): place from 1 in the order of turn, null first, then of the digest.

    Ranges of the whole order are the chunks, so a conversation of any size is cut; ``salt``
    tells repeated rows apart, which may stand in any order among themselves.
    """
    order = ["turn", "a", "b", "salt"]
    cut = turns.withColumn("salt", F.rand(7)).repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    placed = running_totals(settle(cut, "trie-turns"), ["conv"], "part", order, {"place": F.lit(1).cast("long")})
    return placed.select("conv", "part", "place", "a", "b", "bytes")


def rebuilt(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, part, place, a, b, bytes): the head comes from the family's first conversation
    (part -1), the rest is the conversation's own."""
    first = lambda c: c - c % FAMILY
    heads = placed.filter((F.col("place") <= LONGEST_HEAD) & (first(F.col("conv")) == F.col("conv"))).drop("part").withColumnRenamed("conv", "family")
    takers = convs.select("conv", first(F.col("conv")).alias("family"), head_length(F.col("conv")).alias("head"))
    lent = takers.join(heads, "family").filter("place <= head").select("conv", F.lit(-1).alias("part"), "place", "a", "b", "bytes")
    return lent.unionByName(placed.filter(F.col("place") > head_length(F.col("conv"))))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv, depth, ka, kb, ua, ub, bytes): the key of each prefix and of the one before it.

    Hashes are added up as halves of 32 bits, which fit a long for 2^31 turns.
    """
    rows = running_totals(turns, ["conv"], "part", ["place"], {"depth": F.lit(1).cast("long")})
    halves: dict[str, Column] = {}
    for name, salt in (("p", "first"), ("q", "second")):
        mixed = F.xxhash64(F.lit(salt), "depth", "a", "b")
        halves |= {f"{name}1": F.shiftrightunsigned(mixed, 32), f"{name}2": mixed.bitwiseAND(F.lit(0xFFFFFFFF))}
    rows = rows.withColumns({f"_own_{n}": e for n, e in halves.items()})
    sums = running_totals(rows, ["conv"], "part", ["place"], {f"_sum_{n}": F.col(f"_own_{n}") for n in halves})
    before = [F.col(f"_sum_{n}") - F.col(f"_own_{n}") for n in halves]
    return sums.select("conv", "depth", *key(F.col("depth"), *[F.col(f"_sum_{n}") for n in halves]), *key(F.col("depth") - 1, *before, names=("ua", "ub")), "bytes")


def key(depth: Column, *sums: Column, names: tuple[str, str] = ("ka", "kb")) -> list[Column]:
    return [F.xxhash64(F.lit(salt), depth, *sums).alias(name) for salt, name in zip(("first", "second"), names)]


def _root_key() -> list[Column]:
    zero = F.lit(0).cast("long")
    return key(zero, zero, zero, zero, zero)


def subtree_totals(paths: DataFrame, values: DataFrame, names: list[str], height: int, deepest: int) -> DataFrame:
    """(ka, kb, names): each node's values summed over its subtree.

    ``paths`` has every (conv, depth, ka, kb) from depth 0 without a gap, ``values`` one row per
    node with a conversation ``conv`` that goes through it.
    """
    banded = lambda df: df.withColumn("band", F.floor(F.col("depth") / height))
    bands = banded(paths).groupBy("conv", "band").agg(F.array_sort(F.collect_list(F.struct("depth", *_KEY))).alias("nodes"))  # height nodes at most
    added = [F.sum(n).alias(n) for n in names]
    near = banded(values).join(bands, ["conv", "band"])
    own = F.explode(F.slice("nodes", 1, (F.col("depth") - F.col("band") * height + 1).cast("int"))).alias("up")
    within = near.select(own, *names).groupBy(*[F.col(f"up.{k}").alias(k) for k in _KEY]).agg(*added)
    if deepest < height:
        return within
    within = settle(within, "trie-within")
    lowered = lambda df: df.filter(F.col("depth") % height == 0).withColumn("depth", F.floor(F.col("depth") / height))
    tops = lowered(values.select("conv", "depth", *_KEY))
    done = subtree_totals(lowered(paths), tops.join(within, _KEY), names, height, deepest // height)
    rising = tops.filter("depth > 0").join(done, _KEY).withColumn("band", F.col("depth") - 1).join(bands, ["conv", "band"])
    above = rising.select(F.explode("nodes").alias("up"), *names).groupBy(*[F.col(f"up.{k}").alias(k) for k in _KEY]).agg(*added)
    return settle(within.unionByName(above).groupBy(*_KEY).agg(*added), "trie-totals")


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key follow each other in the order of their blocks; only the hash is kept."""
    now, state = None, hashlib.sha256()
    done: list[tuple[int, int, str]] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[], [], []]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["ka", "kb", "ends_sha256"])

    for rows in batches:
        for ka, kb, ids in zip(*(rows.column(c).to_pylist() for c in ("ka", "kb", "ids"))):
            if (ka, kb) == now:
                state.update(b"," + ids.encode())
                continue
            if now:
                done.append((*now, state.hexdigest()))
            now, state = (ka, kb), hashlib.sha256(ids.encode())
        yield batch()
    if now:
        done.append((*now, state.hexdigest()))
    yield batch()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of the (conv, ka, kb) in ``ends``, ids in rising order.

    SHA-256 of one node's ids can only be taken in order; sorting and joining them is done in
    blocks before, so the stream has one row per block.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*_KEY, F.floor(F.col("conv") / BLOCK).alias("block")).agg(joined.alias("ids"))
    return blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids").mapInArrow(_hash_stream, "ka long, kb long, ends_sha256 string")


def _with_parents(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """``parent_conv_id`` of each node. Parents of more than a HOT_PARENTS-th of all nodes are few
    enough to broadcast; the join by key meets only the others."""
    parents = nodes.select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") > max(n_nodes // HOT_PARENTS, 64)
    few = F.broadcast(parents.filter(hot).drop("n_children"))  # HOT_PARENTS rows at most
    by_few = nodes.join(few, ["ua", "ub"])
    rest = nodes.join(few, ["ua", "ub"], "left_anti").join(parents.filter(~hot).drop("n_children"), ["ua", "ub"], "left")
    return by_few.unionByName(rest)


def prefix_trie(
    table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", height: int = HEIGHT
) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Rows with a null id take no part. A null turn comes before all others, a null role or text is
    empty. Several rows of one turn are several turns, in the order of the SHA-256 of the role's
    byte length, a colon, the role and the text; repeated rows each count. A conversation
    without turns after rebuilding belongs to the root. For negative ids the remainder has the
    sign of the id, as in SQL. An empty table has no nodes. Other columns are not read.
    """
    rows = only(table, conv=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("conv", "turn")})
    placed = settle(numbered(digests(rows)), "trie-places")
    convs = settle(placed.select("conv").distinct(), "trie-convs")
    steps = settle(prefix_keys(rebuilt(placed, convs)), "trie-steps")

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    found = steps.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("ua").alias("ua"), F.min("ub").alias("ub")
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*_root_key(), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"), none.alias("ua"), none.alias("ub"))
    found = settle(found.unionByName(root), "trie-found")
    children = found.filter("depth > 0").groupBy(F.col("ua").alias("ka"), F.col("ub").alias("kb")).agg(F.count("*").alias("n_children"))
    nodes = settle(found.join(children, _KEY, "left").fillna(0, ["n_children"]), "trie-nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()  # two numbers
    if not size["n"]:
        return nodes.select("conv_id", "depth", none.alias("parent_conv_id"), "n_convs", "n_children", zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit("").alias("ends_sha256"))

    paths = settle(steps.select("conv", "depth", *_KEY).unionByName(convs.select("conv", zero.alias("depth"), *_root_key())), "trie-paths")
    ends = paths.groupBy("conv").agg(F.max_by(F.struct(*_KEY), "depth").alias("k")).select("conv", "k.*")
    values = nodes.select(
        F.col("conv_id").alias("conv"), "depth", *_KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    totals = subtree_totals(paths, values, ["n_leaves", "saved_tokens"], height, size["deepest"])
    out = _with_parents(nodes, size["n"]).join(totals, _KEY).join(end_hashes(ends), _KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
