"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Two nodes of the same depth are visited together with the number of bits in which their paths
differ; a pair of nodes is dropped as soon as that number exceeds the error budget. The order
of the bits is free, so the most balanced ones come first, which keeps the trie wide.

The top of the trie is cut into leaves of bounded size (a leaf that holds many fingerprints is
cut deeper). Each pair of leaves within the budget is one piece of work: a task gets the two
sorted lists of fingerprints and goes on down the trie. It returns links that span what it
found, never all pairs of a dense group. Linked fingerprints are then joined to components by
star contractions over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import as_bytes, only, portions
from riskloom.session import settle

BITS = 64
ERRORS = 3
SHINGLE = 3
LEAF = 4096  # fingerprints a leaf holds at least before it is worth a cut
LEAVES = 4096  # about as many leaves at most, as their paths meet on the driver
_BRUTE = 64  # pairs below which two nodes are compared directly


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 (seed 42) of the word shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        prints = np.array([fingerprint(x) for x in as_bytes(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and its fingerprint ``fp`` as a signed 64-bit number; null texts have no words."""
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(_fingerprints, "doc_id long, fp long")


def reordered(prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each fingerprint with its bits in ``order`` (numbers from the top bit)."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").reshape(-1).astype(np.uint64)


def _reorder(order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(reordered(prints, order).view(np.int64))], names=["key"])

    return run


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that connect what the links (a, b) connect: each node to the least of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[label[far]], nodes[far]


def trie_links(left: np.ndarray, right: np.ndarray, errors: int = ERRORS, keep: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sorted lists of keys (the same object: within one) that differ in at
    most ``errors`` bits, reduced to links that connect the same keys."""
    own = left is right
    found_a, found_b, held = [], [], 0

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal found_a, found_b, held
        near = np.bitwise_count(a ^ b) <= errors
        near &= a != b
        found_a.append(a[near])
        found_b.append(b[near])
        held += int(near.sum())
        if held > keep:
            a, b = spanning_links(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0

    start = np.array([[0], [len(left)], [0], [len(right)], [0]], np.int64)
    stack = [(0, start)]
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(depth: int) -> tuple[np.ndarray, np.ndarray]:
        """How many keys before each place have bit ``depth`` clear."""
        if depth not in zeros:
            if len(zeros) > 4:
                zeros.clear()
            both = [np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)]) for x in ((left,) if own else (left, right))]
            zeros[depth] = (both[0], both[-1])
        return zeros[depth]

    while stack:
        depth, pairs = stack.pop()
        sizes = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small = (sizes <= _BRUTE) if depth < BITS else np.ones(len(sizes), bool)
        if small.any():
            for part in np.array_split(np.flatnonzero(small), max(1, int(sizes[small].sum()) >> 20)):
                few, n = pairs[:, part], sizes[part]
                width = np.repeat(few[3] - few[2], n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                emit(left[np.repeat(few[0], n) + place // width], right[np.repeat(few[2], n) + place % width])
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > 1 << 18:  # depth first beyond this many pairs, so memory stays bounded
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        za, zb = counts(depth)
        a_lo, a_hi, b_lo, b_hi, wrong = pairs
        a_mid, b_mid = a_lo + za[a_hi] - za[a_lo], b_lo + zb[b_hi] - zb[b_lo]
        twin = (a_lo == b_lo) & own  # a node with itself: (1, 0) mirrors (0, 1)
        children = [
            np.stack([a_lo, a_mid, b_lo, b_mid, wrong]),
            np.stack([a_mid, a_hi, b_mid, b_hi, wrong]),
            np.stack([a_lo, a_mid, b_mid, b_hi, wrong + 1]),
            np.stack([a_mid, a_hi, b_lo, b_mid, wrong + 1])[:, ~twin],
        ]
        new = np.concatenate(children, axis=1)
        stack.append((depth + 1, new[:, (new[4] <= errors) & (new[1] > new[0]) & (new[3] > new[2])]))
    a, b = np.concatenate([np.zeros(0, np.uint64), *found_a]), np.concatenate([np.zeros(0, np.uint64), *found_b])
    return spanning_links(a, b) if len(a) else (a, b)


def _search(errors: int, back: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            for i in range(batch.num_rows):
                left = np.frombuffer(batch.column("left")[i].as_py(), np.uint64)
                right = left if u[i] == v[i] else np.frombuffer(batch.column("right")[i].as_py(), np.uint64)
                found = [reordered(x, back).view(np.int64) for x in trie_links(left, right, errors)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return run


def _leaf_paths(keys: DataFrame, total: int, leaf: int, leaves: int) -> list[tuple[int, int]]:
    """Trie nodes (depth, path) that cover all keys, each with about ``limit`` keys at most."""
    limit = max(leaf, 2 * total // leaves)
    done: list[tuple[int, int]] = []
    open_, depth = [(0, 0)], 0
    if total <= limit:
        return open_
    while open_ and depth < BITS:
        step = max(1, min(12 if not depth else 6, BITS - depth))
        under = keys
        if depth:
            heavy = keys.sparkSession.createDataFrame([(_signed(p, depth),) for _, p in open_], "parent long")  # fewer than ``leaves`` rows
            under = keys.join(F.broadcast(heavy), F.shiftrightunsigned("key", BITS - depth) == F.col("parent"), "left_semi")
        deeper = depth + step
        counted = under.groupBy(F.shiftrightunsigned("key", BITS - deeper).alias("path")).agg(F.count("*").alias("n")).collect()
        count = {r["path"] & ((1 << deeper) - 1): r["n"] for r in counted}
        sums = [count]
        for _ in range(step):  # totals of all nodes between the two depths
            up: dict[int, int] = {}
            for p, n in sums[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            sums.append(up)
        todo = [(depth, p) for p in sums[-1]]
        open_ = []
        while todo:
            d, p = todo.pop()
            if sums[deeper - d][p] <= limit:
                done.append((d, p))
            elif d == deeper:
                open_.append((d, p))
            else:
                todo += [(d + 1, c) for c in (2 * p, 2 * p + 1) if c in sums[deeper - d - 1]]
        depth = deeper
    return done + open_


def _signed(path: int, depth: int) -> int:
    return path - (1 << 64) if depth == BITS and path >= 1 << 63 else path


def _node_pairs(paths: list[tuple[int, int]], errors: int) -> list[tuple[int, int]]:
    """Numbers of leaves whose common levels differ in at most ``errors`` bits."""
    depth = np.array([d for d, _ in paths], np.uint64)
    path = np.array([p for _, p in paths], np.uint64)
    out = []
    for i in range(len(paths)):
        common = np.minimum(depth[i], depth[i:])
        x = (path[i] >> (depth[i] - common)) ^ (path[i:] >> (depth[i:] - common))
        out += [(i, i + int(j)) for j in np.flatnonzero(np.bitwise_count(x) <= errors)]
    return out


def links(prints: DataFrame, errors: int = ERRORS, leaf: int = LEAF, leaves: int = LEAVES) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``errors`` bits.

    ``prints`` has distinct values in ``fp``. The links keep every connection, not every pair.
    """
    spark = prints.sparkSession
    ones = prints.agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("fp", BITS - 1 - i).bitwiseAND(1)).alias(f"b{i}") for i in range(BITS)]).first()
    total = ones["n"]
    share = np.array([(ones[f"b{i}"] or 0) / max(total, 1) for i in range(BITS)])
    order = np.argsort(np.abs(share - 0.5), kind="stable")
    keys = settle(prints.select("fp").mapInArrow(_reorder(order), "key long"), "simhash-keys")
    paths = _leaf_paths(keys, total, leaf, leaves)
    # A leaf is known by its least key; the number of a key's leaf is found by halving.
    begin = np.array([p << (BITS - d) if d else 0 for d, p in paths], np.uint64)
    rank = np.argsort(begin)
    begin, paths = begin[rank], [paths[i] for i in rank]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.sort(batch.column("key").to_numpy().view(np.uint64))
            number = np.searchsorted(begin, key, "right") - 1
            cut = np.flatnonzero(np.diff(number, prepend=-1))
            parts = np.split(key, cut[1:]) if len(key) else []
            yield pa.RecordBatch.from_arrays([pa.array(number[cut]), pa.array([x.tobytes() for x in parts], pa.binary())], names=["leaf", "part"])

    def merge(pdf):
        import pandas as pd

        whole = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["part"]]))
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "keys": [whole.tobytes()]})

    packed = keys.mapInArrow(pack, "leaf long, part binary").groupBy("leaf").applyInPandas(merge, "leaf long, keys binary")
    packed = settle(packed, "simhash-leaves")
    pairs = spark.createDataFrame(_node_pairs(paths, errors), "u long, v long")
    work = (
        pairs.join(packed.select(F.col("leaf").alias("u"), F.col("keys").alias("left")), "u")
        .join(packed.select(F.col("leaf").alias("v"), F.col("keys").alias("right")), "v")
        .select("u", "v", "left", F.when(F.col("u") != F.col("v"), F.col("right")).alias("right"))
    )
    tasks = max(1, min(len(paths) * 4, 8192))
    return work.repartition(tasks, F.xxhash64("u", "v")).mapInArrow(_search(errors, np.argsort(order)), "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node it is connected to.

    Alternates large-star and small-star contractions until nothing changes. Each round is a
    group-by with map-side minima and a join whose skew Spark can split, and is written to the
    shared folder.
    """
    both = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        way = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = way.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = way.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = settle(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        both = settle(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), label)
        state = both.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if state == before or not state[0]:
            break
        before = state
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS, leaf: int = LEAF, leaves: int = LEAVES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the least document
    id reachable over links of at most ``errors`` differing bits.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any
    other. Rows with a null id keep a row; their links count, their id is never a component's
    (null if a component has no other). Repeated rows each get their own row.
    """
    prints = settle(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = settle(components(links(distinct, errors, leaf, leaves)), "simhash-roots")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
