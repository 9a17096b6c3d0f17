"""The prefix trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib

import pytest

from riskloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, ka string, bytes string, place int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, turns):
    return spark.createDataFrame([(*t, 1, "k", "b", 2) for t in turns], SCHEMA)


def brute(turns):
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]
            own.setdefault(c, []).append(((t is not None, t or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n in members:
        cost = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += cost
    out = []
    for n, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(n))))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(convs), len(n), parent, len(convs), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def odd_turns():
    """Nulls, empty and very long texts, ties, repeated rows, ids without a family, and one deep conversation."""
    rng = random.Random(5)
    turns = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "ok", "é\U0001f600", ""])) for c in range(60) for t in range(rng.randrange(1, 9))]
    turns = [t for t in turns if t[0] not in (20, 35)]  # families without their first conversation
    turns += [(70, t, "user", f"turn {t % 3}") for t in range(150)] + [(75, t, "user", f"turn {t % 3}") for t in range(130)]
    turns += [(71, 1, "user", "x")] * 4 + [(72, 5, None, "y"), (72, 5, "user", None), (72, None, "a", "b"), (72, None, None, None), (72, -3, "a", "")]
    turns += [(None, 1, "user", "lost"), (80, 0, "user", "z" * 200_000), (81, 0, "user", "z" * 200_000), (10**15, 0, "user", "far")]
    # the same turn parts differently into role and text
    return turns + [(90, 0, "ab", "c"), (95, 0, "a", "bc")]


@pytest.mark.parametrize("height", [2, 7, 32])
def test_prefix_trie(spark, height):
    turns = odd_turns()
    got = prefix_trie.prefix_trie(table(spark, turns), height=height)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == sorted(brute(turns), key=lambda r: (r[0], r[1]))


def test_many_equal_conversations(spark, monkeypatch):
    """Broadcast parents, blocks of ids, and a conversation cut by ranges."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 10**9)
    turns = [(c, t, "user", "same" if t < 2 else f"{c % 7 and c}") for c in range(0, 600) for t in range(3)]
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(table(spark, turns)).collect() if r["depth"]) == [r for r in brute(turns) if r[1]]


def test_no_conversations_and_one(spark):
    empty = prefix_trie.prefix_trie(table(spark, []))
    assert empty.columns == COLUMNS and empty.count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).count() == 0
    one = [(3, 0, "user", "short")]  # its head comes from conversation 0, which does not exist
    assert [tuple(r) for r in prefix_trie.prefix_trie(table(spark, one)).collect()] == brute(one)


def test_every_turn_of_one_conversation_is_cut(spark):
    """Nine tenths of all turns in one conversation: its places run through, and no chunk holds it all."""
    turns = [(0, t, "user", str(t % 11)) for t in range(9000)] + [(c, 0, "user", "a") for c in range(1, 1000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefix_trie.numbered(prefix_trie.digests(table(spark, turns).withColumnRenamed("conv_id", "conv"))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    own = [r for r in placed if r["conv"] == 0]
    assert sorted(r["place"] for r in own) == list(range(1, 9001))
    sizes = {}
    for r in own:
        sizes[r["part"]] = sizes.get(r["part"], 0) + 1
    assert len(sizes) >= 6 and max(sizes.values()) < 3000
