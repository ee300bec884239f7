"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newslake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        path = tuple(convs[c])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[:d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] += (len(members[node]) - 1) * words
        leaves[node] += 0 if kids[node] else 1
        if node:
            saved[node[:-1]] += saved[node]
            leaves[node[:-1]] += leaves[node]
    return sorted((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids[node]), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, m in members.items())


def nodes(df):
    rows = sorted(tuple(r) for r in trie.trie(df).collect())
    return rows


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def check(df, rows):
    got, want = (sorted(part, key=_key) for part in ((tuple(r) for r in trie.trie(df).collect()), brute_trie(rows)))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, checkpoints, seed):
    """Few texts, so that prefixes are shared, whole conversations repeat and some are prefixes of others."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]) if seed % 2 else "user", rng.choice(["a", "b b", "", "c  c\tc"][:1 + seed]))
            for c in rng.sample(range(-60, 400), 150) for t in range(rng.choice([1, 1, 2, 3, 4, 9]))]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


def test_odd_conversations(spark, checkpoints):
    long = [(500, t, "user", f"turn {t} " + "w " * 30) for t in range(2000)]
    rows = [(None, 0, "user", "lost"), (0, None, "user", "first"), (0, 1, None, None), (0, 2, "assistant", ""), (1, 0, "user", "one"),
            (1, 3, "user", "x:y"), (2, 0, "user", "dup"), (2, 0, "user", "dup"), (20, 0, "us", "er a"), (21, 0, "user", "a"), (7, 5, "user", "é日本"),
            (-7, 0, "user", "minus"), (-7, 1, "assistant", "minus"), *long]
    clash = {c: F.lit("mine") for c in ("key", "part", "path", "depth", "n", "block", "base", "own", "ends", "piece")}
    check(spark.createDataFrame(rows, SCHEMA).withColumns(clash), rows)


def test_hot_conversation_and_first_turn(spark, checkpoints):
    """A third of the conversations are equal, another third share the first turns."""
    same = [(c, t, "user", f"same {t}") for c in range(0, 6000, 2) for t in range(5)]
    share = [(c, t, "user", "same 0" if t < 1 else f"{c} {t}") for c in range(1, 6000, 2) for t in range(3)]
    check(spark.createDataFrame(same + share, SCHEMA), same + share)


def test_no_conversations(spark, checkpoints):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    assert nodes(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)) == []


def test_turnless_conversation(spark, checkpoints):
    """A conversation whose own turns all fall away, and whose step is absent, ends at the root."""
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(conv, 0, "user", "gone")]
    check(spark.createDataFrame(rows, SCHEMA), rows)
    assert len(brute_trie(rows)) == 1


def test_one_partition_or_many(spark, checkpoints):
    """Nodes do not depend on how sequences are dealt."""
    rng = random.Random(9)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(300) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 2, 37):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            check(df, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
