"""Conversation prefix trie: union-find over the edges between sorted neighbours, by falling common prefix.

Conversations are sequences of turn digests, and equal ones are one weighted sequence. Sorted sequences are dealt by
range; in each partition the edges between neighbours are united from the longest common prefix to the shortest, and each
merge makes a branching node. What a partition cannot know alone lies on the paths of its first and last sequence; those two
paths are its contracted forest, and one task merges them in order, two paths per partition.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import SPACE_CHARS, WORD, cut, text_of

#: A conversation with this step takes its first turns from the last multiple of it; at most ``HEAD - 1`` turns.
STEP, HEAD = 20, 4
#: Characters of a turn's block in a key: base64 of a 16-byte digest and an 8-byte count of words.
BLOCK = 32
#: Ids per piece of a list that is hashed.
CHUNK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

SEQUENCES = "key string, n long, conv_id long, ends string"
NODES = ("part long, path int, depth long, block string, words long, conv_id long, parent_conv_id long, parent_path int, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string")
MERGED = "part long, path int, depth long, is_node boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
#: Path numbers: a node inside its partition, or on the path of the partition's first or last sequence.
INSIDE, FIRST, LAST = 0, 1, 2


def turn_block(role: Column, text: Column) -> Column:
    """Fixed-width text that stands for a turn: digest of role and text, and the text's number of words."""
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.when(F.btrim(text, F.lit(SPACE_CHARS)) == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD)))
    return F.base64(F.concat(digest, F.unhex(F.lpad(F.hex(words.cast("long")), 16, "0"))))


def heads_of(conv: Column) -> Column:
    """Number of turns that a conversation takes from the one at its step."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows conv_id and key: the blocks of the rebuilt conversation's turns, one after the other."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_block(text_of("role"), text_of("text")).alias("block"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "block")))["block"].alias("own"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP)
    heads = own.where("conv_id = base").select("base", F.slice("own", 1, HEAD - 1).alias("head"))
    h = heads_of(F.col("conv_id"))
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("own", h + 1, F.size("own"))
    return own.join(heads, "base", "left").select("conv_id", F.array_join(F.concat(head, rest), "").alias("key"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from sorted pieces of its list of ids."""
    key, total, least, digest = None, 0, 0, None
    done: list[tuple] = []
    for batch in batches:
        for k, n, low, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "low", "ids"))):
            if k != key:
                if key is not None:
                    done.append((key, total, least, digest.hexdigest()))
                key, total, least, digest = k, 0, low, hashlib.sha256()
            digest.update((f",{ids}" if total else ids).encode())
            total, least = total + n, min(least, low)
        yield _table(done, SEQUENCES)
        done = []
    if key is not None:
        yield _table([(key, total, least, digest.hexdigest())], SEQUENCES)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct keys with the number of their conversations, the least id and the digest of all ids in order.

    Keys are dealt by range and sorted. Ids meet in pieces of ``CHUNK`` neighbours first, so that a key of a third of all conversations is a few rows.
    """
    pieces = convs.groupBy("key", F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("piece")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartitionByRange("key").sortWithinPartitions("key", "piece")
    return ordered.select("key", "n", "low", "ids").mapInArrow(_hashed, SEQUENCES)


def _common(a: str, b: str) -> int:
    """Blocks that two keys share from their start."""
    n, most = 0, min(len(a), len(b)) // BLOCK
    while n < most and a.startswith(b[n * BLOCK:(n + 1) * BLOCK], n * BLOCK):
        n += 1
    return n


class Forest:
    """The nodes of sorted distinct sequences, made by uniting neighbours from the longest common prefix to the shortest."""

    def __init__(self, part: int) -> None:
        self.part = part
        self.keys: list[str] = []  # what each sequence adds to the one before
        self.common: list[int] = []
        self.length: list[int] = []
        self.weight: list[tuple[int, int, str]] = []
        self.last = ""

    def add(self, key: str, n: int, conv: int, ends: str) -> None:
        shared = _common(self.last, key) if self.length else 0
        self.common.append(shared)
        self.length.append(len(key) // BLOCK)
        self.keys.append(key[shared * BLOCK:])
        self.weight.append((n, conv, ends))
        self.last = key

    def _turn(self, i: int, depth: int) -> tuple[str, int]:
        """Block and words of a node's last turn; the node's first sequence adds it."""
        if depth == 0:
            return "", 0
        at = (depth - 1 - self.common[i]) * BLOCK
        block = self.keys[i][at:at + BLOCK]
        return block, int.from_bytes(base64.b64decode(block)[16:], "big")

    def nodes(self) -> list[list]:
        """Rows as in ``NODES``; counts of nodes on the first and last path hold only what lies inside the partition."""
        size = len(self.length)
        root = list(range(size))
        right = list(range(size))
        out: list[list] = []
        parent: list[int] = []
        top = [0] * size  # node that a component has come up to

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def new(i: int, depth: int, n: int, conv: int, ends: str) -> int:
            block, words = self._turn(i, depth)
            path = FIRST if i == 0 else LAST if right[i] == size - 1 else INSIDE
            out.append([self.part, path, depth, block, words, conv, None, None, n, 0, 0, 0, ends])
            parent.append(-1)
            return len(out) - 1

        def settle(at: int) -> None:
            """Add a whole node's own share; its members are known now."""
            row = out[at]
            if row[1] == INSIDE:
                row[10] = row[10] or 1
                row[11] += (row[8] - 1) * row[4]

        def hang(at: int, above: int) -> None:
            parent[at] = above
            if out[at][1] == INSIDE:
                out[above][9] += 1
                out[above][10] += out[at][10]
                out[above][11] += out[at][11]

        def rise(i: int, depth: int) -> int:
            """Bring a component up to a depth through nodes that do not branch."""
            at = top[i]
            settle(at)
            while out[at][2] > depth:
                up = new(i, out[at][2] - 1, out[at][8], out[at][5], NOTHING)
                hang(at, up)
                settle(up)
                at = up
            return at

        for i in range(size):
            top[i] = new(i, self.length[i], *self.weight[i])
        common = np.array(self.common[1:], dtype=np.int64)
        for edge in np.argsort(-common, kind="stable"):
            depth, b = int(common[edge]), int(edge) + 1
            a = find(int(edge))
            if out[top[a]][2] > depth:
                below = rise(a, depth + 1)
                node = new(a, depth, 0, out[below][5], NOTHING)
                out[node][8] = out[below][8]
                top[a], left = node, below
            else:
                node, left = top[a], -1
            above = rise(b, depth + 1)
            root[b], right[a] = a, right[b]
            row = out[node]
            row[1] = FIRST if a == 0 else LAST if right[a] == size - 1 else INSIDE
            row[8] += out[above][8]
            row[5] = min(row[5], out[above][5])
            if left >= 0:
                hang(left, node)
            hang(above, node)
        if size:
            rise(0, 0)
        for row, above in zip(out, parent):
            if above >= 0:
                row[6] = out[above][5]
                if row[1] == INSIDE and out[above][1] != INSIDE:
                    row[7] = out[above][1]
        return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = None
    for batch in batches:
        for part, key, n, conv, ends in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "n", "conv_id", "ends"))):
            forest = forest or Forest(part)
            forest.add(key, n, conv, ends)
    if forest:
        rows = forest.nodes()
        for at in range(0, len(rows), 10_000):
            yield _table(rows[at:at + 10_000], NODES)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the open paths of all partitions in order; rows for the nodes, and one per open place with its node's id.

    ``path`` is the way from the root to the sequence read last. A partition's first path follows it as long as the blocks
    agree; its last path leaves the first one at its own least depth.
    """
    nodes: list[list] = []  # block, words, parent, depth, conv_id, n_convs, n_children, n_leaves, saved, ends
    places: list[tuple[int, int, int, int]] = []
    path: list[int] = []
    before, follows, deep = None, True, -1
    for batch in batches:
        for part, side, depth, block, words, conv, n, children, leaves, saved, ends in zip(*(batch.column(c).to_pylist() for c in (
                "part", "path", "depth", "block", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"))):
            if part != before:
                del path[deep + 1:]
                before, follows = part, True
            if side == LAST or not follows or depth >= len(path) or nodes[path[depth]][0] != block:
                follows = False
                del path[depth:]
                nodes.append([block, words, path[-1] if path else -1, depth, conv, 0, 0, 0, 0, NOTHING])
                path.append(len(nodes) - 1)
            node = nodes[path[depth]]
            node[4] = min(node[4], conv)
            for at, value in ((5, n), (6, children), (7, leaves), (8, saved)):
                node[at] += value
            if ends != NOTHING:
                node[9] = ends
            places.append((part, side, depth, path[depth]))
            deep = depth
    for node in reversed(nodes):  # children come after their parents
        node[7] = node[7] if node[6] else 1
        node[8] += (node[5] - 1) * node[1]
        if node[2] >= 0:
            above = nodes[node[2]]
            above[6], above[7], above[8] = above[6] + 1, above[7] + node[7], above[8] + node[8]
    rows = [(-1, 0, v[3], True, v[4], nodes[v[2]][4] if v[2] >= 0 else None, v[5], v[6], v[7], v[8], v[9]) for v in nodes]
    rows += [(p, s, d, False, nodes[v][4], None, 0, 0, 0, 0, "") for p, s, d, v in places]
    for at in range(0, len(rows), 10_000):
        yield _table(rows[at:at + 10_000], MERGED)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Turns are ordered by turn (null first) and at ties by their digest; repeated rows are turns of their own; a null role
    or text counts as empty. Rows without a conv_id take no part. No conversations give no nodes, not even a root; other
    columns are not read. Equal turns are told by a 128-bit digest of role and text.

    A conversation meets in one row, as an array of 32 characters a turn. A list of ids that is hashed is read in order by
    one task in pieces of ``CHUNK`` ids, as such a digest asks for. A partition holds the numbers of its sequences and what
    each adds to the one before; the merge holds two paths per partition.
    """
    keys = sequences(rebuilt(conversations))
    found = cut(keys.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_forests, NODES))
    inside = found.where(F.col("path") == INSIDE)
    edge = found.where(F.col("path") != INSIDE).drop("parent_path", "parent_conv_id")
    merged = cut(edge.repartition(1).sortWithinPartitions("part", "path", "depth").mapInArrow(_merge, MERGED))
    places = merged.where("NOT is_node").select("part", F.col("path").alias("parent_path"), F.col("depth").alias("above"), F.col("conv_id").alias("merged"))
    hanging = inside.where("parent_path IS NOT NULL").withColumn("above", F.col("depth") - 1).join(places, ["part", "parent_path", "above"], "left")
    hanging = hanging.withColumn("parent_conv_id", F.col("merged"))
    parts = (inside.where("parent_path IS NULL"), hanging, merged.where("is_node"))
    whole = parts[0].select(*RESULT).union(parts[1].select(*RESULT)).union(parts[2].select(*RESULT))
    return whole.withColumnRenamed("ends", "ends_sha256")


def sql() -> str:
    """The trie by exploding every prefix, for small tables."""
    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), "
           "lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), "
           "lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))")
    return rf"""
WITH turns AS (SELECT conv_id, turn, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS block,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'b': block, 'w': words}} ORDER BY turn NULLS FIRST, block) AS own, CAST({crc} AS BIGINT) % {HEAD} AS h
  FROM turns GROUP BY conv_id),
convs AS (SELECT o.conv_id, coalesce(b.own[1:o.h], []) || o.own[o.h + 1:] AS seq
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {STEP}),
steps AS (SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM convs),
prefixes AS (SELECT conv_id, depth, sha256(array_to_string(list_transform(seq[1:depth], lambda s: s.b), '')) AS node,
    CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(seq[1:depth - 1], lambda s: s.b), '')) END AS parent,
    CASE WHEN depth > 0 THEN seq[depth].w ELSE 0 END AS words, depth = len(seq) AS is_end FROM steps),
nodes AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends FROM prefixes GROUP BY node, depth),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_share AS (SELECT v.*, coalesce(n_children, 0) AS n_children, (n - 1) * words AS saved FROM nodes v LEFT JOIN kids USING (node, depth)),
sums AS (SELECT p.node, p.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved
  FROM own_share v JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node, p.depth)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM own_share v JOIN sums s USING (node, depth) LEFT JOIN nodes u ON u.node = v.parent AND u.depth = v.depth - 1
"""
