"""Exact and near-duplicate removal.

All similarity work is expressed as equality joins on keys that two matching
rows must share, followed by an exact check.  No step forms all pairs of a group:
matches against stored rows are semi joins, and the greedy keep-first rule
compares each row of a key only with the first surviving row of that key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import ceil

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newslake.functions import fingerprint as fp
from newslake.functions import text as tx
from newslake.functions.base import let, squeeze, text
from newslake.operators import ordered
from newslake.operators.health import recent
from newslake.session import cut

RADIUS = 6
# Runs into which a fingerprint is cut: more of them make longer, rarer keys, and more keys per row.
BLOCKS = 8
# Runs of which a new fingerprint probes all near variants in the store.
PROBED_RUNS = 3
# Titles of more words are compared on single words instead of triples.
LONG_TITLE = 40
# Neighbouring runs of words of which a title shows one that may lie inside another title.
RUN_WINDOW = 8
# Bits of a title's sketch, in longs.
SKETCH_LONGS = 2
# Rows of the first prefix of keep-first, how much longer the next one is, and rows of a key that a round inside a prefix looks at.
FIRST_PREFIX = 4096
PREFIX_GROWTH = 8
DEPTH = 4096


# ------------------------------------------------------------ exact stages
def staged_first_wins(items: DataFrame, stages: dict[str, Column] | None = None) -> DataFrame:
    """Keep the first item per title, then per address hash, checksum and address among the survivors.

    Only key columns travel through the stages; the items are fetched once at the
    end.  An empty key never blocks, except the title, where empty counts as a key.
    """
    stages = stages or {
        "k_title": F.concat(F.lit("t"), F.md5(tx.normalized_title("title"))),
        "k_hash": text("url_hash"), "k_sum": text("checksum"), "k_url": text("url_normalized"),
    }
    slim = items.select("id", "arrival_idx", *[
        F.when(key != "", key).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))).alias(name)
        for name, key in stages.items()
    ])
    names = list(stages)
    for i, name in enumerate(names):
        rest = ["id", *names[i + 1:]]
        best = slim.groupBy(name).agg(F.min("arrival_idx").alias("arrival_idx"),
                                      F.min_by(F.struct(*rest), "arrival_idx").alias("_r"))
        slim = best.select("arrival_idx", "_r.*")
    return items.join(slim.select("id"), "id", "left_semi")


def unseen_keys(items: DataFrame, store: DataFrame) -> DataFrame:
    """Drop items whose guid or address hash is stored (two anti joins)."""
    return _unseen(_unseen(items, store, "guid"), store, "url_hash")


def _unseen(items: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Items whose key is not stored; an item without one joins on a value of its own, so such items never meet in one task."""
    stored = store.select(F.col(key).alias("_k")).filter(text("_k") != "").distinct()
    own = F.when(text(key) == "", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(F.col(key))
    return items.join(stored, own == F.col("_k"), "left_anti")


def unseen_addresses(items: DataFrame, store: DataFrame) -> DataFrame:
    return _unseen(items, store, "url_normalized")


def unseen_checksums(items: DataFrame, store: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Drop items whose content was published within the last hours."""
    return _unseen(items, recent(store, "published_at", as_of, hours), "checksum")


# -------------------------------------------------------------- fingerprints
def recent_fingerprints(store: DataFrame, as_of: Column, hours: int = 48, limit: int | None = None) -> DataFrame:
    """Stored fingerprints of the horizon; with ``limit`` the newest of them (a top-k)."""
    kept = recent(store, "published_at", as_of, hours).filter(F.col("simhash").isNotNull())
    if limit is not None:
        kept = kept.orderBy(F.desc("published_at"), F.desc("id")).limit(limit)
    return kept.select("simhash")


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two values within the radius agree on at least one of them.

    64 bits are cut into ``blocks`` runs.  At most ``radius`` runs can differ, so some choice
    of ``blocks - radius`` runs is untouched; more blocks mean longer, rarer keys.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = []
    for chosen in combinations(runs, blocks - radius):
        mask = 0
        for run in chosen:
            mask |= run
        masks.append(_signed(mask))
    return masks


def fingerprint_keys(h: Column, masks: list[int]) -> Column:
    """Array of keys (mask number, masked bits) of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("m"), h.bitwiseAND(F.lit(mask)).alias("v")) for i, mask in enumerate(masks)])


def probe_masks(runs: int = PROBED_RUNS, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """Per run of bits its mask, and every way to flip few enough bits of it.

    64 bits are cut into ``runs`` runs. Two values within the radius differ in at most ``radius // runs`` bits of some run, so
    one of them shows the other's bits of that run after such a flip.
    """
    edges = [round(i * 64 / runs) for i in range(runs + 1)]
    out = []
    for a, b in zip(edges, edges[1:]):
        flips = [sum(1 << bit for bit in bits) for n in range(radius // runs + 1) for bits in combinations(range(a, b), n)]
        out.append((_signed(((1 << (b - a)) - 1) << a), [_signed(f) for f in flips]))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def not_near_stored(items: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, runs: int = PROBED_RUNS) -> DataFrame:
    """Items without a stored fingerprint within the radius."""
    return items.join(near_stored(items, fingerprints, radius, runs).select("id"), "id", "left_anti")


def near_stored(items: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, runs: int = PROBED_RUNS) -> DataFrame:
    """Items within the radius of a stored fingerprint.

    The store is far larger than a batch, so keys are asymmetric: a stored fingerprint shows one key per run, and a
    distinct new one probes that run with every allowed flip. With 3 runs and radius 6 that is 3 rows against 696, and a
    probe of a run meets about one stored value in 2^21.
    """
    masks = probe_masks(runs, radius)
    new = items.where(F.col("simhash").isNotNull()).select("simhash").distinct()

    def probes(run: int, mask: int, flips: list[int]) -> Column:
        return F.transform(F.array(*[F.lit(f) for f in flips]), lambda flip: F.struct(
            F.lit(run).alias("m"), F.col("simhash").bitwiseXOR(flip).bitwiseAND(F.lit(mask)).alias("v")))

    probe = new.select("simhash", F.explode(F.flatten(F.array(*[probes(i, *m) for i, m in enumerate(masks)]))).alias("k"))
    store = fingerprints.where(F.col("simhash").isNotNull()).select(F.col("simhash").alias("_s")).distinct()
    index = store.select("_s", F.explode(fingerprint_keys(F.col("_s"), [mask for mask, _ in masks])).alias("k"))
    hit = probe.join(index, (probe["k"] == index["k"]) & (fp.hamming("simhash", "_s") <= radius), "left_semi")
    return items.join(hit.select("simhash").distinct(), "simhash", "left_semi").select(*items.columns)


# -------------------------------------------------------------------- titles
def title_columns(df: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """Add the normalised title and its content words; titles with under three words match nothing."""
    return (
        df.withColumn("norm", squeeze(tx.normalized_title("title")))
        .withColumn("tokens", F.array_sort(
            tx.title_words("title", stopwords),
            lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
            .when(a < b, -1).when(a > b, 1).otherwise(0)))
        .filter(F.size("tokens") >= 3)
    )


def overlap_keys(tokens: Column, threshold: float) -> Column:
    """Keys that two word sets of Jaccard similarity ≥ threshold must share.

    Such sets have at least ``c = ceil(3·threshold)`` (at most three) words in
    common, and in one fixed word order the first ``c`` common words lie in the
    first ``n - ceil(threshold·n) + c`` words of both.  The order is longest word first,
    which puts rarer words in front without a pass over word counts.

    Triples of a long title's head would be many, so titles of over ``LONG_TITLE`` words show single words (``c`` = 1).
    Titles that reach the threshold differ in length by no more than its share, so titles down to that share of
    ``LONG_TITLE`` show both kinds of keys and every pair has one kind in common.
    """
    n = F.size(tokens)
    none = F.array().cast("array<string>")
    short = F.when(n <= LONG_TITLE, _combined_keys(tokens, threshold)).otherwise(none)
    single = F.slice(tokens, 1, n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    long = F.when(n >= int(LONG_TITLE * threshold), F.transform(single, lambda w: F.concat(F.lit("1|"), w))).otherwise(none)
    return F.concat(short, long)


def _combined_keys(tokens: Column, threshold: float) -> Column:
    c = min(3, ceil(3 * threshold - 1e-9))
    n = F.size(tokens)
    head = F.slice(tokens, 1, n - F.ceil(n * threshold - 1e-9).cast("int") + c)

    def after(i: Column) -> Column:
        return F.slice(head, i + 2, F.greatest(F.size(head) - i - 1, F.lit(0)))

    def choose(depth: int, pool: Column, base: Column, made: list[Column]) -> Column:
        if depth == 1:
            return F.transform(pool, lambda w: F.concat_ws("|", *made, w))
        return F.flatten(F.transform(pool, lambda w, i: choose(depth - 1, after(base + i), base + i + 1, [*made, w])))

    return choose(c, head, F.lit(0), [])


def inner_keys(norm: Column, contained: bool) -> Column:
    """Keys (hashes) for "one title is part of the other".

    All words of the contained title but the first and last are whole words of the container, and so are their runs of
    three. A contained title of at least ``RUN_WINDOW`` inner runs shows the least hash of them; the container shows the least
    hash of every ``RUN_WINDOW`` neighbouring runs, among which that one must be. A shorter contained title shows its longest inner
    word with the letters at its borders; the container shows all such words.
    """
    return let(F.split(norm, " "), lambda toks: _inner_runs(toks, contained))


def _inner_runs(toks: Column, contained: bool) -> Column:
    n = F.size(toks)
    none = F.array().cast("array<bigint>")
    large = n >= RUN_WINDOW + 4

    def word(i: Column) -> Column:
        return F.xxhash64(F.right(F.element_at(toks, i - 1), F.lit(1)), F.element_at(toks, i), F.left(F.element_at(toks, i + 1), F.lit(1)))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), n - 3), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1), F.element_at(h, i + 2)))

    hashes = F.transform(toks, lambda t: F.xxhash64(t))
    places = F.sequence(F.lit(2), n - 1)
    if contained:
        longest = F.array_max(F.transform(places, lambda i: F.struct(F.length(F.element_at(toks, i)).alias("n"), word(i).alias("k"))))
        return F.when(large, F.array(F.array_min(let(hashes, runs)))).when(n >= 3, F.array(longest["k"])).otherwise(none)
    least = let(let(hashes, runs), lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - RUN_WINDOW + 1),
                                                         lambda i: F.array_min(F.slice(r, i, RUN_WINDOW))))
    return F.array_distinct(F.when(large, F.concat(F.transform(places, word), least)).when(n >= 3, F.transform(places, word)).otherwise(none))


def similar_titles(items: DataFrame, store: DataFrame, threshold: float = 0.85, stopwords: list[str] | None = None,
                   long_title: int = 40) -> DataFrame:
    """Items whose title equals, contains, is contained in, or shares enough words with a stored title.

    Both sides are reduced to distinct titles first, and every rule is a left
    semi join, so matches are found without listing them.
    """
    new = title_columns(items.select("title"), stopwords).select("norm", "tokens").distinct()
    old = title_columns(store.select("title"), stopwords).select(F.col("norm").alias("o_norm"), F.col("tokens").alias("o_tokens")).distinct()
    equal = new.join(old, new["norm"] == old["o_norm"], "left_semi").select("norm")

    a = new.select("norm", "tokens", F.explode(overlap_keys(F.col("tokens"), threshold)).alias("k"))
    b = old.select("o_tokens", F.explode(overlap_keys(F.col("o_tokens"), threshold)).alias("o_k"))
    alike = a.join(b, (F.col("k") == F.col("o_k")) & (tx.jaccard(F.col("tokens"), F.col("o_tokens")) >= threshold), "left_semi").select("norm")

    long_new = new.filter(F.length("norm") > long_title).select("norm")
    a = long_new.select("norm", F.explode(inner_keys(F.col("norm"), True)).alias("k"))
    b = old.select("o_norm", F.explode(inner_keys(F.col("o_norm"), False)).alias("o_k"))
    inside = a.join(b, (F.col("k") == F.col("o_k")) & F.contains("o_norm", "norm"), "left_semi").select("norm")

    a = long_new.select("norm", F.explode(inner_keys(F.col("norm"), False)).alias("k"))
    b = old.select("o_norm", F.explode(inner_keys(F.col("o_norm"), True)).alias("o_k"))
    around = a.join(b, (F.col("k") == F.col("o_k")) & F.contains("norm", "o_norm"), "left_semi").select("norm")

    hits = equal.unionByName(alike).unionByName(inside).unionByName(around).distinct()
    keyed = items.withColumn("_norm", squeeze(tx.normalized_title("title")))
    return keyed.join(hits, keyed["_norm"] == hits["norm"], "left_semi").drop("_norm")


# ------------------------------------------------------- greedy keep-first
@dataclass(frozen=True)
class Family:
    """One similarity rule: key columns on both sides, what a pair must meet when keys meet, and the exact check.

    ``keys`` lists (side, array of keys); rows of side 0 meet side 0, side 1 meets side 2.
    ``carry`` names small values that travel with every key, for ``near``; ``conflict`` reads the columns in ``check`` once
    per pair.  Both read them as ``e_*`` (earlier) and ``l_*``.  Without ``conflict`` the first condition is exact.
    ``earlier`` reads the item's own columns: only rows that meet it count as the earlier one of a pair.
    """

    name: str
    keys: list[tuple[int, Column]]
    carry: dict[str, Column]
    near: Column
    check: tuple[str, ...] = ()
    conflict: Column | None = None
    earlier: Column | None = None

    def rows(self, df: DataFrame) -> DataFrame:
        can = F.lit(True) if self.earlier is None else self.earlier
        # carried values are computed once per row, before its keys are listed; the outer form, as the planner would test the
        # keys of the other one in a filter below, and compute them for it again
        small = df.select("id", "arrival_idx", *[c.alias(name) for name, c in self.carry.items()], can.alias("can"),
                          *[keys.alias(f"keys_{side}") for side, keys in self.keys])
        return _union([small.select("id", "arrival_idx", *self.carry, "can", F.lit(side).alias("side"), F.explode_outer(f"keys_{side}").alias("k"))
                       for side, _ in self.keys]).where("k IS NOT NULL")

    def heads(self, rows: DataFrame) -> DataFrame:
        """Key rows as the earlier side of a meeting."""
        return rows.where("can").select(
            F.col("k").alias("_k"), F.when(F.col("side") == 0, 0).when(F.col("side") == 1, 2).otherwise(1).alias("_side"), F.col("id").alias("e"),
            F.col("arrival_idx").alias("_idx"), *[F.col(c).alias(f"e_{c}") for c in self.carry])

    def later(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", "arrival_idx", "side", "k", *[F.col(c).alias(f"l_{c}") for c in self.carry])

    def checked(self, pairs: DataFrame, earlier: DataFrame, later: DataFrame) -> DataFrame:
        """Those of the pairs (``e``, ``l``) that conflict, by the columns in ``check``."""
        if self.conflict is None:
            return pairs
        sides = [rows.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in self.check]) for s, rows in (("e", earlier), ("l", later))]
        return pairs.distinct().join(sides[0], "e").join(sides[1], "l").where(self.conflict).select("e", "l")


def _met() -> Column:
    return (F.col("k") == F.col("_k")) & (F.col("side") == F.col("_side"))


def guid_family() -> Family:
    key = F.when(text("guid") != "", F.array(F.col("guid"))).otherwise(F.array().cast("array<string>"))
    return Family("guid", [(0, key)], {}, F.lit(True))


def fingerprint_family(radius: int = RADIUS, blocks: int = BLOCKS) -> Family:
    """Keys are hashes of a mask's number and the masked bits."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("simhash").bitwiseAND(F.lit(mask))) for i, mask in enumerate(block_masks(blocks, radius))])
    return Family("simhash", [(0, F.when(F.col("simhash").isNotNull(), keys))], {"simhash": F.col("simhash")},
                  fp.hamming("e_simhash", "l_simhash") <= radius)


def title_sketch(tokens: Column) -> dict[str, Column]:
    """Parity of the words per bit: two sets differ in at least as many words as their sketches in bits."""
    def part(j: int) -> Column:
        return F.aggregate(F.filter(places, lambda p: F.shiftright(p, 6) == j), F.lit(0).cast("long"),
                           lambda bits, p: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63))))

    places = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SKETCH_LONGS)).cast("int"))
    return {f"s{j}": part(j) for j in range(SKETCH_LONGS)}


def title_families(as_of: Column, threshold: float, long_title: int = 40, hours: int = 24) -> list[Family]:
    """Title rules; an earlier item counts only while it is younger than ``hours``.

    Titles can be long, so the two word rules send hashes of keys, lengths and a sketch, and compare words once per pair.
    """
    fresh = F.col("published_at") > as_of - F.make_dt_interval(hours=F.lit(hours))
    usable = F.size("tokens") >= 3
    none = F.array().cast("array<long>")
    short, large = F.least("e_n", "l_n"), F.greatest("e_n", "l_n")
    part = F.contains("l_norm", "e_norm") | F.contains("e_norm", "l_norm")
    sketch = title_sketch(F.col("tokens"))
    # sets that reach the threshold differ in no more words than this
    bits = sum((fp.hamming(f"e_{s}", f"l_{s}") for s in sketch), F.lit(0))
    alike = bits <= (F.col("e_n") + F.col("l_n")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    inside = F.when(F.col("side") == 1, F.col("l_n") <= F.col("e_n")).otherwise(F.col("e_n") <= F.col("l_n"))

    def of_usable(keys: Column) -> Column:
        return F.when(usable, keys).otherwise(none)

    return [
        Family("title", [(0, F.when(usable, F.array(F.md5("norm"))).otherwise(F.array().cast("array<string>")))], {}, F.lit(True), earlier=fresh),
        Family("overlap", [(0, of_usable(F.transform(overlap_keys(F.col("tokens"), threshold), lambda k: F.xxhash64(k))))],
               {"n": F.size("tokens"), **sketch}, (short >= threshold * large - 1e-9) & alike, ("tokens",),
               tx.jaccard(F.col("e_tokens"), F.col("l_tokens")) >= threshold, fresh),
        Family("part", [(1, of_usable(inner_keys(F.col("norm"), True))), (2, of_usable(inner_keys(F.col("norm"), False)))],
               {"n": F.length("norm")}, (F.col("l_n") > long_title) & inside, ("norm",), part, fresh),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _conflicts(items: DataFrame, rows: DataFrame, f: Family, depth: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(conflict edges from the first ``depth`` rows of each key, ids that have earlier rows beyond them); without a depth all edges."""
    first = rows.where("can")
    heads = f.heads(first if depth is None else ordered.first_n(first, ["k", "side"], ["arrival_idx"], depth))
    pairs = f.later(rows).join(heads, _met() & (F.col("_idx") < F.col("arrival_idx")) & f.near).select("e", F.col("id").alias("l"))
    edges = f.checked(pairs, items, items)
    if depth is None:
        return edges, None
    full = heads.groupBy("_k", "_side").agg(F.count("*").alias("_n"), F.max("_idx").alias("_last")).filter(F.col("_n") >= depth)
    beyond = rows.select("id", "arrival_idx", "side", "k").join(full, _met() & (F.col("_last") < F.col("arrival_idx")), "left_semi")
    return edges, beyond.select(F.col("id").alias("l"))


def first_of_copies(items: DataFrame, same: list[str], sure: Column) -> DataFrame:
    """First arrival of each class of rows that agree in ``same``; rows that are not ``sure`` stand alone.

    If rows of a class conflict with each other, and what conflicts with one as the later row conflicts with all, a later
    row of the class always falls: to the first one if that is kept, else to what the first one fell to.
    """
    value = F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in same])
    key = F.when(sure, F.md5(value)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    first = items.groupBy(key.alias("_class")).agg(F.min_by("id", "arrival_idx").alias("id"))
    return items.join(first.select("id"), "id", "left_semi")


def _written(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The rows, cut through the checkpoint folder, and how many of them meet each condition, from the same job."""
    seen = Observation()
    done = cut(df.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()]))
    return done, seen.get


def _freed(links: DataFrame) -> DataFrame:
    """Rows that fall now: the later ends of open links (earlier ``e``, later ``l``) whose earlier end is kept.

    A row without an open link to an earlier row is kept. A null ``e`` stands for earlier rows that were not looked at yet.
    """
    held = links.select(F.col("l").alias("_held")).distinct()
    return links.where("e IS NOT NULL").join(held, F.col("e") == F.col("_held"), "left_anti").select("l").distinct()


def greedy_keep_first(items: DataFrame, families: list[Family], depth: int = 256,
                      on_round: Callable[[int, int], None] | None = None) -> DataFrame:
    """Sequential keep-first: an item is dropped if an earlier kept item conflicts with it.

    A round looks at conflicts with the first ``depth`` undecided rows of each key, so a
    key costs linear work; a small depth suits inputs with large clusters of near copies.  Items with earlier
    rows beyond the depth wait for a later round; no conflict is left out.  A level of decisions writes the rows that fall
    and the links that stay open to the checkpoint folder, and takes its counts from these two jobs.

    Frames that go from level to level pass semi and anti joins alone: other joins multiply the planner's size estimates,
    which checkpoints keep, until the numbers themselves take minutes.
    """
    left, seen = _written(items, open=F.lit(True))
    kept = _kept_ids(left, seen["open"], families, depth, on_round=on_round)
    return items.join(kept, "id", "left_semi") if kept is not None else items


def _kept_ids(left: DataFrame, count: int, families: list[Family], depth: int, growth: int = 1,
              on_round: Callable[[int, int], None] | None = None) -> DataFrame | None:
    """Ids that keep-first keeps of the written rows; each round looks ``growth`` times as deep into a key as the one before."""
    kept_parts, round_no = [], 0
    while True:
        if on_round:
            on_round(round_no, count)
        if count == 0:
            break
        # key rows are read by both sides; if an executor takes its copies along, they are computed again
        keyed = [f.rows(left).persist(StorageLevel.MEMORY_AND_DISK) for f in families]
        found = [_conflicts(left, part, f, depth if count > depth else None) for part, f in zip(keyed, families)]
        first = _union([e for e, _ in found])
        if count > depth:
            first = first.unionByName(_union([w for _, w in found]).select(F.lit(None).cast("long").alias("e"), "l"))
        links, n = _written(first.distinct(), open=F.lit(True))
        for part in keyed:
            part.unpersist()
        dropped = []
        while n["open"]:
            gone, fell = _written(_freed(links), gone=F.lit(True))
            if not fell["gone"]:
                break
            dropped.append(gone)
            # every conflict of a dropped row vanishes, on either side
            links, n = _written(links.join(gone, "l", "left_anti").join(gone.select(F.col("l").alias("e")), "e", "left_anti"), open=F.lit(True))
        rest = left.join(_union(dropped).select(F.col("l").alias("id")), "id", "left_anti") if dropped else left
        if n["open"]:
            pending = links.select(F.col("l").alias("id")).distinct()
            kept_parts.append(cut(rest.join(pending, "id", "left_anti").select("id")))
            left, seen = _written(rest.join(pending, "id", "left_semi"), open=F.lit(True))
            count = seen["open"]
        else:
            kept_parts.append(cut(rest.select("id")))
            count = 0
        depth *= growth
        round_no += 1
    return _union(kept_parts) if kept_parts else None


def keep_first_by_prefixes(items: DataFrame, families: list[Family], first: int = FIRST_PREFIX, growth: int = PREFIX_GROWTH) -> DataFrame:
    """Ids of ``greedy_keep_first``, decided prefix by prefix in the order of arrival, each ``growth`` times the one before.

    Rows after a prefix that conflict with a kept row of it fall at once, by semi joins that list no pairs; only the others are
    compared with each other.  In a dense neighbourhood few rows are kept and nearly all others fall to them, so that conflicts
    inside a prefix stay few, where all conflicts of a batch grow with its square.  ``items`` is read once per prefix and should
    be written before.
    """
    ends = _prefix_ends(items, items.count(), first, growth)
    quick = [f for f in families if f.conflict is None]
    slow = [f for f in families if f.conflict is not None]
    ids, kept = [], []
    for low, high in zip([None, *ends], [*ends, None]):
        rows = items if low is None else items.where(F.coalesce(F.col("arrival_idx") > low, F.lit(True)))
        rows = rows if high is None else rows.where(F.col("arrival_idx") <= high)
        for step in (quick, slow) if kept else ():
            if step:
                rows = cut(rows)  # read by every family
                fell = _union([_fallen(rows, _union(kept), f) for f in step])
                rows = rows.join(fell, "id", "left_anti")
        rows, seen = _written(rows, open=F.lit(True))
        found = _kept_ids(rows, seen["open"], families, DEPTH, growth)
        if found is None:
            continue
        ids.append(found)
        if high is not None:
            kept.append(cut(rows.join(found, "id", "left_semi")))
    return _union(ids) if ids else items.select("id")


def _prefix_ends(items: DataFrame, size: int, first: int, growth: int) -> list[int]:
    """Values of ``arrival_idx`` that end the prefixes, about ``first`` rows and then ``growth`` times as many; the last one is open."""
    shares = []
    while first < size:
        shares.append(first / size)
        first *= growth
    if not shares:
        return []
    return sorted(set(items.agg(F.percentile_approx("arrival_idx", shares, 10_000)).first()[0] or []))


def _fallen(rows: DataFrame, kept: DataFrame, f: Family) -> DataFrame:
    """Ids of rows that conflict with an earlier row among the kept ones."""
    heads = f.heads(f.rows(kept if f.earlier is None else kept.where(f.earlier)))
    later = f.later(f.rows(rows))
    met = _met() & (F.col("_idx") < F.col("arrival_idx")) & f.near
    if f.conflict is None:
        return later.join(heads, met, "left_semi").select("id").distinct()
    pairs = later.join(heads, met).select("e", F.col("id").alias("l"))
    return f.checked(pairs, kept, rows).select(F.col("l").alias("id")).distinct()


def near_duplicate_resolution(items: DataFrame, as_of: Column, threshold: float = 0.85, radius: int = RADIUS) -> DataFrame:
    """Keep-first over guid, fingerprint and title conflicts inside a batch.

    Copies (equal guid, fingerprint and title, where a guid that occurs once counts as none) leave one row each before
    conflicts are sought.
    """
    slim = cut(items.select(
        "id", "arrival_idx", "guid", "simhash", "published_at", squeeze(tx.normalized_title("title")).alias("norm"),
        F.array_sort(tx.title_words("title"), lambda a, b: F.when(F.length(a) > F.length(b), -1)
                     .when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("tokens"),
    ))
    shared = slim.where(text("guid") != "").groupBy("guid").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("guid").alias("_shared"))
    own = F.when(text("guid") == "", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(F.col("guid"))
    slim = slim.join(shared, own == F.col("_shared"), "left").withColumn("guid", F.col("_shared")).drop("_shared")
    slim = cut(first_of_copies(slim, ["guid", "simhash", "norm"], F.col("simhash").isNotNull() | F.col("guid").isNotNull()))
    families = [guid_family(), fingerprint_family(radius), *title_families(as_of, threshold)]
    return items.join(keep_first_by_prefixes(slim, families), "id", "left_semi")


def cap_per_tick(items: DataFrame, limit: int = 40, tick: str = "tick_id") -> DataFrame:
    """First survivors of each tick up to the publication limit."""
    return ordered.first_n(items, [tick], ["arrival_idx"], limit)
