"""Byte-level BPE in recursive DuckDB queries, one connection per partition.

Encoding: the bytes of unseen words are token-position rows; each step joins neighbouring tokens with the merge table and
contracts the leftmost pair of least rank in every word, until no pair is left. Decoding: ordered aggregation of the tokens'
bytes, one letter per byte. Spark deals the documents; a Python worker keeps the vocabulary's tables and a bounded cache of words.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import threading
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one recursive query, and the token-position rows that it may start with.
WORDS, START_ROWS = 30_000, 400_000
#: Rows that a recursion may gather over all its steps; a longer one goes on from where it stopped.
STEP_ROWS = 4_000_000
#: Cached pieces of text and words; a full cache is emptied, which costs time but changes nothing.
CACHE = 900_000
#: Seconds after a Python worker's last task in which it keeps its tokenizer; idle workers share the executor's memory with later stages.
IDLE = 1.5
#: Tokens that are decoded in one query.
DECODE = 1_000_000
_PLACE = 1 << 30

ENCODE = f"""
WITH RECURSIVE step(n, wid, pos, tok) AS (
  SELECT 0, wid, pos, tok FROM words
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT n, wid, pos, tok, lead(tok) OVER w AS nxt, lag(pos) OVER w AS before FROM step WINDOW w AS (PARTITION BY wid ORDER BY pos)),
   best AS (SELECT wid, min(CAST(m.rank AS BIGINT) * {_PLACE} + pos) AS pick FROM pairs JOIN merges m ON tok = m.l AND nxt = m.r GROUP BY wid)
   SELECT n + 1, pairs.wid, pos, CASE WHEN pos = pick % {_PLACE} THEN CAST(pick // {_PLACE} AS INTEGER) ELSE tok END
   FROM pairs JOIN best ON pairs.wid = best.wid WHERE n < ? AND (before IS NULL OR before <> pick % {_PLACE})))
SELECT n, wid, pos, tok FROM step
"""
# The connection has one thread, so rows are aggregated in the order of the inner query.
DECODED = """
SELECT doc, string_agg(letters, '') AS letters FROM (SELECT doc, letters FROM tokens JOIN vocabulary USING (tok) ORDER BY pos) GROUP BY doc
"""


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; a rank without a token is empty."""
    with open(path, "rb") as lines:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
    out = [b""] * (max(r for _, r in pairs) + 1)
    for token, rank in pairs:
        out[rank] = token
    return out


class Tokenizer:
    """Vocabulary, merge table and learnt words of one Python worker."""

    def __init__(self, tokens: Sequence[bytes], pattern: str) -> None:
        import duckdb  # here alone, so that the other queries do not need it

        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        #: Ids, as 32-bit integers, of pieces of text and of the words of pieces that hold several.
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = np.array([(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                           if t[:i] in self.ranks and t[i:] in self.ranks], dtype=np.int32).reshape(-1, 3)
        self._create("merges", pa.table({"l": merges[:, 0], "r": merges[:, 1], "rank": merges[:, 2]}))
        self._create("vocabulary", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "letters": [t.decode("latin-1") for t in self.ranks]}))

    def _create(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, by recursive contraction."""
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        wid = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int64)
        tok = self.single[raw]
        done = [b""] * len(words)
        while len(wid):
            steps = max(4, STEP_ROWS // len(wid))
            self.con.register("words", pa.table({"wid": wid, "pos": pos, "tok": tok}))
            got = self.con.execute(ENCODE, [steps]).fetchnumpy()
            last = np.zeros(len(words), dtype=got["n"].dtype)
            np.maximum.at(last, got["wid"], got["n"])
            end = got["n"] == last[got["wid"]]
            wid, pos, tok = got["wid"][end], got["pos"][end], got["tok"][end].astype(np.int32)
            order = np.argsort(wid.astype(np.int64) * _PLACE + pos)
            wid, pos, tok = wid[order], pos[order], tok[order]
            cuts = np.flatnonzero(np.diff(wid, prepend=-1, append=-1))
            ids = tok.tobytes()
            for w, i, j in zip(wid[cuts[:-1]].tolist(), (4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist()):
                done[w] = ids[i:j]
            open_ = last[wid] == steps
            wid, pos, tok = wid[open_], pos[open_], tok[open_]
        return done

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words; a word that is a token needs no merges."""
        out: dict[str, bytes] = {}
        new: list[tuple[str, bytes]] = []
        for word in words:
            raw = word.encode("utf-8", "replace")
            if raw in self.ranks:
                out[word] = self.ranks[raw].to_bytes(4, "little")
            else:
                new.append((word, raw))
        new.sort(key=lambda w: len(w[1]))  # long words share queries with long words
        at = 0
        while at < len(new):
            end, rows = at, 0
            while end < len(new) and end - at < WORDS and (end == at or rows + len(new[end][1]) <= START_ROWS):
                rows += len(new[end][1])
                end += 1
            out.update(zip((word for word, _ in new[at:end]), self.contract([raw for _, raw in new[at:end]])))
            at = end
        return out

    def _know(self, pieces: set[str]) -> None:
        """Learn the pieces that are not cached."""
        if len(self.pieces) + len(self.words) > CACHE:
            self.pieces.clear()
            self.words.clear()
        matches = {p: self.pattern.findall(p) for p in pieces if p not in self.pieces}
        alone = {p for p, found in matches.items() if found == [p]}
        inner = {w for p, found in matches.items() if p not in alone for w in found if w not in self.words}
        learnt = self.learn(alone | inner)
        self.words.update((w, learnt[w]) for w in inner)
        self.pieces.update((p, learnt[p]) for p in alone)
        self.pieces.update((p, b"".join([self.words[w] for w in found])) for p, found in matches.items() if p not in alone)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (and the last ones end).

        A blank before a character other than white space starts a match of the pattern, so texts are cut there. Texts are
        split at blanks and their parts numbered; where a part is empty or starts with white space, the text is one piece more
        than its parts tell, and is cut by ``_pieces``.
        """
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        names, index, starts = coded.dictionary.to_pylist(), coded.indices.to_numpy(), parts.offsets.to_numpy()
        index = index.astype(np.int64)
        joins = np.array([not p or p[0].isspace() for p in names], dtype=bool)[index] if len(index) else np.zeros(0, dtype=bool)
        joins[starts[:-1]] = False
        whole = np.add.reduceat(joins, starts[:-1]) > 0 if len(texts) else np.zeros(0, dtype=bool)
        inner = np.ones(len(index), dtype=bool)
        inner[starts[:-1]] = False
        inner &= ~np.repeat(whole, np.diff(starts))
        seen = np.zeros(len(names), dtype=bool)
        seen[index[inner]] = True
        used = np.flatnonzero(seen)
        cut = {t: _pieces(texts[t]) for t in np.flatnonzero(whole)}
        heads = [cut[t] if whole[t] else [names[i]] if names[i] else [] for t, i in enumerate(index[starts[:-1]].tolist())]
        spaced = [" " + names[i] for i in used.tolist()]
        self._know({*spaced, *(p for head in heads for p in head)})
        known = self.pieces
        entries = [known[p] for p in spaced] + [b"".join([known[p] for p in head]) for head in heads]
        number = np.full(len(names), -1, dtype=np.int64)
        number[used] = np.arange(len(used))
        place = np.where(inner, number[index], -1)
        place[starts[:-1]] = len(used) + np.arange(len(texts))
        sizes = np.array([len(e) // 4 for e in entries], dtype=np.int64)
        sizes_at = np.where(place >= 0, sizes[place], 0)
        before = np.concatenate([[0], np.cumsum(sizes_at)])
        flat = np.frombuffer(b"".join(entries), dtype=np.int32)
        shift = (np.cumsum(sizes) - sizes)[place] - before[:-1]
        return flat[np.arange(before[-1]) + np.repeat(shift, sizes_at)], before[starts]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids."""
        out = [b""] * (len(starts) - 1)
        sizes = np.diff(starts)
        at = 0
        while at < len(out):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + DECODE, side="right")) - 1)
            flat = ids[starts[at]:starts[end]]
            self.con.register("tokens", pa.table({"doc": np.repeat(np.arange(at, end), sizes[at:end]), "pos": np.arange(len(flat)), "tok": flat}))
            for doc, letters in self.con.execute(DECODED).fetchall():
                out[doc] = letters.encode("latin-1")
            at = end
        return out


def written(ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """Ids of each run in decimal, joined by commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids).cast(pa.string())), ",").to_pylist()


def _pieces(text: str) -> list[str]:
    """The text cut before each blank that a character other than white space follows."""
    if not text:
        return []
    parts = text.split(" ")
    out = [parts[0]] if parts[0] else []
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(" " + part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return out


@functools.lru_cache(maxsize=2)
def tokenizer_of(tokens: tuple[bytes, ...], pattern: str) -> Tokenizer:
    """The tokenizer of this Python worker; its tables and learnt words outlive a task. At most two are kept."""
    return Tokenizer(tokens, pattern)


_release: threading.Timer | None = None


@contextlib.contextmanager
def tokenizer_for_task(tokens: tuple[bytes, ...], pattern: str) -> Iterator[Tokenizer]:
    """The worker's tokenizer for one task. A worker without a further task for ``IDLE`` seconds forgets it.

    A task that starts while it is forgotten holds it by itself, so nothing is taken from under it.
    """
    global _release
    if _release is not None:
        _release.cancel()
    try:
        yield tokenizer_of(tokens, pattern)
    finally:
        _release = threading.Timer(IDLE, _forget)
        _release.daemon = True
        _release.start()


def _forget() -> None:
    tokenizer_of.cache_clear()
    pa.default_memory_pool().release_unused()


def _batches(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    at, total, out = 0, 0, []
    for i, t in enumerate(texts):
        out.append(t.as_py() or "")
        total += len(out[-1])
        if total >= size:
            yield at, out
            at, total, out = i + 1, 0, []
    if out:
        yield at, out


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents plus ``ids`` (array of int); a null text counts as empty and has none.

    Every row is encoded by itself, so ties, repeated rows and null ids need no rule; an empty table gives an empty one; a
    column ``ids`` is replaced. A word of n bytes takes up to n steps over its rows, in rounds of bounded memory.
    """
    tokens = tuple(load_ranks(path))
    kept = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer_for_task(tokens, pattern) as tokenizer:
            for batch in batches:
                for at, texts in _batches(batch.column("text")):
                    ids, starts = tokenizer.encode(texts)
                    part = batch.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], names=[*part.schema.names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows plus ``decoded`` (binary), the bytes of ``ids``; null ids give no bytes."""
    tokens = tuple(load_ranks(path))
    kept = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer_for_task(tokens, ".") as tokenizer:
            for batch in batches:
                ids = batch.column("ids")
                starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
                decoded = tokenizer.decode(ids.flatten().to_numpy().astype(np.int32), starts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())],
                                                 names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, decoded binary")


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; encodes and decodes in one pass, so ids never leave a task."""
    tokens = tuple(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer_for_task(tokens, pattern) as tokenizer:
            for batch in batches:
                for at, texts in _batches(batch.column("text")):
                    ids, starts = tokenizer.encode(texts)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(at, len(texts)), pa.array(np.diff(starts), pa.int64()),
                        pa.array([hashlib.sha256(text.encode()).hexdigest() for text in written(ids, starts)]),
                        pa.array([hashlib.sha256(b).hexdigest() for b in tokenizer.decode(ids, starts)]),
                    ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
