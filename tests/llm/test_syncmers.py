"""Document fingerprints against a scalar version of the definition."""

import hashlib

import pytest

from newslake.llm import syncmers

_MASK = (1 << 64) - 1


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _gram(codes):
    out = 0
    for c in codes:
        out = (out * 0x9E3779B97F4A7C15 + _mix((c + 0x9E3779B97F4A7C15) & _MASK)) & _MASK
    return out


def brute_anchors(text):
    if not text:
        return []
    frame = [syncmers.FRAME] * (syncmers.K - 1)
    codes = frame + [ord(c) for c in text] + frame
    found = []
    for i in range(len(codes) - syncmers.K + 1):
        kmer = codes[i:i + syncmers.K]
        inner = [kmer[j:j + syncmers.S] for j in range(syncmers.K - syncmers.S + 1)]
        inner = [_MASK if set(s) == {syncmers.FRAME} else _mix(_gram(s)) for s in inner]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, _mix(_gram(kmer)) >> 32))
    return found


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    def numbered(anchors):
        seen, out = {}, {}
        for k, (_, h) in enumerate(anchors):
            seen[h] = seen.get(h, 0) + 1
            out[h, seen[h]] = k
        return out
    left, right = numbered(a), numbered(b)
    pairs = sorted((left[k], right[k]) for k in left.keys() & right.keys())
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return 2.0 * max(best, default=0) / (len(a) + len(b))


TEXTS = ["", "a", "ab" * 40, "x" * 300, "Il était une fois, dans la ville de Lyon, un marché où l'on vendait 日本 de tout. " * 3,
         "line one that repeats\n" * 9 + "and the end", "\U0001F600 smile " * 20]


@pytest.mark.parametrize("piece", [syncmers.PIECE, 64])
def test_anchors_against_definition(monkeypatch, piece):
    monkeypatch.setattr(syncmers, "PIECE", piece)
    for text, (places, hashes) in zip(TEXTS, syncmers.anchors(TEXTS)):
        assert list(zip(places.tolist(), hashes.tolist())) == brute_anchors(text)
        assert bool(len(places)) == bool(text)
        back = syncmers.read(syncmers.written(places, hashes))
        assert (back[0] == places).all() and (back[1] == hashes).all()


def test_gaps_stay_below_the_window():
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(5000))
    places, _ = syncmers.anchors([text])[0]
    assert max(b - a for a, b in zip(places, places[1:])) <= syncmers.K - syncmers.S


def test_anchors_do_not_depend_on_surroundings():
    passage = " ".join(f"passage{i * 37 % 101}" for i in range(60))
    inner = [syncmers.anchors([f"{head}{passage}{tail}"])[0][1].tolist() for head, tail in (("", ""), ("before ", " after"), ("x" * 99, "y" * 5))]
    own = syncmers.anchors([passage])[0]
    whole = own[1][(own[0] >= syncmers.K - 1) & (own[0] < len(passage))].tolist()
    assert len(whole) > 10
    assert all(any(hashes[i:i + len(whole)] == whole for i in range(len(hashes))) for hashes in inner)


def test_likeness_against_definition():
    marks = syncmers.anchors(TEXTS)
    plain = [brute_anchors(t) for t in TEXTS]
    for one, a in zip(marks, plain):
        for other, b in zip(marks, plain):
            assert syncmers.likeness(one, other) == pytest.approx(brute_likeness(a, b))
    assert syncmers.likeness(marks[2], marks[2]) == 1.0


def brute_report(rows):
    ordered = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    out = []
    for (has, d, text), (_, _, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        marks = syncmers.anchors([text, changed, following])
        out.append((d if has else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), syncmers.written(*marks[0]),
                    syncmers.written(*marks[1]), syncmers.likeness(marks[0], marks[1]), syncmers.likeness(marks[0], marks[2])))
    return out


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def test_odd_rows(odd, odd_rows):
    got = sorted((tuple(r) for r in syncmers.report(odd).collect()), key=_key)
    assert got == sorted(brute_report([(r[0], r[1]) for r in odd_rows]), key=_key)


def test_small_pieces_and_blocks(spark, odd, odd_rows):
    """Rows cross batches, pieces and blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted((tuple(r) for r in syncmers.report(odd).collect()), key=_key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute_report([(r[0], r[1]) for r in odd_rows]), key=_key)


def test_one_and_none(spark, checkpoints, none):
    assert syncmers.report(none).collect() == []
    alone = syncmers.report(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_registered_query(spark, checkpoints):
    from newslake.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_document_fingerprints(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=_key) == sorted(brute_report([tuple(r) for r in docs]), key=_key)
