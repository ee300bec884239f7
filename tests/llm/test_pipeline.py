import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import brute
import corpus_pipeline
from newslake.llm import bpe, neardup, quality

PATH = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "tokenize"]


@pytest.fixture(scope="module")
def outputs(spark, checkpoints, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], PATH).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_against_brute_force(outputs):
    docs, good, apart, stripped, mixed, tokens = outputs
    assert all(o.columns == docs.columns for o in outputs[:-1])
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert {r.doc_id: r.text for r in good.collect()} == {d: r.q_clean_text for d, r in judged.items() if r.q_kept}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(d for d, _, _, kept in brute.near(rows, neardup.STAGE_PERCENT) if kept)
    rows = [(r.doc_id, r.text) for r in apart.collect()]
    want = {d: n - gone for d, n, gone, _, _ in brute.repeated_bytes(rows)}
    for r in stripped.collect():
        assert len((r.text or "").replace("�", "").encode()) <= want[r.doc_id]
    sizes = Counter()
    for r in stripped.collect():
        sizes[r.source] += len(brute.SPACE_WORD.findall(r.text or ""))
    shares, words = brute.shares(dict(sizes)), Counter()
    for r in mixed.collect():
        words[r.source] += len(brute.SPACE_WORD.findall(r.text))
    assert all(abs(words[s] - shares[s]) <= 1 for s in sizes)
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((r.doc_id, len(encoding.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in tokens.collect()) == expected


def test_run_gives_the_last_stage(spark, outputs):
    assert sorted(map(tuple, corpus_pipeline.run(spark, PATH).collect())) == sorted(map(tuple, outputs[-1].collect()))
