"""What a Python worker keeps between tasks."""

import time

from newslake.llm import bpe

TOKENS = tuple(bytes([b]) for b in range(256)) + (b"ab",)


def test_an_idle_worker_forgets_its_tokenizer(monkeypatch):
    """A worker keeps tokenizer and learnt words from task to task, and gives them back once no task follows."""
    monkeypatch.setattr(bpe, "IDLE", 0.3)
    with bpe.tokenizer_for_task(TOKENS, ".+") as first:
        assert first.encode(["abab c"])[0].tolist() == [256, 256, 32, 99]
    with bpe.tokenizer_for_task(TOKENS, ".+") as second:
        assert second is first
        time.sleep(0.6)
        assert bpe.tokenizer_of.cache_info().currsize == 1  # no timer of the task before ends it
    deadline = time.time() + 10
    while bpe.tokenizer_of.cache_info().currsize and time.time() < deadline:
        time.sleep(0.05)
    assert bpe.tokenizer_of.cache_info().currsize == 0
