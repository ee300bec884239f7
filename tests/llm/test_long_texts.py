from newslake.llm import quality


def test_windows_that_share_only_upper_hash_bits_are_no_repeats(spark, checkpoints):
    """Hashes of the two windows agree in the upper 46 bits, which were all that a text of this length compared."""
    filler = [f"u{i}" for i in range(140_000)]
    text = " ".join([*filler[:70_000], "a88805 b c", *filler[70_000:], "a21782325 b c"])
    df = spark.createDataFrame([(1, text), (2, text + " u5 u6 u7")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.report(df).collect()} == {1: 0, 2: 6}
