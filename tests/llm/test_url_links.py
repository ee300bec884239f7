import pytest
from pyspark.sql import functions as F

from newslake.llm import urlfilter

LINK = '<link rel="canonical" href="{}">'


def test_entities_and_dot_segments_of_links(spark, checkpoints):
    rows = [
        (1, "http://a.net/x", LINK.format("https://shop.com/de/1?a=1&amp;b=2")), (2, "https://shop.com/de/1?a=1&b=2", None),
        (3, "http://shop.com/de/a/b", LINK.format("../../m/./n")), (4, "http://shop.com/m/n", None),
        (5, "http://b.net/y", '<meta http-equiv="refresh" content="0; url=http://shop.com/de/7?p=1&#38;q=2">'), (6, "http://shop.com/de/7?p=1&q=2", None),
        (7, "http://c.net/p/q", LINK.format("./r")), (8, "http://c.net/p/r", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    for a, b in ((1, 2), (3, 4), (5, 6), (7, 8)):
        assert got[a].component is not None and got[a].component == got[b].component
    assert {k for k, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("path, want", [
    ("/a/./b", "/a/b"), ("/a/../b", "/b"), ("/../b", "/b"), ("/a/b/..", "/a/"), ("/a/.", "/a/"), ("/..", "/"), ("/a//../b", "/a/b"), ("/a/..b/.c", "/a/..b/.c"),
    ("/a/b/../../..", "/"), ("", ""), ("/", "/"),
])
def test_dot_segments(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(urlfilter.without_dots(F.col("p"))).first()[0] == want
