"""Links as the standard library joins them."""

from itertools import product
from urllib.parse import urljoin

from pyspark.sql import functions as F

from siftpage.operators import links as L

BASES = ["https://x.com/p/q", "https://x.com/p/q/", "https://x.com", "https://x.com/", "http://h.net:80/a//b/c.html?q=/x/y#f", "https://x.com/a/./b/../c"]
HREFS = ["/a//b", "/a//b/", "//y.com//z", "e//f", "e//", "../e", "../../../e", ".", "./", "..", "../", "/.", "/..", "/../g", "/a/./b", "/a/../b", "/a//../b", "g?y=/../x", "g#s/../x", "?y", "#s", "g;x=1/../y", "/", "a.b/..c/.d", "/x/..y", "HTTP://Q.org/a//b", "mailto:a@b.c"]


def test_joined_as_urljoin(spark):
    rows = list(product(BASES, HREFS))
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", L.joined(F.col("base"), F.col("href")).alias("out")).collect()
    odd = [(r.base, r.href, r.out, urljoin(r.base, r.href)) for r in got if r.out.lower() != urljoin(r.base, r.href).lower()]
    assert not odd


def test_absolute_paths_keep_empty_segments(spark):
    """The answers as they are written down in the standard."""
    cases = [("https://x.com/p/q", "/a//b", "https://x.com/a//b"), ("https://x.com/p/q", "a//b", "https://x.com/p/a/b"), ("https://x.com/p//q", "a", "https://x.com/p/a")]
    df = spark.createDataFrame(cases, "base string, href string, want string").select("want", L.joined(F.col("base"), F.col("href")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
