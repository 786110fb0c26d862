"""Hosts, paths and rules against a plain version; verdicts of the models on plain cases."""

from siftpage.llm import urls
from siftpage.llm.registry import URL_RULES

CASES = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q=/en/", "http://example.com/en/8", "http://notexample.com/en/7", "http://sub.example.net/de/81#x", "http://other.net/de/8", "ftp://x.org/es/", "http://x.org?/es/", "a://b.com://c/en/", "http://com/en/", "http://ÉX.com/en/é"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host = rest[: ends[0]] if ends else rest
    tail = rest[len(host) :]
    path = tail[: min((i for i, c in enumerate(tail) if c in "?#"), default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(CASES * 2)], "page_id long, url string, gram string, score double")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, URL_RULES).collect()}
    assert len(got) == 2 * len(CASES)
    for i, u in enumerate(CASES * 2):
        host, path, rule, verdict = plain(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_models_follow_the_rules_examples(spark):
    rows = [f"http://good.net/de/{w}" for w in ("hilfe", "preise", "kontakt")] * 5 + [f"http://bad.org/es/{w}" for w in ("zzqx", "qxzz", "xqzq")] * 5 + ["http://good.net/hilfe", "http://bad.org/qxzq"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, URL_RULES).collect()}
    assert (got[30], got[31]) == ("allow", "block")


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
