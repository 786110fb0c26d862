"""Captured exchanges, corpora, gold texts and feeds, from written-out files."""

import json

import pytest

from siftpage.sources import captured as C


def exchange(url, status="200", body="hello", extra="", headers="Server: x\nVia: a: b\nServer: y"):
    return f"{C.REQUEST}{url}\nstatus: {status}\nverdict: ok\ncontent-type: text/html\nfinal-url: {url}/end\n{extra}{C.HEADERS}\n{headers}\n{C.BODY}\n{body}"


def test_exchanges(spark, tmp_path):
    (tmp_path / "a.http").write_text(C.SEPARATOR.join([exchange("https://x/1", body="line\n\nline: 2\n"), exchange("https://x/2", "404", "aGk=", "body-encoding: base64\n"), exchange("https://x/1", body="", headers="")]))
    (tmp_path / "b.http").write_text("  \n")
    got = sorted((r.pos, r.url, r.status, r.final_url, dict(r.headers), bytes(r.body)) for r in C.exchanges(spark, str(tmp_path)).collect())
    assert got == [(0, "https://x/1", 200, "https://x/1/end", {"Server": "y", "Via": "a: b"}, b"line\n\nline: 2\n"), (1, "https://x/2", 404, "https://x/2/end", {"Server": "y", "Via": "a: b"}, b"hi"), (2, "https://x/1", 200, "https://x/1/end", {}, b"")]
    assert sorted((r.url, bytes(r.body)) for r in C.latest_exchanges(C.exchanges(spark, str(tmp_path))).collect()) == [("https://x/1", b""), ("https://x/2", b"hi")]


@pytest.mark.parametrize("text", ["no request", f"{C.REQUEST}https://x\nstatus: 200\n", exchange("https://x", "304", "", "conditional-hit: true\n")])
def test_bad_exchanges_raise(spark, tmp_path, text):
    (tmp_path / "a.http").write_text(text)
    with pytest.raises(Exception, match="malformed exchange|304 without a body"):
        C.exchanges(spark, str(tmp_path)).collect()


def test_corpora(spark, tmp_path):
    good = {"slug": "s", "url": "u", "task": "t", "criteria": ["c", "d"], "class": "listing", "other": 1}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"urls": [good, {**good, "slug": "z", "class": None}]}, indent=1))
    assert [(r.slug, r.criteria, r["class"], r.needs) for r in C.corpus(spark, str(path)).orderBy("pos").collect()] == [("s", ["c", "d"], "listing", []), ("z", ["c", "d"], "", [])]
    for bad in ({**good, "criteria": []}, {k: v for k, v in good.items() if k != "task"}):
        path.write_text(json.dumps({"urls": [good, bad]}))
        with pytest.raises(Exception, match="row 1 has no valid"):
            C.corpus(spark, str(path)).collect()
    path.write_text(json.dumps({"urls": []}))
    with pytest.raises(Exception, match="empty"):
        C.corpus(spark, str(path)).collect()
    path.write_text(json.dumps({"urls": [{"slug": "s", "url": "u", "gold_md": "text"}]}))
    assert C.gold(spark, str(path)).first().gold_md == "text"
    path.write_text(json.dumps({"urls": [{"slug": "s", "url": "u", "gold_md": "  "}]}))
    with pytest.raises(Exception, match="row 0 has no valid gold_md"):
        C.gold(spark, str(path)).collect()


def test_cases_and_feeds(spark, tmp_path):
    for name in ("one/case.json", "one/inputs/raw.http", "two/baseline/contract.json"):
        (tmp_path / "cases" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "cases" / name).write_text(name)
    assert sorted((r.slug, r.name, bytes(r.content).decode()) for r in C.cases(spark, str(tmp_path / "cases")).collect()) == [("one", "case.json", "one/case.json"), ("one", "inputs/raw.http", "one/inputs/raw.http"), ("two", "baseline/contract.json", "two/baseline/contract.json")]
    feed = '<feed><title>T : sub</title><entry><author><name>/u/al</name></author><content type="html">&lt;b&gt;x&lt;/b&gt;</content><id>t3_a</id><link href="https://r/1"/><updated>2024-01-01T00:00:00Z</updated><title>P</title></entry><entry><id>t1_b</id><title>C</title></entry></feed>'
    feeds = spark.createDataFrame([(0, feed), (1, "no feed"), (2, None)], "id int, body string")
    got = [(r.id, r.feed_title, r.pos, r.kind, r.entry_id, r.author, r.link, r.content) for r in C.feed_entries(feeds).orderBy("id", "pos").collect()]
    assert got == [(0, "T : sub", 0, "t3", "t3_a", "al", "https://r/1", "<b>x</b>"), (0, "T : sub", 1, "t1", "t1_b", None, None, None)]


def test_yaml_corpora_and_cases(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    rows = [{"slug": "a", "url": "https://x.com/", "class": "shop", "task": "t: with colon", "criteria": ["one", "two"], "needs": ["js"]}, {"slug": "b", "url": "https://y.com/", "task": "u", "criteria": ["c"], "seen": "x"}]
    (tmp_path / "corpus.yaml").write_text("# a comment\n" + yaml.safe_dump({"urls": rows}))
    got = {r.slug: r for r in C.corpus(spark, str(tmp_path / "corpus.yaml")).collect()}
    assert got["a"].criteria == ["one", "two"] and got["a"]["class"] == "shop" and got["a"].needs == ["js"] and got["b"].task == "u" and got["b"]["class"] == ""
    (tmp_path / "gold.yaml").write_text("urls:\n  - slug: g\n    url: https://z.com/\n    gold_md: |\n      # Head\n\n      two lines\n")
    assert C.gold(spark, str(tmp_path / "gold.yaml")).first().gold_md == "# Head\n\ntwo lines\n"
    (tmp_path / "bad.yaml").write_text("urls:\n  - slug: h\n    url: u\n    gold_md: '  '\n")
    with pytest.raises(Exception, match="bad.yaml: row 0 has no valid gold_md"):
        C.gold(spark, str(tmp_path / "bad.yaml")).collect()
    (tmp_path / "none.yaml").write_text("urls: [\n")
    with pytest.raises(Exception, match="none.yaml has no `urls` list"):
        C.gold(spark, str(tmp_path / "none.yaml")).collect()
    one, two = tmp_path / "cases/one", tmp_path / "cases/two"
    (one / "baseline").mkdir(parents=True)
    two.mkdir(parents=True)
    (one / "case.yaml").write_text("slug: one\nurl: https://x.com/\nquestion: what?\nfailure_class: thin\ntags: [a, b]\n")
    (one / "meta.yaml").write_text("captured_at: 2026-01-02\nsource_url: https://x.com/moved\nlayers: {raw: raw.http}\ncontent_sha256: abc\n")
    (one / "baseline/contract.json").write_text('{"has_content": true, "steps": ["raw"]}')
    (two / "case.yaml").write_text("url: https://y.com/\n")
    got = {r.slug: r for r in C.case_table(spark, str(tmp_path / "cases")).collect()}
    assert (got["one"].tags, got["one"].captured_at, got["one"].moved) == (["a", "b"], "2026-01-02", True)
    assert [tuple(x) for x in got["one"].contract] == [("has_content", "true"), ("steps", '["raw"]')]
    assert (got["two"].url, got["two"].tags, got["two"].contract, got["two"].moved) == ("https://y.com/", [], None, False)
