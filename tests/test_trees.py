"""Trees and threads against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftpage.functions.fragments import fragment_markdown
from siftpage.operators import threads as T
from siftpage.operators import trees
from siftpage.plans.discussions import _SPARK_WORDS, _nested
from siftpage.plans.structuring import ext16_tables


def brute(edges, most, deepest):
    """edges: id -> (parent, pos, level) of one tree."""
    kids: dict = {}
    for i, (p, pos, _) in edges.items():
        kids.setdefault(p if p in edges and p != i else None, []).append((pos, i))
    out, todo = [], [(i, 1, i) for _, i in sorted(kids.get(None, []), reverse=True)]
    while todo:
        i, depth, top = todo.pop()
        if depth <= deepest and len(out) < most:
            out.append((i, depth, len(out) + 1, top))
        todo += [(k, depth + edges[i][2], top) for _, k in sorted(kids.get(i, []), reverse=True)]
    return sorted(out)


@pytest.mark.parametrize(("most", "deepest"), [(10_000, 10_000), (30, 7)])
def test_order_matches_recursion(spark, most, deepest):
    rng = random.Random(4)
    forest = {0: {i: (i - 1 if i else None, i, 1) for i in range(230)}}  # a chain
    forest[1] = {i: (rng.randrange(80), rng.randrange(5), rng.randrange(2)) for i in range(80)}  # any order, rings and self-answers too
    forest[2] = {i: (rng.randrange(i) if i and rng.random() < 0.9 else 777, -i, 1) for i in range(60)}  # absent parents, places reversed
    forest[3] = {5: (None, 1, 1)}
    rows = [(t, i, p, pos, level) for t, e in forest.items() for i, (p, pos, level) in e.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tree long, id long, parent long, pos long, level int")
    got = trees.shown(trees.ordered(trees.rooted(df)), most, deepest)
    want = sorted((t, *r) for t, e in forest.items() for r in brute(e, most, deepest))
    assert sorted(map(tuple, got.collect())) == want
    assert trees.ordered(trees.rooted(df.limit(0))).count() == 0


def test_plan_does_not_grow_with_depth(spark):
    def plan(n):
        df = spark.createDataFrame([(0, i, i - 1 if i else None, i, 1) for i in range(n)], "tree long, id long, parent long, pos long, level int")
        return len(trees.ordered(df)._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan(3) == plan(200)


def kid(text, author="a", children=()):
    return {"text": text, "author": author, "children": list(children)}


def test_nested_answers(spark):
    deep = kid("bottom")
    for i in range(30):
        deep = kid(f"level {30 - i}", children=[deep])
    gone = kid("under removed")
    for _ in range(600):  # removed ones alone add no level, yet spend the budget
        gone = kid(None, children=[gone])
    rows = [
        (0, json.dumps({"title": " A &amp; B ", "author": "op", "url": None, "text": "<p>x</p>", "children": [kid("one<br>two", children=[kid("<p> </p>", children=[kid("three", None)])]), 7, kid("four")]})),
        (1, json.dumps({"title": "", "children": [deep]})), (2, json.dumps({"title": "t", "children": [gone, kid("after")]})), (3, json.dumps({"title": "flat", "children": [kid(f"c{i}") for i in range(450)]})),
        (4, "no json"), (5, "[1]"), (6, None), (7, json.dumps({"title": "none", "children": "odd"})),
    ]
    got = {r.tree: r for r in T.threads(spark.createDataFrame(rows, "tree long, payload string")).collect()}
    assert got[0].markdown == "# A &amp; B\n\nby op\n\nx\n\n---\n\n## Comments\n\n> one\n> two\n>\n> — a\n>> three\n>>\n>> — [deleted]\n\n> four\n>\n> — a\n"
    assert (got[0].shown, got[0].removed, got[0].truncated) == (3, 1, False)
    assert (got[1].shown, got[1].truncated) == (20, True) and "level 20" in got[1].markdown and "level 21" not in got[1].markdown
    assert (got[2].shown, got[2].removed, got[2].truncated) == (0, 400, True) and "_Thread truncated" in got[2].markdown
    assert (got[3].shown, got[3].truncated) == (400, True)
    assert all(got[i].markdown is None and got[i].truncated is None for i in (4, 5, 6))
    assert (got[7].shown, got[7].truncated) == (0, False)


def test_answers_that_cannot_be_read_say_so(spark):
    n = 60_000
    chain = '{"id":' + "7" * 5000 + ',"title":"deep","children":[' + '{"text":"x","children":[' * n + "]}" * n + "]}"
    flat = json.dumps({"title": "t", "children": [kid("one")]})
    rows = [(0, chain), (1, "no json"), (2, chain[:-1]), (3, "[1]"), (4, None), (5, ""), (None, flat), (6, flat)]
    got = {r.tree: r for r in T.threads(spark.createDataFrame(rows, "tree long, payload string")).collect()}
    assert (got[0].title, got[0].shown, got[0].truncated, got[0].failure) == ("deep", 20, True, None)
    assert got[1].failure == "no JSON: Expecting value: line 1 column 1 (char 0)" and got[2].failure.startswith("no JSON: Expecting ,") and got[5].failure.startswith("no JSON: ")
    assert (got[3].failure, got[4].failure) == ("no object", "no answer")
    assert all(got[i].markdown is None and got[i].shown is None for i in range(1, 6))
    assert got[None].shown == 1 and got[None].markdown == got[6].markdown == "# t\n\n---\n\n## Comments\n\n> one\n>\n> — a\n"


def test_deep_json_is_read_as_json_is():
    rng = random.Random(6)

    def outcome(read, text):
        try:
            return repr(read(text))
        except ValueError:
            return "no JSON"

    def some(depth):
        kind = rng.randrange(9 if depth else 7)
        return [None, True, -1.5, 12.0, "", 'a"\\\u00e9\n', "x", *([] if kind < 7 else [[some(depth - 1) for _ in range(rng.randrange(4))], {rng.choice("abc"): some(depth - 1) for _ in range(rng.randrange(4))}])][kind]

    bad = 0
    for _ in range(3000):
        text = json.dumps(some(4), indent=rng.choice([None, 1]))
        if rng.random() < 0.6:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", ",", "]", "}", "{", "[", ":", '"', " ", "1", '"a":']) + text[i + rng.randrange(2) :]
        assert outcome(T.unnested, text) == outcome(lambda t: json.loads(t, parse_int=float), text), text
        bad += outcome(T.unnested, text) == "no JSON"
    assert 300 < bad < 2700


def test_topics(spark):
    post = lambda n, to=None, user="u", text="<p>t</p>": {"post_number": n, "reply_to_post_number": to, "username": user, "cooked": text}
    rows = [
        (0, json.dumps({"title": "T", "post_stream": {"posts": [post(4, 3), post(1, None, "op", "<b>hi</b>"), post(3, 2, None), post(2, 1, text=""), post(5, 5), post(6, 99), post(7, 8), post(8, 7)]}})),
        (1, json.dumps({"title": "T", "post_stream": {"posts": []}})), (2, json.dumps({"title": "T"})), (3, "x"), (4, json.dumps({"fancy_title": "F &amp; G", "title": "T", "post_stream": {"posts": [post(3)]}})),
    ]
    got = {r.tree: r for r in T.topics(spark.createDataFrame(rows, "tree long, payload string")).collect()}
    assert sorted(got) == [0, 4]
    assert got[0].markdown == "# T\n\nby op\n\n**hi**\n\n---\n\n## Discussion\n\n> _[post removed]_ — u\n>> t\n>>\n>> — [unknown]\n>>> t\n>>>\n>>> — u\n\n> t\n>\n> — u\n\n> t\n>\n> — u\n"
    assert (got[0].posts, got[0].shown) == (8, 5)  # 7 and 8 answer each other and hang nowhere
    assert (got[4].title, got[4].shown, got[4].markdown) == ("F & G", 0, "# F & G\n\nby u\n\nt\n\n---\n\n## Discussion\n")


def test_fragments(spark):
    cases = [
        ("<p>a</p><p>b <a class=x href='https://e.com/?a=1&amp;b=2'>c</a></p>", "a\n\nb [c](https://e.com/?a=1&b=2)"), ("x<br/>y", "x\ny"), ("<ul><li>1</li><li>2</li></ul>", "- 1\n- 2"), ("<pre><code>if a &lt; b:\n  c</code></pre>", "```\nif a < b:\n  c\n```"),
        ("<h2>T</h2><blockquote><p>q</p></blockquote>z", "## T\n\n> q\n\nz"), ("<em>i</em> <strong>b</strong> <code>c</code><script>no()</script>", "*i* **b** `c`"), ("", ""), (" <p> </p> ", ""), (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", fragment_markdown(F.col("h")).alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == [m for _, m in cases]


def test_paths_take_a_byte_a_node(spark):
    rows = [(0, i, i - 1 if i else None, i, 1) for i in range(200)] + [(1, i, 0 if i else None, -i, 1) for i in range(70000)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, pos long, level int")
    found = trees.ordered(df)
    way = F.length("path.way")
    assert found.groupBy("tree").agg(F.sum(way), F.max(way)).orderBy("tree").collect() == [(0, 199 * 100, 199), (1, 224 + 32 * 2 + (65536 - 256) * 3 + (69999 - 65536) * 4, 4)]
    got = trees.shown(found, 10**9, 10**9).where("tree = 1").select("id", "place").collect()
    assert sorted(got, key=lambda r: r.place) == [(0, 1)] + [(i, 70001 - i) for i in range(69999, 0, -1)]  # siblings of any number in order


def test_lost_nodes_are_adopted(spark):
    rows = [(0, 1, None, 1, 1), (0, 2, 99, 2, 1), (0, 3, 3, 3, 1), (0, 4, 2, 4, 1), (0, 5, 6, 5, 1), (0, 6, 5, 6, 1)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, pos long, level int")
    every = lambda found: sorted((r.id, r.depth, r.place, r.top) for r in trees.shown(found, 9, 9).collect())
    assert every(trees.ordered(df, adopt=True)) == every(trees.ordered(trees.rooted(df))) == [(1, 1, 1, 1), (2, 1, 2, 2), (3, 1, 4, 3), (4, 2, 3, 2)]
    assert every(trees.ordered(df)) == [(1, 1, 1, 1)]


def test_words_of_threads_are_counted_a_row(spark):
    rows = [(0, 1, "user", "one two 3 three"), (0, 1, "user", "one two 3 three"), (0, 0, "user", "first"), (1, 0, None, None), (1, 1, "user", ""), (3, 0, "user", "last"), (4, 0, "user", "other tree"), (4, 0, "tool", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").createOrReplaceTempView("conversations")
    words = spark.sql(_SPARK_WORDS)
    assert sorted((r.tree, r.r, r.word) for r in words.collect()) == [(0, i, w) for i, w in enumerate("first one one two two three three last".split())] + [(1, 0, "other"), (1, 1, "tree")]
    sorts = [line for line in words._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert len(sorts) == 1 and "row_number" not in sorts[0]  # the window is over rows, not over words


def test_answers_are_put_together_in_one_pass(spark):
    answers = _nested(spark, "/root/testdata/sf0.001")
    assert "aggregate(" not in answers._jdf.queryExecution().optimizedPlan().toString()  # a fold copies the whole text a word
    assert all(json.loads(r.payload)["children"] for r in answers.collect())
    assert sum("Comments(" in line for line in T.threads(answers)._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 0  # parsed once, before


def test_a_table_is_made_once(spark):
    plan = ext16_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("partial view") == 1
