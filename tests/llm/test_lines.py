import difflib
import random

from pyspark.sql import functions as F

from siftpage.llm.lines import drop_lines, line_matches, patience


def test_patience_aligns_equal_items_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in "ab")
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
            assert len(got) == lcs[-1][-1]
    assert patience(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)] and difflib


def line(c):
    return f"{c} is a line of quite enough characters {c}"


def test_common_blocks_leave_the_later_document(make_docs):
    block = "\n".join([line("p"), "short", line("q")])
    rows = [(1, f"{line('a')}\n{block}\n{line('b')}"), (2, f"{line('c')}\n{block}"), (3, line("d")), (4, None), (5, ""), (6, f"{block}\n{line('e')}"), (7, "short"), (8, "short")]
    got = {r.doc_id: (r.n_lines, r.removed, r.partners) for r in line_matches(make_docs(rows)).collect()}
    assert got == {1: (5, [], []), 2: (4, [1, 2, 3], [1]), 3: (1, [], []), 4: (1, [], []), 5: (1, [], []), 6: (4, [0, 1, 2], [1]), 7: (1, [], []), 8: (1, [], [])}
    docs = make_docs(rows)
    out = drop_lines(docs)
    text = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and text[2] == line("c") and text[6] == line("e") and text[4] is None and text[1] == rows[0][1]


def test_a_frequent_line_leaves_all_but_its_first_holder(make_docs):
    for n in (16, 17, 40, 120):
        rows = [(i, f"{line(i)}\n{line('menu')}\n{line(-i)}") for i in range(n)]
        assert {r.doc_id: r.removed for r in line_matches(make_docs(rows)).collect()} == {0: []} | {i: [1] for i in range(1, n)}


def brute(rows):
    """Every document aligned with the earliest holder of each of its lines and of each two lines that follow one another."""
    docs = {i: t.split("\n") for i, t in rows}
    long = {i: [x.strip(" ") for x in ls if len(x.strip(" ")) >= 20] for i, ls in docs.items()}
    holds = {}
    for i in sorted(docs):
        for x in [*long[i], *zip(long[i], long[i][1:])]:
            holds.setdefault(x, i)
    out = {}
    for i, ls in docs.items():
        gone, with_ = set(), set()
        for j in {holds[x] for x in [*long[i], *zip(long[i], long[i][1:])]} - {i}:
            found, run, own = [k for k, _ in patience([x.strip(" ") for x in ls], [x.strip(" ") for x in docs[j]])], [], set()
            for k in [*found, None]:
                if run and (k is None or k != run[-1] + 1):
                    own |= set(run) if any(len(ls[m].strip(" ")) >= 20 for m in run) else set()
                    run = []
                run += [] if k is None else [k]
            gone |= own
            with_ |= {j} if own else set()
        out[i] = (sorted(gone), sorted(with_))
    return out


def test_matches_brute_force_over_all_documents(make_docs):
    rng = random.Random(12)
    pool = [line(f"{'abcdefghij'[k % 10]}{k}") for k in range(30)] + ["short", "", "  "]
    rows = [(i, "\n".join(rng.choice(pool if rng.random() < 0.6 else pool[:4]) for _ in range(rng.randint(1, 12)))) for i in range(1, 90)]
    got = {r.doc_id: (r.removed, r.partners) for r in line_matches(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_empty_table_and_repeated_rows(make_docs):
    assert line_matches(make_docs([])).count() == 0
    docs = make_docs([(1, line("a")), (1, line("a")), (2, f"{line('x')}\n{line('p')}\n{line('q')}"), (3, f"{line('p')}\n{line('q')}"), (3, f"{line('z')}\n{line('y')}\n{line('p')}\n{line('q')}"), (None, line("a"))])
    got = sorted((r.doc_id, r.n_lines, r.removed, r.partners) for r in line_matches(docs).collect())
    assert got == [(1, 1, [], []), (1, 1, [], []), (2, 3, [], []), (3, 2, [0, 1], [2]), (3, 4, [2, 3], [2])]
    assert sorted(r.text for r in drop_lines(docs).where("doc_id = 3").collect()) == ["", f"{line('z')}\n{line('y')}"]


def test_clashing_names(make_docs):
    docs = make_docs([(1, f"{line('a')}\n{line('b')}"), (2, f"{line('a')}\n{line('b')}")]).withColumns({c: F.lit(7) for c in ("_id", "__id", "_same", "_removed", "ls", "r", "first", "body")})
    out = drop_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: (r.text, r._id, r.ls) for r in out.collect()} == {1: (f"{line('a')}\n{line('b')}", 7, 7), 2: ("", 7, 7)}


def test_a_frequent_passage_or_block_leaves_all_but_its_first_holder(make_docs):
    passage = " ".join(f"word{k}" for k in range(25))
    rows = [(i, f"{line(i)}\n{passage}\n{line(-i)}") for i in range(1, 31)]
    assert {r.doc_id: r.removed for r in line_matches(make_docs(rows)).collect()} == {1: []} | {i: [1] for i in range(2, 31)}
    rows = [(1, f"{line('x')}\n{line(1)}"), (2, f"{line(2)}\n{line('y')}"), *((i, f"{line(i)}\n{line('x')}\n\n{line('y')}\n{line(-i)}") for i in range(3, 31))]
    got = {r.doc_id: (r.removed, r.partners) for r in line_matches(make_docs(rows)).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([1, 3], [1, 2])} | {i: ([1, 2, 3], [1, 2, 3]) for i in range(4, 31)}
