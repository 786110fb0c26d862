import random
import zlib

import numpy as np

from siftpage.llm.toxicity import BlockMaxIndex, score


def test_index_is_exact():
    rng = random.Random(2)
    vectors = [sorted(rng.sample(range(40), rng.randint(0, 6))) for _ in range(500)]
    idf = np.array([1 + rng.random() * 4 for _ in range(40)])
    index = BlockMaxIndex(vectors, idf)
    cos = lambda a, b: sum(idf[t] ** 2 for t in set(a) & set(b)) / np.sqrt((idf[a] ** 2).sum() * (idf[b] ** 2).sum()) if a and b else 0.0
    for _ in range(40):
        q = sorted(rng.sample(range(40), rng.randint(1, 5)))
        every = sorted((-round(cos(q, v), 9), i) for i, v in enumerate(vectors) if cos(q, v) > 0)
        want = [x for x in every if x[0] <= every[min(15, len(every) - 1)][0]]
        got = index.top(q, 16)
        assert sorted((-round(c, 9), i) for i, c in got) == want and len(got) == len(want)


def test_held_out_rows_are_told_apart(spark, make_docs):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)]
    say = lambda bad: " ".join(rng.choice(words) for _ in range(30)) + (" vile scum" if bad else "")
    rows = [(i, say(i % 5 == 0)) for i in range(600)] + [(700, None), (701, ""), (None, "vile scum")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score(make_docs(rows), labels).collect()}
    assert len(got) == 603 and got[None].predicted == 1 and got[700].predicted == got[701].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(i % 5 == 0) for i in range(600))
    assert score(make_docs([]), labels).count() == 0 and score(make_docs([(1, "a")]), labels.limit(0)).first().score == 0


def test_score_is_the_vote_of_all_neighbours(spark, make_docs):
    """Brute force over the same words: idf of all documents, votes weighted by cosine and class size, all ties of the 16th voting."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    bad = ["vile", "scum", "moron"]
    say = lambda toxic: " ".join([rng.choice(words) for _ in range(20)] + ([rng.choice(bad) for _ in range(3)] if toxic or rng.random() < 0.02 else []))
    rows = [(i, say(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score(make_docs(rows), labels).collect()}
    sets = {i: sorted(set(t.split()) & set(bad)) for i, t in rows}
    df = {w: sum(w in t.split() for _, t in rows) for w in bad}
    idf = {w: np.log((1 + 400) / (1 + df[w])) + 1 for w in bad}
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = [i for i in learnt if i % 4 == 0]
    cos = lambda a, b: sum(idf[w] ** 2 for w in set(a) & set(b)) / np.sqrt(sum(idf[w] ** 2 for w in a) * sum(idf[w] ** 2 for w in b)) if a and b else 0.0
    bare = [i for i in learnt if not sets[i]]
    rate = (sum(i % 4 == 0 for i in bare) + len(toxic) / len(learnt)) / (len(bare) + 1)
    for i, _ in rows:
        near = sorted(((round(cos(sets[i], sets[j]), 12), j) for j in learnt if cos(sets[i], sets[j]) > 0), reverse=True)
        near = [x for x in near if x[0] >= near[min(15, len(near) - 1)][0]]
        want = (rate + sum(c for c, j in near if j % 4 == 0)) / (1 + sum(c for c, _ in near))
        assert abs(got[i].score - want) < 1e-9
    held = [i for i in range(400) if i not in learnt]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.9
    assert sum((got[i].score - (i % 4 == 0)) ** 2 for i in held) / len(held) < 0.05
