import random
import re

import numpy as np

from siftpage.llm import quality
from siftpage.llm.quality import class_counts, judge, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    held = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 3000 else set()
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(held) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(held), failed)


def test_base_measures_match_brute_force(make_docs, texts):
    odd = ["a b c a b c", "x y z\n\nx y z\n \n x y z", "# *|<a> &%$", "é ß\x1cz a\x85b", "w " * 200, "one two three four one two three", "same\nsame\r\nsame\n\t\n\t\n"]
    rows = [(i, t) for i, t in texts if len(t or "") < 20000] + [(300 + i, t) for i, t in enumerate(odd)] + [(None, None)]
    got = sorted((tuple(r)[:7] for r in judge(make_docs(rows)).collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert judge(make_docs([])).count() == 0


def test_repeated_words_of_many_kinds():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 30, 200):
        words = [rng.choice("abcd") for _ in range(n)]
        assert repeated_words(words) == base(" ".join(words))[4]


def test_classes_leave_words_with_digits_out():
    assert class_counts("Ab c1d é,日 #x\n12") == [3, 1, 1, 1, 1]
    assert class_counts("") == [0] * quality.CLASSES


def jsd(p, q):
    m = (p + q) / 2
    half = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0) / 2
    return max(0.0, half(p) + half(q))


def corpus(rng):
    common = ["the", "of", "and", "to", "in", "is", "that", "it"]
    rare = ["".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice(rare) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(rng.randint(60, 600)), "en") for i in range(120)]
    junk = [(200 + i, " ".join(rng.choice(rare) + rng.choice(["***", "%%%", "&&&"]) for _ in range(150)), "en") for i in range(8)]
    junk += [(210 + i, " ".join(w.upper() + "!!" for w in prose(150).split()), "en") for i in range(8)]
    junk += [(220 + i, " | ".join(rng.choice(rare) for _ in range(80)), "en") for i in range(8)]
    junk += [(230 + i, " ".join(rng.choice(rare) for _ in range(600)), "en") for i in range(4)]  # ordinary letters, no common word
    key = [(240, prose(70) + ' token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587" +1 (528) 555-3435', "en")]
    return rows + key, junk


def test_verdict_and_distances(spark):
    clean, junk = corpus(random.Random(9))
    foreign = [(300, "ein ganz anderer Text " * 1 + " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), "xx")]  # no references: nothing against it
    rows = clean + junk + foreign
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, class_jsd double")
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert all(got[i].kept for i, _, _ in clean) and not any(got[i].kept for i, _, _ in junk) and got[300].kept
    # distances against the definition
    words = quality.common_words(docs.selectExpr("doc_id", "lang", "text as body"))
    assert list(words) == ["en"] and set(words["en"]) >= {"the", "of", "and", "to", "in", "is", "that", "it"}
    own = words["en"]
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    hist = lambda t: np.array([letters(t).count(w) for w in own] + [sum(w not in own for w in letters(t))], dtype=float)
    ref = [(i, t) for i, t, lang in rows if lang == "en" and not base(t)[5] and sum(class_counts(t)) >= quality.LEAST_LETTERS]
    steps = quality.STEPS
    share = np.array([np.array(class_counts(t)) / sum(class_counts(t)) for _, t in ref])
    rounded = np.floor(share * steps + 0.5)
    cls = np.array([np.floor(x + 0.5) for x in np.percentile(rounded, 50, axis=0)])
    cls = cls / cls.sum()
    wrd = sum(np.floor(hist(t) / hist(t).sum() * steps * steps + 0.5) for _, t in ref)
    wrd = wrd / wrd.sum()
    for i, t, lang in rows:
        r = got[i]
        if lang == "en" and not r.base_failed:
            c = np.array(class_counts(t), dtype=float)
            assert abs(r.class_distance - np.sqrt(jsd(c / c.sum(), cls))) < 1e-6
            if r.n_words >= quality.WORDS_COMPARED:
                assert abs(r.word_distance - np.sqrt(jsd(hist(t) / hist(t).sum(), wrd))) < 1e-6
    assert got[300].class_distance is None and got[300].word_distance is None
