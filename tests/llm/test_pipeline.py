"""Every stage of the pipeline against a plain version of what it decides, on its own input."""

import random

import corpus_pipeline
from test_neardup import brute_force
from test_pieces import best_path

BAD = ["vile", "scum", "moron"]


def test_stages_match_plain_versions(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = {i: say(40) for i in range(120)} | {200 + i: f"{say(15)} {rng.choice(BAD)} {say(5)} {rng.choice(BAD)} {say(9)}" for i in range(60)}
    passage, item = say(30), " ".join(rng.choice(vocab) for _ in range(25))
    texts |= {300 + i: f"{say(20)}\n{passage}\n{say(25)}" for i in range(4)}
    base = say(200).split()
    texts |= {400 + i: " ".join(base[:k] + [rng.choice(vocab)] + base[k + 1 :]) for i, k in enumerate((20, 90, 150))} | {403: " ".join(base)}
    texts |= {500: f"{say(10)} {item} {say(10)}", 501: item, 502: None, 503: "", 504: texts[5]}
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i in [*range(100), *range(200, 260)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    want = {i: t for i, t in texts.items() if not set((t or "").split()) & set(BAD)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        assert out.columns == docs.columns, name
        if name == "line_dedup":
            want = {i: "\n".join(x for x in t.split("\n") if x != passage) if 300 < i < 304 else "" if i == 504 else t for i, t in want.items() if t is not None} | {502: None}
            want.pop(504)  # a copy of document 5: nothing is left of it
        elif name == "near_dedup":
            groups = brute_force(list(want.items()))
            want = {i: t for i, t in want.items() if groups.get(i, i) == i}
        elif name == "decontamination":
            want = {i: t for i, t in want.items() if item not in (t or "")}
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == want, (name, set(got) ^ set(want))
        docs = out
    last = {r.doc_id: list(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert last == {i: best_path(t or "") for i, t in want.items()} and len(last) > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(last)
