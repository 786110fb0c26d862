import hashlib
import re

from siftpage.llm.fim import digests, restored, transform

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(i, text):
    text = text or ""
    units, hexed = UNIT.findall(text), sha(f"42:{'' if i is None else i}")
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text)
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return (i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


ODD = ["a<P>b", "a < P>b<", "<S", "\u0001\u0002 \u00021 \u00020\u0001x \u0001", " lead and trail \n\n ", "😀 é ß\x1c z", "\t", "<", "x" * 50_000 + " y", "P> <S x <M"]


def test_parts_match_brute_force(make_docs, texts):
    rows = [*texts, *((100 + 20 * k + i, t) for i, t in enumerate(ODD) for k in range(20)), (None, "one two three"), (None, None)]
    docs = make_docs(rows)
    got = sorted(map(tuple, digests(docs).collect()), key=repr)
    want = sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip((brute(*r) for r in rows), rows, strict=True)), key=repr)
    assert got == want
    forms = {w[2] for w in map(lambda r: brute(*r), rows)}
    assert forms == {"plain", "psm", "spm"}


def test_output_is_text_and_restores(make_docs, texts):
    rows = dict(texts)
    out = transform(make_docs([(i, t) for i, t in rows.items()]), rate=100)
    got = out.withColumn("back", restored(out["output"], out["form"])).collect()
    assert all(r.back == (rows[r.doc_id] or "") for r in got)
    assert all(r.form == "plain" or (r.prefix + r.middle + r.suffix) == rows[r.doc_id] for r in got)
    assert transform(make_docs([])).count() == 0


def test_no_shuffle(make_docs, texts):
    plan = digests(make_docs(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
