from siftpage.llm.decontam import drop_leaks, leaks

ITEM = "a farmer named Maria sells 12 apples to Peter and then Maria buys 7 kg of pears from him at the market"
OTHER = "we count the small boats that pass under the old bridge before noon on every second day of may"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_verbatim_and_changed_items_are_found(spark, make_docs):
    changed = ITEM.replace("Maria", "Ines").replace("Peter", "Otto").replace("12", "95").replace("7 kg", "8 km")
    broken = changed.replace("then Ines", "then Karl")  # one name of the item stands for two
    rows = [(1, f"some words before. {ITEM} and after"), (2, f"x y z {changed}"), (3, f"x y z {broken}"), (4, OTHER), (5, "a clean text about boats and apples and nothing else at all here"), (6, None), (7, ""), (None, ITEM)]
    got = {(r.doc_id, r.item_id): (r.slots, r.changed) for r in leaks(make_docs(rows), bench(spark, [(10, ITEM, 1), (11, OTHER, 1), (12, None, 1), (13, "", 1)])).collect()}
    assert got == {(1, 10): (5, 0), (2, 10): (5, 5), (4, 11): (0, 0)}


def test_empty_tables_and_columns(spark, make_docs):
    docs = make_docs([(1, ITEM), (2, "clean")])
    assert leaks(docs, bench(spark, [])).count() == 0 and leaks(make_docs([]), bench(spark, [(1, ITEM, 1)])).count() == 0
    out = drop_leaks(docs, bench(spark, [(1, ITEM, 1)]))
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]


def test_a_name_after_a_number_leaves_the_slots_checked(spark, make_docs):
    changed = ITEM.replace("Maria", "Ines").replace("12", "95")
    broken = changed.replace("then Ines", "then Karl")
    rows = [(1, f"it was in 2019 Paris that {changed} and after"), (2, f"it was in 2019 Paris that {broken} and after")]
    got = {(r.doc_id, r.item_id): (r.slots, r.changed) for r in leaks(make_docs(rows), bench(spark, [(10, ITEM, 1)])).collect()}
    assert got == {(1, 10): (5, 3)}


def test_a_slot_of_another_length_leaves_the_item_found(spark, make_docs):
    words = "the old baker near our harbour counts every loaf before dawn and sends them over that narrow bridge to seven quiet villages beyond some hills where nobody ever asked him why he did so".split()
    items = [(n, " ".join(words[:n]), 1) for n in (9, 12, 15, 20, 27, 35)]
    rows = [(100 * n + p, " ".join(["intro", *words[:p], "extra", *words[p:n], "outro"])) for n, _, _ in items for p in range(1, n)]
    item = "a farmer named Maria sells his many green apples to a trader who lives for 12 days in the port and then Maria buys some pears from him at the market"
    changed = item.replace("Maria", "Ines Lund").replace("12 days", "95 long days")
    rows += [(1, f"so then {changed} and after"), (2, f"so then {changed.replace('then Ines Lund', 'then Karl')} and after")]
    got = {(r.doc_id, r.item_id): (r.slots, r.changed) for r in leaks(make_docs(rows), bench(spark, [*items, (50, item, 1)])).collect()}
    assert {(i, i // 100) for i, _ in rows if i > 2} <= set(got) and got[1, 50] == (3, 3) and (2, 50) not in got


def test_rows_of_one_id_are_texts_of_their_own(spark, make_docs):
    words = [f"w{chr(97 + k)}{chr(97 + k // 3)}" for k in range(20)]
    item = spark.createDataFrame([(7, " ".join(words)), (7, "z " + " ".join(words[::-1]))], "item_id long, text string")
    first, second = " ".join(words[:10]), " ".join(words[10:])
    rows = [(1, first), (1, second), (2, first), (3, second), (4, " ".join(words)), (4, "clean text"), (4, " ".join(words)), (5, "other")]
    got = leaks(make_docs(rows), item).collect()
    assert {(r.doc_id, r.item_id, r.matched == r.windows) for r in got} == {(4, 7, True)} and len(got) == 1
    left = sorted((r.doc_id, r.text) for r in drop_leaks(make_docs(rows), item).collect())
    assert left == sorted([(1, first), (1, second), (2, first), (3, second), (4, "clean text"), (5, "other")])


def test_long_runs_of_names_and_numbers(spark, make_docs):
    rows = [(1, "we saw " + "Ab " * 20000 + ITEM), (2, "see 1" + ".1" * 20000 + " then " + ITEM), (3, "we saw " + "Ab " * 20000)]
    got = leaks(make_docs(rows), bench(spark, [(10, ITEM, 1)])).collect()
    assert sorted((r.doc_id, r.item_id, r.matched == r.windows) for r in got) == [(1, 10, True), (2, 10, True)]
