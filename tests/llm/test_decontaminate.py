import re

from helpers import edge_frame, empty, plain

from giftrisk.llm import decontaminate as D

ITEM = ("A train leaves Boston at 9 and travels 60 km per hour. How many hours will the train need "
        "to reach the town of Albany, which is 180 km away?")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, texts, bench):
    docs = plain(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items(spark, bench)).collect()}


def test_verbatim_recased_and_reparameterised(spark):
    filler = "nothing of interest is said in this long introduction to other matters. "
    changed = ITEM.replace("60", "75").replace("180", "225").replace("Boston", "Denver").replace("Albany", "Pueblo").replace("at 9", "at 8")
    mixed = ITEM.replace("Boston", "Denver")
    twice = "If Anna gives Bob 5 apples then we know that Anna and Bob have 5 apples less than before they met Anna there."
    good = twice.replace("Anna", "Carol").replace("5", "8")
    bad = "If Carol gives Bob 5 apples then we know that Dora and Emil have 7 apples less than before they met Fritz there."
    got = found(spark, [filler + ITEM + " " + filler, filler + ITEM.upper().replace(",", ""), filler + changed, mixed, filler,
                        "x y z " + good, "x y z " + bad], [(1, ITEM), (2, twice)])
    assert {k for k in got} == {(0, 1), (1, 1), (2, 1), (3, 1), (5, 2)}
    assert not got[0, 1].reparameterised and got[2, 1].reparameterised and got[0, 1].coverage == 1.0
    assert got[0, 1].first_token == 12 and got[0, 1].end_token == 12 + got[0, 1].item_tokens


def test_edge_cases(spark):
    bench = items(spark, [(1, None), (2, ""), (3, "one"), (None, "the quick brown fox jumps over the lazy dog"), (4, "boxkämpfer jagen viktor quer über"),
                          (5, "the quick brown fox jumps over the lazy dog"), (5, "the quick brown fox jumps over the lazy dog")])
    got = sorted(((str(r.doc_id), str(r.item_id)) for r in D.contaminated(edge_frame(spark), bench).collect()))
    assert got == [("1", "5"), ("1", "None"), ("2", "5"), ("2", "None"), ("6", "4")]
    kept = D.decontaminate(edge_frame(spark), bench)
    assert kept.columns == edge_frame(spark).columns
    assert kept.count() == edge_frame(spark).count() - 4
    assert D.contaminated(empty(spark), bench).count() == 0
    assert D.contaminated(edge_frame(spark), bench.limit(0)).count() == 0


def test_planted_items_match_a_plain_search(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " ".join(w for w in (re.sub(r"^\W+|\W+$", "", x) for x in t.lower().split()) if w)
    texts = [(r.doc_id, f" {norm(r.text)} ") for r in docs.collect()]
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts if f" {norm(r.text)} " in t}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got == want and want


def test_tokens_have_types():
    assert D.analyse("5km,") == ([("5", D.NUM), ("km", D.UNIT)], False)
    assert D.analyse("(Boston).") == ([("boston", D.CAP)], True)
    assert D.analyse("&&&") == ([], False)
    assert D.analyse("1,250.") == ([("1,250", D.NUM)], True)


def test_items_dense_in_numbers(spark):
    car = "A car in a city drives 60 km in 2 hours"
    units = "Convert 5 km 20 m 30 cm to mm"
    table = ("Anna paid 3 4 5 6 7 8 and 9 10 11 12 for 13 14 15 16 items")
    sums = "Compute 12 + 7 + 9 + 4 + 6"
    only = "12 7 9 4 6"
    got = found(spark, ["see here: " + car.replace("60", "75").replace("2", "3"), "so compute 31 + 5 + 8 + 2 + 40 now",
                        "x y convert 6 miles 21 yards 31 ft to mm", "then Bea paid 13 14 15 16 17 18 and 19 110 111 112 for 113 114 115 116 items",
                        "add 31 + 5 + 8 + 2 + 40 now", "the list 12 7 9 4 6 and 1 2 3 4 5", "the list 1 2 3 4 5", "so compute 31 + 31 + 8 + 2 + 40 now"],
                [(1, car), (2, sums), (3, units), (4, table), (5, only), (6, "Compute 7 + 7 + 9 + 4 + 6")])
    # the item with 7 twice is in the text with 31 twice only; the other's fillings may coincide
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 4), (5, 5), (7, 2), (7, 6)}
    assert got[0, 1].reparameterised and not got[5, 5].reparameterised


def test_units_follow_numbers():
    kinds = lambda t: D.Tokens([t.encode()]).kind.tolist()
    assert kinds("drove in a city 60 km in 2 hours") == [D.WORD] * 4 + [D.NUM, D.UNIT, D.WORD, D.NUM, D.UNIT]
    assert kinds("the second foot of a cup") == [D.WORD] * 6


def test_names_that_open_sentences(spark):
    eat = "Maria has 12 apples. Tom has 7 pears. Anna ate 3 of them."
    short = "Maria bought 3 red apples"
    lower = "The dog of Maria ran. Every day she fed it with 3 bones and some milk."
    got = found(spark, [eat.replace("Maria", "Olga").replace("Tom", "Max").replace("Anna", "Ruth"), "and then Olga bought 5 red apples",
                        "we saw that the dog of Olga ran. Every day she fed it with 5 bones and some milk.", "Olga bought 5 red\npears"], [(1, eat), (2, short), (3, lower)])
    assert set(got) == {(0, 1), (1, 2), (2, 3)}
    assert all(r.reparameterised and r.coverage > 0.9 for r in got.values())


def test_possible_names_do_not_speak_against_the_rest(spark):
    item = "The train goes 60 km in 2 hours to town. The driver then waits 5 minutes at the gate."
    got = found(spark, [item.replace("60", "75").replace("The driver", "Each driver"), "\n".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 30], [(1, item)])
    assert set(got) == {(0, 1)}


def test_part_of_a_long_item_and_short_items(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    long = " ".join(words)
    got = found(spark, ["so " + " ".join(words[20:33]) + " it goes", "so " + " ".join(words[20:32]) + " it goes",
                        "so " + " ".join(words[20:28]) + " and " + " ".join(words[30:38]), "tell me Who wrote war and peace", "yes", "no, Max wrote war and", "yes indeed"],
                [(1, long), (2, "who wrote war and"), (3, "yes"), (4, "Yes indeed")])
    assert set(got) == {(0, 1), (3, 2)}
    assert got[0, 1].matched_tokens == 13 and not got[0, 1].reparameterised


def test_decontaminate_keeps_columns_with_the_results_names(spark):
    docs = plain(spark, [(1, ITEM, "en", "s"), (2, "nothing", "en", "s"), (None, ITEM, "en", "s")]).selectExpr("*", "'mine' AS row_key", "1 AS _row_key", "2 AS run")
    kept = D.decontaminate(docs, items(spark, [(1, ITEM)]))
    assert kept.columns == docs.columns and [(r.doc_id, r.row_key, r["_row_key"], r.run) for r in kept.collect()] == [(2, "mine", 1, 2)]
