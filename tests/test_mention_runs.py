"""Mentions found on runs of words, and a coin's aliases as bits."""

from tests.helpers import plan
from tidemark.operators import mentions as M


def test_aliases_of_any_number_of_words_meet_whole(spark):
    df = spark.createDataFrame([(1, "one two  three", "four one two three"), (2, "two three", None), (3, "one two", "three")], "id int, title string, body string")
    dim = spark.createDataFrame([("A", "one two three", 1, 3), ("B", "two", 1, 1), ("C", "three\nfour", 1, 2), ("D", "one two", 1, 2)], "symbol string, alias string, idx int, words int")
    got = {(r.id, r.symbol) for r in M.alias_rows(M.post_texts(df), dim).collect()}
    assert got == {(1, "A"), (1, "B"), (1, "C"), (1, "D"), (2, "B"), (3, "B"), (3, "D")}


def test_more_aliases_than_one_number_has_bits(spark):
    names = [f"alias{k}" for k in range(130)]
    coins = spark.createDataFrame([("BTC", "Bitcoin", names)], "symbol string, name string, aliases array<string>")
    df = spark.createDataFrame([(1, " ".join(names), "$BTC #BTC"), (1, "alias0 alias129", None), (2, "alias128", None)], "id int, title string, body string")
    got = {r.id: r.mention_count for r in M.extract_mentions(df, coins, context=False).collect()}
    assert got == {1: 132, 2: 1}


def test_context_of_a_long_text_is_that_of_the_first_hit(spark):
    body = "x " * 3000 + "see Bitcoin here, Bitcoin there " + "y " * 3000
    df = spark.createDataFrame([(1, "t", body), (None, "Bitcoin", None)], "id int, title string, body string")
    rows = M.extract_mentions(df, spark.createDataFrame([("BTC", "Bitcoin")], "symbol string, name string")).collect()
    assert [(r.id, r.mention_count) for r in rows] == [(1, 1)]
    at = body.index("Bitcoin")
    assert rows[0].context == body[at - 30 : at + 37].strip()


def test_aliases_anywhere_in_a_text(spark):
    names = ["bit", "coin", "bitcoins", "the coin", "in a\nrow", "$ca", "-x", "é a", "aé", "a-b c", "b c", "ccc", "oi", "co in", "long name of a coin"]
    texts = ["The bitcoinsbitcoins, breathe coinage", "win a\nrowing; $cash -x-x", "CAFÉ AÉ aé a", "a-b cc ccccc", "a long name of a coin", "", None, "CO IN co in", "Koin K-x"]
    df = spark.createDataFrame([(k, x, texts[-k]) for k, x in enumerate(texts)], "id int, title string, body string")
    coins = spark.createDataFrame([(f"S{k:02d}9", "n", [x]) for k, x in enumerate(names)], "symbol string, name string, aliases array<string>")
    got = {(r.id, r.coin_symbol): r.mention_count for r in M.extract_mentions_loose(df, coins).collect()}
    low = {k: f"{x or ''}\n{texts[-k] or ''}".lower() for k, x in enumerate(texts)}
    assert got == {(k, f"S{i:02d}9"): 1 for k, x in low.items() for i, a in enumerate(names) if len(a) >= M.MIN_ALIAS and a in x}


def test_loose_form_moves_texts_once_and_nothing_else(spark):
    df = spark.createDataFrame([(1, "Bitcoin", "the coin"), (2, "x", None)], "id int, title string, body string")
    coins = spark.createDataFrame([("BTC", "Bitcoin"), ("COIN", "the coin")], "symbol string, name string")
    found = M.extract_mentions_loose(df, coins)
    moves = [x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x]
    assert moves and all("hashpartitioning(id#" in x and "REPARTITION_BY_NUM" in x for x in moves) and "SortMergeJoin" not in plan(found)
    assert {(r.id, r.coin_symbol, r.mention_count) for r in found.collect()} == {(1, "BTC", 1), (1, "COIN", 2)}


def test_posts_of_one_id_and_of_none(spark):
    df = spark.createDataFrame([(1, "bitcoin", "$BTC"), (1, "bitcoin", None), (None, "bitcoin coin", None)], "id int, title string, body string")
    coins = spark.createDataFrame([("BTC", "bitcoin"), ("COI", "coin")], "symbol string, name string")
    got = {(r.id, r.coin_symbol): r.mention_count for r in M.extract_mentions_loose(df, coins).collect()}
    # bitcoin, of seven letters, counts for each pair of posts; btc is in one of them, beside the cashtag
    assert got == {(1, "BTC"): 6, (1, "COI"): 4, (None, "COI"): 2}


def test_runs_begin_at_every_word(spark):
    df = spark.createDataFrame([("one, two  three\nfour_4 é5",)], "t string")
    assert df.select(M.word_runs(df.t, 2).alias("r")).first().r == ["one, two", "two  three", "three\nfour_4", "four_4 é5"]
    assert df.select(M.word_runs(df.t, 5).alias("r")).first().r == ["one, two  three\nfour_4 é5"]
    assert df.select(M.word_runs(df.t, 6).alias("r")).first().r == []
