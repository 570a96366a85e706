"""Mentions with context: posts move once and are read once, by tasks that have the aliases."""

import random

import numpy as np

from tests.helpers import evaluate, plan
from tidemark.operators import mentions as M
from tidemark.semantics import js_trim

COINS = [
    ("BTC", "Bitcoin", ["bitcoin", "btc", "digital gold"]), ("NEAR", "Near", ["near protocol", "near"]), ("LINK", "Chainlink", ["chainlink", "link"]),
    ("FET", "Fetch", ["fetch.ai", "fet", "fetch", ".ai net"]), ("XAU", "Gold", ["digital gold", "gold", "gold", "the digital gold"]), ("KOR", "Kor", ["비트코인", "코인 x"]),
    ("UNI", "Uni", ["$uni", "uni"]), ("BTC", "Bitcoin again", ["the btc"]), ("DOGE", "Doge", ["doge", "doge,"]), ("THE", "The", ["the the"]), (None, "none", ["nameless"]), ("a1", "odd", ["a_1"]),
]
WORDS = (
    "bitcoin BTC btc $BTC #btc $Near NEAR near protocol link LINK fetch.ai fet gold digital the doge, DOGE uni $uni $UNI UNI crypto price lunch 비트코인 a비트코인b 코인 x "
    "é中 İx Kor \U0001f600 \x85 　 \t nameless a_1 THE .ai net -"
).split(" ")


def posts(n=300):
    rnd = random.Random(5)
    def some(k):
        return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", "\n", "  ", "", "\x85"]) for _ in range(rnd.randrange(k)))
    # ids come up to three times, and some are null
    return [(None if i % 29 == 0 else i if i % 7 else i % 21, rnd.choice([None, some(6)]), rnd.choice([None, some(60), some(15)])) for i in range(n)]


def found(df, coins, strict):
    return sorted((tuple(r) for r in M.extract_mentions(df, coins, strict).collect()), key=repr)


def test_as_many_and_the_same_as_by_joins(spark, monkeypatch):
    df = spark.createDataFrame(posts(), "id int, title string, body string")
    coins = spark.createDataFrame(COINS, "symbol string, name string, aliases array<string>").orderBy("name").coalesce(1)
    for strict in (False, True):
        got = found(df, coins, strict)
        with monkeypatch.context() as m:
            m.setattr(M, "lexicon", lambda *_: None)
            assert got == found(df, coins, strict) and len(got) > 50


def test_posts_move_once_and_nothing_is_joined_with_them(spark):
    df = spark.createDataFrame([(1, "Bitcoin", "the coin")], "id int, title string, body string")
    coins = spark.createDataFrame([("BTC", "Bitcoin"), ("COIN", "the coin")], "symbol string, name string")
    text = plan(M.extract_mentions(df, coins).select("id", "coin_symbol", "context"))
    assert "Join" not in text and "Generate" not in text and text.count("Exchange") == text.count("REPARTITION_BY_NUM") == 1


def test_cut_into_posts_of_any_number(spark):
    df = spark.createDataFrame([(k // 3 if k < 30 else k, f"About BTC{k % 4}", "the bitcoin\n" * (k % 5)) for k in range(90)], "id int, title string, body string")
    coins = spark.createDataFrame([("BTC", "Bitcoin"), ("BTCA", "the Bitcoin")], "symbol string, name string")
    dim = M.alias_dim(coins).withColumns({"words": M.F.size(M.words_of(M.F.col("alias"))), "gram": M.odd_gram()})
    lex = M.lexicon(dim, coins.select("symbol"))
    one, many = ([*map(tuple, M.read_hits(df, lex, False, n).orderBy("id", "symbol").collect())] for n in (1, 10**6))
    assert one == many and len({r[0] for r in one}) == len({r.id for r in df.collect() if r.body})
    assert M.lexicon(dim, coins.select("symbol"), most=3) is None


def test_parts_of_a_text_are_trimmed_as_the_column_is(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice([*"ab \t\r\x0b\x85\xa0　 ﻿é中", "\U0001f600"]) for _ in range(400))
    for x in (text, "ab  c \r d " * 9, " \t" * 9):
        lo = np.array([rnd.randrange(len(x)) for _ in range(300)])
        hi = np.minimum(lo + np.array([rnd.randrange(9) for _ in lo]), len(x))
        parts = [x[a:b] for a, b in zip(lo, hi, strict=True)]
        assert M.pieces(x, lo, hi).to_pylist() == [M.trimmed(p) for p in parts] == evaluate(spark, js_trim("x"), parts)


def test_runs_of_words_end_with_their_post():
    lex = M.Lexicon(
        M.pa.array(["A"]), np.array([False]), {"A": 0}, ["b c"], np.array([3]), np.array([0]), np.array([1]), np.array([0]), np.array([1]), {"b": 0}, np.array([-1]),
        {2: np.array([True])}, {"b\nc": 0, "b c": 0}, {},
    )
    assert [x.tolist() for x in M.first_places(["a b", "c b c", "b", ""], lex)] == [[1], [0], [2]]


def test_no_coins_no_posts_and_a_long_one(spark):
    coins = spark.createDataFrame([("BTC", "Bitcoin")], "symbol string, name string")
    text = "x " * 400_000 + "see the Bitcoin" + " y" * 400_000
    df = spark.createDataFrame([("a", None, None), ("b", text, "$btc"), ("c", "#BTC", None)], "id string, title string, body string")
    assert M.extract_mentions(df.limit(0), coins).count() == M.extract_mentions(df, coins.limit(0)).count() == 0
    rows = {r.id: (r.mention_count, r.context) for r in M.extract_mentions(df, coins).collect()}
    assert rows == {"b": (3, "y " * 14 + "y $btc"), "c": (2, "#BTC")}
