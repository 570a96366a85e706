"""Mention extraction against a direct reading of the rules, post by post."""

import random
import re

from tidemark.operators import mentions as M

COINS = [
    ("BTC", "Bitcoin"), ("ETH", "Ethereum"), ("NEAR", "NEAR Protocol"), ("LINK", "Chainlink"), ("SHIB", "Shiba Inu"), ("FET", "Fetch.ai"),
    ("UNI", "Uniswap"), ("DOGE", "Dogecoin"), ("MOG", "Mog Coin"), ("THE", "The Coin"), ("A", "ab"),
]
WORDS = (
    "near link uni the coin crypto bitcoin Bitcoin btc $BTC #eth $NEAR shiba inu fetch.ai fetch mog MOG UNI THE price chart lunch walk $UNI_x a ab DOGE "
    "chainlink NEARBY near. link, (uni) dogecoin's é中 ethereum\n"
).split(" ")


def brute(title, body, strict):
    text = f"{title}\n{body or ''}"
    low = text.lower()
    word = re.compile(r"[A-Za-z0-9_]")
    counts = {}

    def near_coin_talk(at, n):
        return re.search(r"(?a:\b)(?:" + M.CONTEXT_WORDS + r")(?a:\b)", low[max(0, at - 80): at + n + 80], re.I | re.A) is not None

    symbols = {s for s, _ in COINS}
    for m in re.finditer(r"[$#]([A-Z]{2,10})(?![A-Za-z0-9_])", text, re.I | re.A):
        s = m.group(1).upper()
        if s in symbols:
            counts[s] = counts.get(s, 0) + 1
    for s, name in COINS:
        for alias in (name.lower(), s.lower()):
            if len(alias) < (8 if strict else 3):
                continue
            m = re.search(r"\b" + re.escape(alias) + r"\b", low, re.A)
            if not m:
                continue
            if len(alias) <= 4 and s in M.AMBIGUOUS and s not in counts and not near_coin_talk(m.start(), len(alias)):
                continue
            counts[s] = counts.get(s, 0) + 1
    if not strict:
        for m in re.finditer(r"\b([A-Z]{2,10})\b", title, re.A):
            s = m.group(1)
            if 3 <= len(s) <= 6 and s not in M.BLACKLIST and s in symbols and s not in counts:
                if s in M.AMBIGUOUS and not near_coin_talk(m.start(), len(s)):
                    continue
                counts[s] = 1
    assert word
    return counts


def posts(n=250):
    rnd = random.Random(11)
    out = [(0, "NEAR the shop", None), (1, "", ""), (2, "UNI", "x" * 100 + " price"), (3, "about near", "nothing else"), (4, "near", "the crypto price")]
    for i in range(5, n):
        out.append((i, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 6))), " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 25)))))
    return out


def run(spark, strict):
    p = posts()
    df = spark.createDataFrame(p, "id int, title string, body string")
    coins = spark.createDataFrame(COINS, "symbol string, name string")
    for context in (True, False):
        got = {}
        for r in M.extract_mentions(df, coins, strict, context).collect():
            got.setdefault(r.id, {})[r.coin_symbol] = r.mention_count
        for i, title, body in p:
            assert got.get(i, {}) == brute(title, body, strict), (i, title, body)


def test_extract(spark):
    run(spark, False)


def test_extract_strict(spark):
    run(spark, True)


def test_loose_against_containment(spark):
    p = posts()
    df = spark.createDataFrame(p, "id int, title string, body string")
    coins = spark.createDataFrame([*COINS, ("KOR", "비트 코인"), ("ETC", "éther")], "symbol string, name string")
    got = {(r.id, r.coin_symbol): r.mention_count for r in M.extract_mentions_loose(df, coins).collect()}
    want = {}
    for i, title, body in p:
        low = f"{title}\n{body or ''}".lower()
        for s, name in [*COINS, ("KOR", "비트 코인"), ("ETC", "éther")]:
            n = sum(len(a) >= 3 and a in low for a in (name.lower(), s.lower()))
            n += sum(m.upper() == s for m in re.findall(r"[$#]([A-Za-z]{2,10})(?![A-Za-z0-9_])", f"{title}\n{body or ''}"))
            caps = any(m == s and m not in M.BLACKLIST for m in re.findall(r"(?<![A-Za-z0-9_])([A-Z]{3,6})(?![A-Za-z0-9_])", title))
            if n or caps:
                want[i, s] = n or 1
    assert got == want


def test_alias_without_ascii_words(spark):
    df = spark.createDataFrame([(1, "오늘 비트코인은 x", None), (2, "a비트코인b", None), (3, "none", None)], "id int, title string, body string")
    coins = spark.createDataFrame([("XXX", "비트코인")], "symbol string, name string")
    # ASCII edges: the name is no word, so it needs an ASCII word character on both sides
    for context in (True, False):
        assert [(r.id, r.mention_count) for r in M.extract_mentions(df, coins, context=context).collect()] == [(2, 1)]
    assert sorted(r.id for r in M.extract_mentions_loose(df, coins).collect()) == [1, 2]


def test_context(spark):
    df = spark.createDataFrame([(1, "x" * 50 + " $BTC " + "y" * 50, None)], "id int, title string, body string")
    r = M.extract_mentions(df, spark.createDataFrame(COINS, "symbol string, name string")).collect()[0]
    assert (r.coin_symbol, r.coin_name, r.mention_count) == ("BTC", "Bitcoin", 2)
    assert r.context == "x" * 29 + " $BTC " + "y" * 29


def test_aliases_of_several_words_and_many_sharers(spark):
    """A word that all aliases share is not the one they meet on; separators and places must fit exactly."""
    texts = ["the red fox\nruns", "the  red fox", "a the-red fox", "red fox the blue", "The blue, red", "#the red fox", "the red foxes", "the\nred fox", "the blue\u212a the BLUE"]
    coins = [("RFX", "the red fox"), ("BLX", "the blue"), ("REX", "the red"), ("TBR", "the blue, red"), ("BLK", "the bluek")]
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)], "id int, title string, body string")
    got = {(r.id, r.coin_symbol): r.mention_count for r in M.extract_mentions(df, spark.createDataFrame(coins, "symbol string, name string")).collect()}
    want = {(i, s): 1 for i, x in enumerate(texts) for s, a in coins if re.search(r"\b" + re.escape(a) + r"\b", x.lower(), re.A)}
    assert got == want and len(want) > 9


def test_hashtag_in_front_of_line_end(spark):
    df = spark.createDataFrame([(1, "x ##\nBTC", None), (2, "x #BTC\u00e9", None), (3, "$BTC2", None)], "id int, title string, body string")
    got = {r.id: r.mention_count for r in M.extract_mentions(df, spark.createDataFrame([("BTC", "zz")], "symbol string, name string")).collect()}
    assert got == {1: 1, 2: 2}
