"""Coin mentions in posts: cashtags, aliases at word boundaries, upper-case title words.

Posts and aliases are never crossed: they meet on whole runs of words, in the substring
form on first characters.  Every cashtag hit counts, an alias counts once however
often it appears, a title word only when nothing else named the coin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, repeat
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keyed import exploded
from tidemark.semantics import EDGE, LEFT, RIGHT, WORD, WS, js_trim, let
from tidemark.session import cut_lineage

# Upper-case words that are no coins, symbols that are also plain words, and words of coin talk.
BLACKLIST = (
    "THE", "AND", "FOR", "ARE", "BUT", "NOT", "YOU", "ALL", "CAN", "HER", "WAS", "ONE", "OUR", "OUT", "HAS", "HIS", "HOW", "MAN", "NEW",
    "NOW", "OLD", "SEE", "WAY", "WHO", "BOY", "DID", "ITS", "LET", "PUT", "SAY", "SHE", "TOO", "USE", "DAD", "MOM", "GET", "GOT", "HIM",
    "HIT", "HOT", "BIG", "END", "WHY", "RUN", "DIP", "BUY", "ATH", "ATL", "CEO", "NFT", "DEX", "APR", "APY", "TVL", "IMO", "LOL", "HODL",
    "FOMO", "FUD", "DYOR", "DD", "TA", "FA", "OTC", "ICO", "IDO", "IEO", "DCA", "ROI", "PNL", "USD", "EUR", "GBP", "JPY", "KRW", "CNY",
    "CAD", "AUD", "ETF", "SEC", "FBI", "CIA", "USA", "UK", "EU", "UN", "AI", "ML", "API", "SDK", "GPU", "CPU", "RAM", "SSD", "HDD", "USB",
    "URL", "PSA", "TIL", "ELI", "AMA", "CMV", "JUST", "LONG", "SHORT", "PUMP", "DUMP", "MOON", "BEAR", "BULL", "WHALE", "RUG", "GAS", "ACT",
)
AMBIGUOUS = (
    "UNI", "FIL", "COMP", "NEAR", "LINK", "ATOM", "CAKE", "OCEAN", "RENDER", "BLAST", "BASE", "TURBO", "GIGA", "TRUMP", "MELANIA",
    "VIRTUAL", "MEME", "MOG", "MEW",
)
CONTEXT_WORDS = (
    r"crypto|coin|token|blockchain|defi|nft|swap|dex|cex|chain|pump|dump|moon|hodl|bullish|bearish|airdrop|staking|yield|listing|delist|"
    r"burn|whale|memecoin|sol|eth|btc|binance|coinbase|uniswap|raydium|jupiter|market\s?cap|trading|wallet|mint|liquidity|presale|buy|"
    r"sell|long|short|leverage|price|volume|rally|breakout|resistance|support|chart|altcoin|degen|rug\s?pull|onchain|on-chain|"
    r"\$[A-Z]{2,10}|#[A-Z]{2,10}"
)
TOPIC_WORDS = (
    "crypto", "cryptocurrency", "blockchain", "defi", "nft", "token", "memecoin", "meme coin", "shitcoin", "altcoin", "pump", "dump",
    "moon", "hodl", "wagmi", "ngmi", "degen", "rug", "rugpull", "airdrop", "staking", "yield", "swap", "dex", "cex", "binance", "coinbase",
    "kraken", "uniswap", "raydium", "jupiter", "solana", "ethereum", "bitcoin", "base chain", "arbitrum", "pump.fun", "pumpfun",
    "bonding curve", "market cap",
)
CONTEXT = f"(?i){EDGE}(?:{CONTEXT_WORDS}){EDGE}"
TICKER = r"[$#]([A-Za-z]{2,10})" + RIGHT
MIN_ALIAS, MIN_ALIAS_STRICT = 3, 8


def alias_dim(coins: DataFrame) -> DataFrame:
    """(symbol, alias, idx): lower-case name then symbol per coin unless an ``aliases`` array is given."""
    arr = F.col("aliases") if "aliases" in coins.columns else F.array(F.lower("name"), F.lower("symbol"))
    a = coins.select(F.upper("symbol").alias("symbol"), "name", F.posexplode(arr).alias("p", "alias"))
    a = a.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("name", "p")))
    return a.select("symbol", F.lower("alias").alias("alias"), "idx")


def foldable(text: Column) -> Column:
    """The text with the two letters whose lower case has an ASCII letter written so that lower-casing keeps every chunk's place."""
    return F.replace(F.replace(text, F.lit("\u212a"), F.lit("K")), F.lit("\u0130"), F.lit("I\u0307"))


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, cut off its lineage and sent to all tasks if it has at most ``most`` rows; otherwise joined by a shuffle."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= most else df


def post_texts(posts: DataFrame) -> DataFrame:
    title, body = foldable(F.coalesce("title", F.lit(""))), foldable(F.coalesce("body", F.lit("")))
    text = F.concat(title, F.lit("\n"), body)
    return posts.select("id", title.alias("title"), text.alias("text"), F.lower(text).alias("low"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0))


def word_runs(text: Column, k: int) -> Column:
    """Runs of ``k`` words of a text with what lies between them, one from each word on."""
    if k == 1:
        return words_of(text)
    # predefined classes are a table in Java, negated sets are tested range by range and took five times as long
    return F.regexp_extract_all(text, F.lit(rf"(?=(\w++(?:\W++\w++){{{k - 1}}}))\w++"), F.lit(1))


def ticks(p: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, symbol) of each cashtag or hashtag that names a coin."""
    t = exploded(p, F.regexp_extract_all("text", F.lit(TICKER), F.lit(1)), "s", "id").select("id", F.upper("s").alias("symbol"))
    return t.join(symbols, "symbol", "left_semi").select("id", "symbol")


def caps_rows(p: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, symbol) of upper-case title words that name a coin."""
    caps = F.array_distinct(F.regexp_extract_all("title", F.lit(LEFT + "([A-Z]{3,6})" + RIGHT), F.lit(1)))
    c = exploded(p, F.array_except(caps, F.array(*[F.lit(w) for w in BLACKLIST])), "symbol", "id")
    return c.join(symbols, "symbol", "left_semi").select("id", "symbol")


def alias_rows(p: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, symbol, alias, idx) of aliases (symbol, alias, idx, words) that begin and end with a word.

    An alias of k words is one of the post's runs of k words, so posts and aliases meet on the whole alias: nothing is compared
    afterwards, and a text is read once for each number of words that an alias has.
    """
    sizes = aliases.agg(F.sort_array(F.collect_set("words"))).first()[0]
    if not sizes:
        return p.limit(0).join(aliases.limit(0).select("symbol", "alias", "idx"), F.lit(True)).select("id", "symbol", "alias", "idx")
    runs = F.array_distinct(F.concat(*[word_runs(F.col("low"), k) for k in sizes]))
    return exploded(p, runs, "alias", "id").join(aliases, "alias").select("id", "symbol", "alias", "idx")


def hit_rows(p: DataFrame, aliases: DataFrame, symbols: DataFrame, strict: bool) -> DataFrame:
    """What names a coin by words: (id, symbol, kind, alias, idx), one row a tick, alias or upper-case title word."""
    def marked(df: DataFrame, kind: str) -> DataFrame:
        return df.select("id", "symbol", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("alias"), F.lit(0).alias("idx"))

    rows = alias_rows(p, aliases).select("id", "symbol", F.lit("alias").alias("kind"), "alias", "idx").unionByName(marked(ticks(p, symbols), "tick"))
    return rows if strict else rows.unionByName(marked(caps_rows(p, symbols), "caps"))


def odd_gram() -> Column:
    """The three characters at the end of an alias that is no word character."""
    head, tail = F.substring("alias", 1, MIN_ALIAS), F.substring("alias", -MIN_ALIAS, MIN_ALIAS)
    return F.when(F.col("alias").rlike(f"^[{WORD}]"), tail).otherwise(head)


def odd_hits(p: DataFrame, dim: DataFrame) -> DataFrame | None:
    """Posts that may hold an alias with something else than a word character at an end: id, symbol, alias, idx.

    Posts and aliases meet on the three characters at that end; None without such aliases.
    """
    odd = small(dim.select("symbol", "alias", "idx", odd_gram().alias("gram")))
    if odd.isEmpty():
        return None
    return exploded(p, grams(F.col("low"), ODD_EDGE), "gram", "id").join(odd, "gram").select("id", "symbol", "alias", "idx")


WORDS_RE, TICK_RE = re.compile(f"[{WORD}]+"), re.compile(TICKER)
CAPS_RE, CONTEXT_RE = re.compile(f"{LEFT}[A-Z]{{3,6}}{RIGHT}"), re.compile(CONTEXT, re.ASCII)
HIT = "struct<symbol:string,kind:string,alias:string,idx:int>"


def odd_at(low: str, alias: str) -> int:
    """Place of the first hit of an alias with edges on both sides, -1 without one."""
    if alias not in low:
        return -1
    edges = [(LEFT, RIGHT)[k] if WORDS_RE.match(c) else EDGE for k, c in enumerate((alias[0], alias[-1]))]
    m = re.search(edges[0] + re.escape(alias) + edges[1], low)
    return m.start() if m else -1


def weighed(posts: list[tuple], hits: list[tuple]) -> Iterator[tuple]:
    """(symbol, mention_count, text around) of the coins that the ``hits`` of an id name in its ``posts`` (title's length, low, text).

    The words of a post are placed in one pass; an alias in doubt is accepted once something before it named the coin.
    """
    found, seen = dict.fromkeys(hits), Counter(h[0] for h in hits if h[1] == "tick")
    sizes = {len(WORDS_RE.findall(alias)) for _, kind, alias, _ in found if kind == "alias"}
    tick, named, caps = {}, {}, {}
    for title, low, text in posts:
        spans = [m.span() for m in WORDS_RE.finditer(low)]
        at = {}
        for k in sizes:
            for (a, _), (_, b) in zip(reversed(spans[: len(spans) - k + 1]), reversed(spans[k - 1 :]), strict=True):
                at[low[a:b]] = a
        signs, capitals = {}, {}
        for m in TICK_RE.finditer(text):
            signs.setdefault(m[1].upper(), m.start(1))
        for m in CAPS_RE.finditer(text[:title]):
            capitals.setdefault(m[0], []).append(m.start())

        def spoken(a: int, n: int) -> bool:
            return CONTEXT_RE.search(low[max(a - 80, 0) : a + n + 80]) is not None

        for symbol, kind, alias, idx in found:
            n, ambiguous = len(alias or symbol), symbol in AMBIGUOUS
            if kind == "tick":
                a = signs.get(symbol, -1)
                if a >= 0:
                    tick[symbol] = max(tick.get(symbol, ""), text[max(a - 31, 0) : a + n + 30])
            elif kind == "caps":
                for a in capitals.get(symbol, ()):
                    if not ambiguous or spoken(a, n):
                        caps[symbol] = min(caps.get(symbol, (a + 1,)), (a, text[max(a - 30, 0) : min(a + n + 30, title)]))
                        break
            else:
                a = at.get(alias, -1) if kind == "alias" else odd_at(low, alias)
                if a >= 0:
                    sure = not (ambiguous and n <= 4) or spoken(a, n)
                    named.setdefault(symbol, []).append((idx, sure, text[max(a - 30, 0) : a + n + 30]))
    for symbol in dict.fromkeys(h[0] for h in found):
        aliases = sorted(named.get(symbol, ()))
        if not seen[symbol]:
            sure = next((i for i, s, _ in aliases if s), None)
            aliases = [] if sure is None else [x for x in aliases if x[0] >= sure]
        n = seen[symbol] + len({x[0] for x in aliases})
        if n or symbol in caps:
            yield symbol, n or 1, tick[symbol] if symbol in tick else aliases[0][2] if aliases else caps[symbol][1] if symbol in caps else None


def weighed_hits(p: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, symbol, mention_count, ctx) of hits, with what the text around them says.

    The hits of an id come to its texts as one array; both move once, and what comes out is final.
    """
    per_post = rows.groupBy("id").agg(F.collect_list(F.struct("symbol", "kind", "alias", "idx")).alias("hits"))
    texts = p.where("id IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct(F.char_length("title").alias("title"), "low", "text")).alias("posts"))
    kind = p.schema["id"].dataType.simpleString()

    def fields(a: pa.ListArray) -> tuple[list[int], list[tuple]]:
        """Ends of a column's lists, from 0 on, and their structs in a row."""
        ends, flat = a.offsets.to_pylist(), a.flatten()
        return [e - ends[0] for e in ends], list(zip(*[x.to_pylist() for x in flat.flatten()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                (pe, posts), (he, hits) = fields(batch.column(1)), fields(batch.column(2))
                out = [(k, *r) for k in range(batch.num_rows) for r in weighed(posts[pe[k] : pe[k + 1]], hits[he[k] : he[k + 1]])]
                at, symbol, n, ctx = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(symbol, pa.string()), pa.array(n, pa.int32()), pa.array(ctx, pa.string())],
                    names=["id", "symbol", "mention_count", "ctx"],
                )

    found = texts.join(per_post, "id").select("id", "posts", "hits").mapInArrow(run, f"id {kind}, symbol string, mention_count int, ctx string")
    return found.withColumn("ctx", js_trim(F.replace("ctx", F.lit("\n"), F.lit(" "))))


class Lexicon(NamedTuple):
    """Coins and aliases by number, as every task knows them."""

    symbols: pa.Array
    ambiguous: np.ndarray  # by symbol
    tickers: dict[str, int]  # symbols that ticks and upper-case words can name
    aliases: list[str]
    size: np.ndarray  # characters of an alias
    first: np.ndarray  # of an alias's owners, and how many it has
    owners: np.ndarray
    symbol: np.ndarray  # of an owner, and the alias's place among those of the coin
    idx: np.ndarray
    words: dict[str, int]  # aliases of one word and first words of longer ones
    alias_of: np.ndarray  # by word, -1 for first words only
    heads: dict[int, np.ndarray]  # by number of words: is a word the first of such an alias
    runs: dict[str, int]
    odd: dict[str, list[int]]  # by the three characters at an end


def lexicon(dim: DataFrame, symbols: DataFrame, most: int = 500_000) -> Lexicon | None:
    """The aliases (symbol, alias, idx, words, gram; ``words`` null for those that meet on a gram) and the symbols; None beyond ``most`` aliases."""
    if dim.count() > most or symbols.count() > most:
        return None
    rows = list(zip(*dim.select("alias", "symbol", "idx", "words", "gram").toArrow().to_pydict().values(), strict=True))
    tickers = symbols.toArrow().to_pydict()["symbol"]
    rows.sort(key=itemgetter(0))
    names = list(dict.fromkeys([*tickers, *(r[1] for r in rows)]))
    at = {s: k for k, s in enumerate(names)}
    aliases, first, words, alias_of, heads, runs, odd = [], [], {}, [], {}, {}, {}

    def number(word: str) -> int:
        if word not in words:
            words[word] = len(alias_of)
            alias_of.append(-1)
        return words[word]

    for k, (alias, _, _, n, gram) in enumerate(rows):
        if aliases and aliases[-1] == alias:
            continue
        if n is None:
            odd.setdefault(gram, []).append(len(aliases))
        elif n == 1:
            alias_of[number(alias)] = len(aliases)
        else:
            runs[alias] = len(aliases)
            heads.setdefault(n, set()).add(number(WORDS_RE.match(alias)[0]))
        aliases.append(alias)
        first.append(k)
    first = np.array(first, np.int64)
    return Lexicon(
        pa.array(names, pa.string()), np.array([s in AMBIGUOUS for s in names], bool), {s: at[s] for s in tickers}, aliases,
        np.array([len(a) for a in aliases], np.int64), first, np.diff(first, append=len(rows)), np.array([at[r[1]] for r in rows], np.int64),
        np.array([r[2] for r in rows], np.int64), words, np.array(alias_of, np.int64), {n: np.isin(np.arange(len(alias_of)), [*x]) for n, x in sorted(heads.items())}, runs, odd,
    )


ODD_EDGE = f"[^{WORD}].{{{MIN_ALIAS - 1}}}|.{{{MIN_ALIAS - 1}}}[^{WORD}]"
ODD_RE = re.compile(f"(?s)(?=({ODD_EDGE}))")
#: Every byte but those of words becomes a space, so that words keep their places.
GAPS = bytes(c if re.match(f"[{WORD}]", chr(c)) else 32 for c in range(256))
BLANKS = "".join(re.findall(f"[{WS}]", "".join(map(chr, range(0xFFFF))), re.ASCII))
IS_BLANK = np.isin(np.arange(0x10000), [ord(c) for c in BLANKS])
#: Ends a line for Java, so ``$`` matches in front of it, but is no white space.
NEL = "\x85"


def trimmed(text: str) -> str:
    """``js_trim`` of a text."""
    return text[:-1].strip(BLANKS) + NEL if text.endswith(NEL) else text.strip(BLANKS)


def bounds(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places where the texts begin and end once they are joined by one character."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size + 1) - 1
    return end - size, end


def first_places(lows: list[str], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(post, alias, place in the post) of the first hit of each alias in each text; the words of all texts are looked up in one pass."""
    low, (begin, end) = "\n".join(lows), bounds(lows)
    data = low.encode("ascii", "replace").translate(GAPS)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" "))
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    word = np.fromiter(map(lex.words.get, data.decode("ascii").split(" "), repeat(-1)), np.int64, len(ends))
    known = np.flatnonzero(word >= 0)
    alias = lex.alias_of[word[known]]
    one = alias >= 0
    found, places = [alias[one]], [starts[known[one]]]
    full = np.flatnonzero(ends > starts) if lex.heads else known
    for n, heads in lex.heads.items():
        spots = known[heads[word[known]]]
        last = np.searchsorted(full, spots) + n - 1
        spots, last = spots[last < len(full)], full[last[last < len(full)]]
        at = starts[spots]
        alias = np.fromiter(map(lex.runs.get, [low[a:b] for a, b in zip(at.tolist(), ends[last].tolist(), strict=True)], repeat(-1)), np.int64, len(at))
        some = (alias >= 0) & (np.searchsorted(begin, at, "right") == np.searchsorted(begin, ends[last] - 1, "right"))
        found.append(alias[some])
        places.append(at[some])
    if lex.odd:
        pairs = [
            (k, begin[p] + a) for p, x in enumerate(lows) for g in lex.odd.keys() & set(ODD_RE.findall(x)) for k in lex.odd[g] if (a := odd_at(x, lex.aliases[k])) >= 0
        ]
        found.append(np.array([k for k, _ in pairs], np.int64))
        places.append(np.array([a for _, a in pairs], np.int64))
    alias, at = np.concatenate(found), np.concatenate(places)
    # an alias is found in one of these ways only, there from left to right: the least row of a post and alias is its first place
    n = max(len(at), 1)
    key = np.sort(((np.searchsorted(begin, at, "right") - 1) * len(lex.aliases) + alias) * n + np.arange(len(at)))
    key = key[np.diff(key // n, prepend=-1) > 0]
    post, at = key // n // max(len(lex.aliases), 1), at[key % n]
    return post, alias[key % n], at - begin[post]


def owned(alias: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``alias``, one for each of its owners, and the owners."""
    n = lex.owners[alias]
    row = np.repeat(np.arange(len(alias)), n)
    return row, lex.first[alias][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]


def capitals(text: str, lex: Lexicon) -> Iterator[tuple[int, int]]:
    """(symbol, place) of the upper-case words of a title that name a coin."""
    for m in CAPS_RE.finditer(text):
        if m[0] not in BLACKLIST and m[0] in lex.tickers:
            yield lex.tickers[m[0]], m.start()


def named(posts: list[tuple], lex: Lexicon, strict: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Columns (post, symbol, mention_count, text around) of posts (title's length, low, text) of an id each: ``weighed``, for many at once."""
    titles, lows, texts = zip(*posts, strict=True)
    flat, (begin, end), n = "\n".join(texts), bounds(texts), len(lex.symbols)

    def spoken(p: int, a: int, size: int) -> bool:
        return CONTEXT_RE.search(lows[p][max(a - 80, 0) : a + size + 80]) is not None

    signs = [(m.start(), lex.tickers[s]) for m in TICK_RE.finditer(flat) if (s := m[1].upper()) in lex.tickers]
    at, symbol = np.array(signs, np.int64).reshape(-1, 2).T
    ticks, first, times = np.unique((np.searchsorted(begin, at, "right") - 1) * n + symbol, return_index=True, return_counts=True)
    tick_at, tick_size = at[first], np.array([len(lex.symbols[k].as_py()) + 1 for k in symbol[first].tolist()], np.int64)

    post, alias, at = first_places(lows, lex)
    row, owner = owned(alias, lex)
    key, idx, size = post[row] * n + lex.symbol[owner], lex.idx[owner], lex.size[alias][row]
    order = np.lexsort((idx, key))
    key, size, post, at = key[order], size[order], post[row][order], at[row][order]
    doubt = lex.ambiguous[key % max(n, 1)] & (size <= 4)
    if doubt.any():
        doubt &= ~np.isin(key, ticks)
        for k in np.flatnonzero(doubt).tolist():
            doubt[k] = not spoken(post[k], at[k], size[k])
        # without a cashtag, an alias in doubt counts after one that is sure
        rows = np.arange(len(key))
        keep = np.maximum.accumulate(np.where(doubt, -1, rows)) >= np.searchsorted(key, key)
        key, size, post, at = key[keep], size[keep], post[keep], at[keep]
    top = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(top, append=len(key))
    key, at, size = key[top], at[top] + begin[post[top]], size[top]
    where = np.searchsorted(key, ticks)
    both = where < len(key)
    both[both] = key[where[both]] == ticks[both]
    where = where[both]
    count[where] += times[both]
    at[where], size[where] = tick_at[both], tick_size[both]
    key, count, at, size = (np.concatenate(x) for x in ((key, ticks[~both]), (count, times[~both]), (at, tick_at[~both]), (size, tick_size[~both])))
    post = key // max(n, 1)
    lo, hi = np.maximum(at - 30, begin[post]), np.minimum(at + size + 30, end[post])
    caps = {}
    for p, (title, _, text) in enumerate(posts if not strict else ()):
        for s, a in capitals(text[:title], lex):
            w = len(lex.symbols[s].as_py())
            if p * n + s not in caps and (not lex.ambiguous[s] or spoken(p, a, w)):
                caps[p * n + s] = begin[p] + max(a - 30, 0), begin[p] + min(a + w + 30, title)
    if caps:
        more = np.array([(k, *x) for k, x in caps.items()], np.int64)
        more = more[~np.isin(more[:, 0], key)]
        key, lo, hi = (np.concatenate(x) for x in zip((key, lo, hi), more.T, strict=True))
        count = np.concatenate([count, np.ones(len(more), np.int64)])
    return key // max(n, 1), lex.symbols.take(pa.array(key % max(n, 1))), count, pieces(flat.replace("\n", " "), lo, hi)


def pieces(text: str, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Parts of a text, trimmed as ``js_trim`` does."""
    data, chars = text.encode(), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = IS_BLANK[np.minimum(chars, 0xFFFF)]
    odd = [(k, trimmed(text[lo[k] : hi[k]]).encode()) for k in np.flatnonzero((hi > lo) & (chars[hi - 1] == ord(NEL))).tolist()] if NEL in text else []
    lo, hi = lo.copy(), hi.copy()
    for edge, step in ((lo, 1), (hi, -1)):
        rows = np.arange(len(lo))
        while len(rows := rows[lo[rows] < hi[rows]]) and len(rows := rows[blank[edge[rows] - (step < 0)]]):
            edge[rows] += step
    if len(data) > len(text):
        at = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64)])
        lo, hi = at[lo], at[hi]
    cut = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    for k, x in odd:
        cut[k] = x
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
    return pa.StringArray.from_buffers(len(cut), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(b"".join(cut)))


def hits_in(posts: list[tuple], lex: Lexicon, strict: bool) -> list[tuple]:
    """The hits that ``weighed`` settles, of the posts of one id."""
    _, alias, _ = first_places([low for _, low, _ in posts], lex)
    row, owner = owned(alias, lex)
    hits = []
    for k, symbol, idx in zip(alias[row].tolist(), lex.symbols.take(pa.array(lex.symbol[owner])).to_pylist(), lex.idx[owner].tolist(), strict=True):
        ends = lex.aliases[k][0], lex.aliases[k][-1]
        hits.append((symbol, "alias" if all(map(WORDS_RE.match, ends)) else "odd", lex.aliases[k], idx))
    for title, _, text in posts:
        hits += [(s, "tick", None, 0) for x in TICK_RE.findall(text) if (s := x.upper()) in lex.tickers]
        hits += [(lex.symbols[s].as_py(), "caps", None, 0) for s, _ in capitals(text[:title], lex)] if not strict else []
    return hits


def read_hits(posts: DataFrame, lex: Lexicon, strict: bool, chars: int = 500_000) -> DataFrame:
    """(id, symbol, mention_count, ctx) of what names a coin in posts (id, title, body), ``ctx`` trimmed.

    The posts move once, to the task of their id, and are read once: a task looks up their words among the aliases, which it has whole,
    and cuts the texts around the hits, about ``chars`` characters of posts at a time.  Posts that share an id are settled by ``weighed``.
    """
    p = by_id(posts.select("id", "title", "body").where("id IS NOT NULL")).sortWithinPartitions("id")
    p = post_texts(p).select("id", F.char_length("title").alias("title"), "low", "text")
    kind, shared = p.schema["id"].dataType.simpleString(), posts.sparkSession.sparkContext.broadcast(lex)
    columns = ["id", "symbol", "mention_count", "ctx"]

    def read(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[tuple]:
        for batch in batches:
            types[:] = [batch.schema.field(0).type]
            for k in range(0, batch.num_rows, 200):
                yield from zip(*[x.to_pylist() for x in batch.slice(k, 200).columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, ids, alone, rows, held = [], [], [], [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            if alone:
                post, symbol, n, ctx = named(alone, shared.value, strict)
                yield pa.RecordBatch.from_arrays([pa.array(ids, types[0]).take(pa.array(post)), symbol, pa.array(n, pa.int32()), ctx], names=columns)
            if rows:
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (types[0], pa.string(), pa.int32(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

        for i, group in groupby(read(batches, types), itemgetter(0)):
            same = [x[1:] for x in group]
            if len(same) == 1:
                ids.append(i)
                alone += same
            else:
                rows += [(i, symbol, n, trimmed(ctx.replace("\n", " "))) for symbol, n, ctx in weighed(same, hits_in(same, shared.value, strict))]
            held += sum(len(low) for _, low, _ in same)
            if held > chars:
                yield from settled()
                ids, alone, rows, held = [], [], [], 0
        yield from settled()

    return p.mapInArrow(run, f"id {kind}, symbol string, mention_count int, ctx string")


def holding(p: DataFrame, aliases: DataFrame, most: int = 200) -> DataFrame:
    """Posts whose text holds one of a few aliases anywhere; all posts if there are more than ``most``, as the test only saves work."""
    some = [r[0] for r in aliases.select("alias").distinct().limit(most + 1).collect()]
    return p if len(some) > most else p.where(F.col("low").rlike("|".join(map(re.escape, some))))


def plain_counts(rows: DataFrame, most: int) -> DataFrame:
    """(id, symbol, mention_count) of hits that are all certain: ticks, and each of a coin's at most ``most`` aliases once.

    The aliases found are bits of a few numbers, so the rows move once.
    """
    bits = [F.bit_or(F.when((F.col("kind") == "alias") & (F.floor(F.col("idx") / 62) == b), F.expr("shiftleft(1L, idx % 62)"))) for b in range(most // 62 + 1)]
    names = reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(b), F.lit(0)) for b in bits])
    one = F.count_if(F.col("kind") == "tick") + names
    return rows.groupBy("id", "symbol").agg(F.greatest(one, F.lit(1)).cast("int").alias("mention_count"))


def extract_mentions(posts: DataFrame, coins: DataFrame, strict: bool = False, context: bool = True) -> DataFrame:
    """(id, coin_symbol, coin_name, mention_count, context) for posts (id, title, body); without ``context`` that column is null.

    ``strict`` is for sources with much small talk: cashtags and long aliases only.

    A post's words and runs of words are met with the aliases, so a text is never searched per alias.  With context the posts move once
    and are read once, by tasks that have all the aliases (``read_hits``).  Without it, or with too many aliases for that, runs of words are joined
    with them, and texts are read again, moved once, for the context or the hits that depend on the words around them: ambiguous
    symbols, and aliases with something else than a word character at an end.
    """
    p = post_texts(posts)
    names = coins.groupBy(F.upper("symbol").alias("symbol")).agg(F.max("name").alias("coin_name"))
    dim = alias_dim(coins).where(F.char_length("alias") >= (MIN_ALIAS_STRICT if strict else MIN_ALIAS))
    regular = F.col("alias").rlike(f"(?s)^[{WORD}](.*[{WORD}])?$")
    symbols = names.select("symbol").where(F.col("symbol").rlike("^[A-Z]{2,10}$"))
    if context:
        dim, symbols = cut_lineage(dim), cut_lineage(symbols)
        lex = lexicon(dim.withColumns({"words": F.when(regular, F.size(words_of(F.col("alias")))), "gram": odd_gram()}), symbols)
        if lex is not None:
            return with_names(read_hits(posts, lex, strict), names)
    aliases = small(dim.where(regular).withColumn("words", F.size(words_of(F.col("alias")))))
    symbols = small(symbols)
    odd = odd_hits(p, dim.where(~regular))

    def all_hits(p: DataFrame, aliases: DataFrame, symbols: DataFrame) -> DataFrame:
        rows = hit_rows(p, aliases, symbols, strict)
        return rows if odd is None else rows.unionByName(odd.withColumn("kind", F.lit("odd")))

    if context:
        g = weighed_hits(p, all_hits(p, aliases, symbols))
    else:
        # coins whose hits depend on the words around them
        ambiguous = dim.select("symbol").unionByName(names.select("symbol")).where(F.col("symbol").isin(*AMBIGUOUS))
        unclear = small(ambiguous.unionByName(dim.where(~regular).select("symbol")).distinct())
        most = aliases.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]
        if unclear.isEmpty():
            g = plain_counts(hit_rows(p, aliases, symbols, strict), most)
        else:
            clear, doubtful = ([small(x.join(unclear, "symbol", how)) for x in (aliases, symbols)] for how in ("left_anti", "left_semi"))
            near = holding(p, dim.select("symbol", "alias").unionByName(names.select("symbol", F.lower("symbol").alias("alias"))).join(unclear, "symbol", "left_semi"))
            g = plain_counts(hit_rows(p, *clear, strict), most).unionByName(weighed_hits(near, all_hits(near, *doubtful)).drop("ctx"))
        g = g.withColumn("ctx", F.lit(None).cast("string"))
    return with_names(g, names)


def with_names(g: DataFrame, names: DataFrame) -> DataFrame:
    return g.join(names, "symbol", "left").select(
        "id", F.col("symbol").alias("coin_symbol"), "coin_name", "mention_count", F.nullif("ctx", F.lit("")).alias("context")
    )


def grams(text: Column, pattern: str = f".{{{MIN_ALIAS}}}") -> Column:
    """Distinct runs of characters of a text that fit the pattern, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({pattern}))"), F.lit(1)))


#: First characters that posts and aliases of the substring form meet on: an alias has the most that it can.
GRAINS = (3, 4, 6, 8)
#: Aliases of other lengths count once for each pair of an id's posts that hold them, if an id has several.
ONCE_A_POST = (3, 4, 8)


def by_id(posts: DataFrame, chars: int = 8_000_000) -> DataFrame:
    """Posts with all those of an id in one task, of about ``chars`` characters, so that what is counted by id stays where it is."""
    size = posts.agg(F.sum(F.char_length(F.coalesce("title", F.lit(""))) + F.char_length(F.coalesce("body", F.lit("")))).alias("n")).first()[0]
    return posts.repartition(max(posts.sparkSession.sparkContext.defaultParallelism, (size or 0) // chars + 1), "id")


def starts_in(low: str, dim: DataFrame) -> Column | None:
    """What begins at each place of a text where an alias of ``dim`` may begin, as long as the longest: a word's characters, once for equal
    words, for aliases without other characters; for the rest what follows a word's end, with as many of its last characters as they begin with.
    """
    size, first = F.char_length("alias"), F.char_length(F.regexp_extract("alias", r"^\w*", 0))
    sizes = dim.select(F.when(first < size, first).alias("first"), size.alias("size")).groupBy("first").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).collect()
    found = []
    for n, lo, hi in sizes:
        if n is None:
            words = F.array_join(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"\w{{{lo},}}"), F.lit(0))), " ")
            found.append(F.regexp_extract_all(words, F.lit(rf"(?=(\w{{{lo},{hi}}}))"), F.lit(1)))
        else:
            rest = rf"(?=(\w{{{n}}}\W.{{{lo - n - 1},{hi - n - 1}}}))"
            found.append(F.regexp_extract_all(low, F.lit("(?s)" + (rf"\w{{{n},}}+(?<={rest}\w{{{n}}})" if n else rest)), F.lit(1)))
    return F.concat(*found) if found else None


def held_rows(p: DataFrame, dim: DataFrame) -> DataFrame | None:
    """(id, symbol, n) of aliases (symbol, alias, idx) anywhere in the texts.

    The places of a text where an alias may begin meet the aliases on their first characters and are compared with them at once: no text is
    searched per alias, and neither texts nor pairs that were only similar are moved.
    """
    size, grain = F.char_length("alias"), F.lit(GRAINS[0])
    for n in GRAINS[1:]:
        grain = F.when(size >= n, n).otherwise(grain)
    keyed = small(dim.select("symbol", "alias", "idx", F.substring("alias", F.lit(1), grain).alias("start")))
    ahead = starts_in("low", keyed)
    if ahead is None:
        return None
    used = [r[0] for r in keyed.select(F.char_length("start").alias("n")).distinct().sort("n").collect()]
    texts = exploded(p.withColumn("post", F.monotonically_increasing_id()), ahead, "ahead", "id", "post")
    starts = F.array(*[F.when(F.char_length("ahead") >= n, F.substring("ahead", 1, n)) for n in used])
    met = exploded(texts, starts, "start", "id", "post", "ahead").join(keyed, "start").where(F.startswith("ahead", "alias"))
    once = met.select("id", "post", "symbol", "idx", size.isin(*ONCE_A_POST).alias("once")).distinct()
    times = once.groupBy("id", "symbol", "idx", "once").agg(F.count(F.lit(1)).alias("n"))
    return times.where("once OR id IS NOT NULL").select("id", "symbol", F.when(F.col("once"), F.col("n")).otherwise(F.col("n") * F.col("n")).alias("n"))


def extract_mentions_loose(posts: DataFrame, coins: DataFrame) -> DataFrame:
    """Chat form: aliases match as substrings, without boundaries or context tests.

    The texts move once, to the task of their id; there the aliases in them are found and counted, and what comes out is final.
    Of an id with several posts an alias counts once for each that holds it, or for each pair of them (``ONCE_A_POST``); posts without an
    id have no aliases of the second kind.
    """
    dim = alias_dim(coins).where(F.char_length("alias") >= MIN_ALIAS)
    p = post_texts(by_id(posts.select("id", "title", "body")))
    symbols = small(coins.select(F.upper("symbol").alias("symbol")).distinct())
    rows = ticks(p, symbols).select("id", "symbol", F.lit(1).cast("long").alias("n"))
    held = held_rows(p, dim)
    if held is not None:
        rows = rows.unionByName(held)
    rows = rows.unionByName(caps_rows(p, symbols).withColumn("n", F.lit(None).cast("long")))
    g = rows.groupBy("id", "symbol").agg(F.sum("n").alias("n"))
    return g.select("id", F.col("symbol").alias("coin_symbol"), F.coalesce("n", F.lit(1)).cast("int").alias("mention_count"))


def topic_related(text: Column, coin_words: list[str] | None = None) -> Column:
    """Cashtag in upper case, or any topic word (and coin alias) contained in the text."""
    words = [*TOPIC_WORDS] + [w.lower() for w in coin_words or []]
    pattern = "|".join(re.escape(w) for w in words)
    return F.coalesce(text.rlike(r"\$[A-Z]{2,10}" + RIGHT) | F.lower(text).rlike(pattern), F.lit(False))
