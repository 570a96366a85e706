"""The scheduled run as ordered batch steps over a dictionary of tables.

Each step reads what the steps before it produced, as the source chains its
phases; signals use the graph of the previous run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.mentions import extract_mentions
from tidemark.plans import backtest as B
from tidemark.plans import graph as K
from tidemark.plans import ledger as L
from tidemark.plans import queues as Q
from tidemark.plans import signals as G
from tidemark.semantics import at
from tidemark.sources.sinks import KEYS, replace_by_key, upsert

Tables = dict[str, DataFrame]
ORDER = ["crawl", "sentiment", "signals", "prices", "battle", "backtest"]


def crawl(t: Tables, as_of) -> Tables:
    """New posts in, mentions of the touched posts replaced."""
    new = t["new_posts"]
    found = extract_mentions(new.select("id", "title", "body"), t["coins"]).withColumnRenamed("id", "post_id").withColumn("created_at", at(as_of))
    touched = new.select(F.col("id").alias("post_id"))
    return {"posts": upsert(t["posts"], new, ["id"]), "mentions": replace_by_key(t["mentions"], found, "post_id", touched)}


def sentiment(t: Tables, as_of) -> Tables:
    """Work queue for the model; its answers come back through ``outputs``."""
    out = {"queue": Q.posts_without_sentiment(t["posts"], t["sentiments"], t["mentions"])}
    if "answers" in t:
        out["sentiments"] = upsert(t["sentiments"], t["answers"], KEYS["sentiments"])
    return out


def signals(t: Tables, as_of) -> Tables:
    s = G.generate_signals(
        t["mentions"], t["posts"], t["sentiments"], t["coins"], t["prices"], as_of, t.get("entities"), t.get("relations"))
    stored = t["signals"]
    rows = s.select(*[c for c in s.columns if c in stored.columns]) if stored is not None else s
    out = {"signals": upsert(stored, rows, KEYS["signals"])}
    if "outputs" in t:
        ents, rels = K.refresh(t["mentions"], t["posts"], t["sentiments"], t["outputs"], t["clusters"], as_of, t["coins"])
        if "entities" in t:
            ents = upsert(K.decay_entities(t["entities"], as_of), ents, KEYS["entities"])
            rels = upsert(K.decay_relations(t["relations"], as_of), rels, KEYS["relations"])
        out |= {"entities": ents, "relations": rels}
    return out


def prices(t: Tables, as_of) -> Tables:
    return {"prices": t["prices"].unionByName(t["new_prices"], allowMissingColumns=True)} if "new_prices" in t else {}


def battle(t: Tables, as_of) -> Tables:
    """Exits that are due and the daily portfolio rows."""
    return {
        "exits": L.exit_decisions(t["positions"], t["prices"], t["signals"]),
        "portfolio": L.daily_snapshot(t["trades"], t["positions"], t["prices"], str(as_of)[:10]),
    }


def backtest(t: Tables, as_of) -> Tables:
    return {"backtest": B.run_backtest(t["signals"], t["prices"], t["coins"], as_of, t.get("backtest"))}


STEPS: dict[str, Callable[[Tables, object], Tables]] = {
    "crawl": crawl, "sentiment": sentiment, "signals": signals, "prices": prices, "battle": battle, "backtest": backtest,
}


def run(tables: Tables, as_of, start: str = ORDER[0], stop: str = ORDER[-1], save: Callable[[str, DataFrame], DataFrame] | None = None) -> Tables:
    """Run the steps from ``start`` to ``stop``; ``save`` persists a table and returns what later steps read."""
    t = dict(tables)
    for name in ORDER[ORDER.index(start): ORDER.index(stop) + 1]:
        for k, df in STEPS[name](t, as_of).items():
            t[k] = save(k, df) if save else df
    return t
