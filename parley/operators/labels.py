"""Turn labels: which turns to label, labelling them, reading answers, folding rare intents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CLIENT_INTENTS, canonical_intent, clamp, strip

#: Characters of a turn that a labeler is given.
LABELER_CHARS = 2000


def turns_to_label(turns: DataFrame, labels: DataFrame | None = None, min_client: int = 2, first: int | None = None) -> DataFrame:
    """Client and agent turns with text, of conversations with enough client turns, that have no
    label yet; in order only where the `first` so many are asked. The anti join is on the
    conversation, so all of it shares one partitioning."""
    said = turns.where(strip(F.coalesce("raw_text", F.lit(""))) != "")
    enough = said.where("role = 'client'").groupBy("conversation_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_client)
    out = said.where("role in ('client', 'agent')").join(enough, "conversation_id", "left_semi")
    if labels is not None:
        out = out.join(labels.select("conversation_id", "turn_index"), ["conversation_id", "turn_index"], "left_anti")
    return out if first is None else out.orderBy("conversation_id", "turn_index").limit(first)


def label_turns(turns: DataFrame, labeler: Callable[[list[tuple[str, str]]], list[str | None]]) -> DataFrame:
    """turns with `raw`, the labeler's JSON for each (role, text); turns it returns null for are
    left out and stay unlabelled. Equal (role, text) pairs are asked once."""
    asked = turns.select("role", F.substring("raw_text", 1, LABELER_CHARS).alias("text")).distinct()

    def ask(batches):
        for rows in batches:
            rows["raw"] = pd.Series(labeler(list(zip(rows["role"], rows["text"], strict=True))), dtype=object, index=rows.index)
            yield rows

    answers = asked.mapInPandas(ask, "role string, text string, raw string").where("raw is not null")
    return turns.withColumn("text", F.substring("raw_text", 1, LABELER_CHARS)).join(answers, ["role", "text"]).drop("text")


def rule_label(role: Column, text: Column) -> Column:
    """Keyword rules as a labeler that needs no service."""
    t = F.lower(text)
    client = F.when(t.rlike(r"\?|how much|price|cost"), "price_inquiry").when(t.rlike(r"hello|hi |good (day|morning)"), "greeting").when(t.rlike(r"buy|order"), "ready_to_buy").when(t.rlike(r"[0-9]{6,}|@"), "shares_contact").otherwise("other")
    agent = F.when(t.rlike(r"[0-9]+ ?(usd|eur|\$|€)"), "gave_price").when(t.rlike(r"\?"), "asked_for_contact").when(F.length(t) > 40, "provided_info").otherwise("other")
    return F.when(role == "client", client).otherwise(agent)


def parse_label(df: DataFrame, raw: str = "raw", role: str = "role") -> DataFrame:
    """df with intent, intent_confidence, sentiment, sentiment_confidence from a JSON answer.
    What is no JSON object is ('other', 0, null, 0)."""
    df = df.withColumn("_v", F.try_parse_json(raw)).withColumn("_v", F.when(F.expr("schema_of_variant(_v) like 'OBJECT%'"), F.col("_v")))
    get = lambda path: F.try_variant_get("_v", f"$.{path}", "string")
    agent = F.col(role) == "agent"
    ok = F.col("_v").isNotNull()
    return df.withColumns({
        "intent": F.when(ok, canonical_intent(F.when(agent, get("act")).otherwise(get("intent")))).otherwise("other"),
        "intent_confidence": F.when(ok, clamp(F.when(agent, get("confidence")).otherwise(get("intent_confidence")), 0, 1)).otherwise(0.0),
        "sentiment": F.when(ok & ~agent, clamp(get("sentiment"), -1, 1, None)),
        "sentiment_confidence": F.when(ok & ~agent, clamp(get("sentiment_confidence"), 0, 1)).otherwise(0.0),
    }).drop("_v")


def discovered_intents(signals: DataFrame, least: int = 8) -> DataFrame:
    """signals with raw_intent, intent and discovered: client intents outside the taxonomy are
    kept and flagged from `least` on, and else become 'other'; derived, so in any order of runs."""
    off = (F.col("role") == "client") & ~F.col("intent").isin(*CLIENT_INTENTS)
    counts = signals.where(off).groupBy(F.col("intent").alias("_i")).agg(F.count("*").alias("_n"))
    out = signals.join(counts, off & (F.col("intent") == F.col("_i")), "left")
    often = off & (F.coalesce("_n", F.lit(0)) >= least)
    return out.select(*[c for c in signals.columns if c != "intent"], F.col("intent").alias("raw_intent"), F.when(off & ~often, "other").otherwise(F.col("intent")).alias("intent"), often.alias("discovered"))


def fully_labeled(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Conversations with as many labels as turns that should have one."""
    expected = turns_to_label(turns).groupBy("conversation_id").agg(F.count("*").alias("n_expected"))
    labelled = labels.groupBy("conversation_id").agg(F.count("*").alias("n_labeled"))
    return expected.join(labelled, "conversation_id").where("n_labeled >= n_expected")


def upsert(old: DataFrame, new: DataFrame, key: str = "turn_id", order: str = "batch", reset: bool = False) -> DataFrame:
    """The latest row of each key, of new rows alone with `reset`. Of rows of one key and `order` the
    greatest by the other columns stays."""
    own = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in new.columns if c not in (key, order)])
    return (new if reset else old.unionByName(new)).withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")
