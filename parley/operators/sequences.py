"""State sequences: transitions, graphs and n-gram patterns, on exploded states with lead()."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TERMINALS, rate_color, terminal_state


def _turn():
    return Window.partitionBy("conversation_id").orderBy("turn_index")


def state_sequences(signals: DataFrame, client_only: bool = False) -> DataFrame:
    """Each conversation's intents in order of turn."""
    some = signals.where("role = 'client'") if client_only else signals
    states = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "intent"))), lambda x: x["intent"])
    return some.groupBy("conversation_id").agg(states.alias("states"))


def transition_table(signals: DataFrame, convs: DataFrame, min_support: int = 5) -> DataFrame:
    """Occurrences of each step, the last one into CLOSED or LOST; prob is over all steps from a
    state, before those under min_support go."""
    both = signals.select("conversation_id", "turn_index", "intent").join(convs.select("conversation_id", "outcome", "converted"), "conversation_id")
    steps = both.select(F.col("intent").alias("from_state"), F.coalesce(F.lead("intent").over(_turn()), terminal_state(F.col("outcome"))).alias("to_state"), F.coalesce("converted", F.lit(False)).cast("int").alias("ok"))
    edges = steps.groupBy("from_state", "to_state").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    total = F.sum("n").over(Window.partitionBy("from_state"))
    out = edges.select("from_state", "to_state", "n", (F.col("ok") / F.col("n")).alias("conv_rate"), (1 - F.col("ok") / F.col("n")).alias("p_lost"), (F.col("n") / total).alias("prob"))
    return out.where(F.col("n") >= min_support)


def worst_transitions(table: DataFrame, n: int = 15) -> DataFrame:
    """Lowest-converting steps between states that are not terminal."""
    out = table.where(~F.col("to_state").isin(*TERMINALS)).withColumn("badness", (1 - F.col("conv_rate")) * F.col("n"))
    return out.orderBy("conv_rate", F.desc("n"), "from_state", "to_state").limit(n)


def _shown(table: DataFrame, max_edges: int) -> DataFrame:
    return table.orderBy(F.desc("n"), "from_state", "to_state").limit(max_edges)


def transition_edges(table: DataFrame, max_edges: int = 40) -> DataFrame:
    return _shown(table, max_edges).select("from_state", "to_state", F.round(1 + 4 * F.col("prob"), 6).alias("width"), F.concat(F.bround(F.col("prob") * 100, 0).cast("int"), F.lit("%")).alias("label"))


def transition_nodes(table: DataFrame, max_edges: int = 40) -> DataFrame:
    """States of the largest steps, coloured by the plain mean rate of the steps they begin."""
    top = _shown(table, max_edges)
    states = top.select(F.col("from_state").alias("state")).union(top.select("to_state")).distinct()
    rates = top.groupBy(F.col("from_state").alias("state")).agg(F.avg("conv_rate").alias("rate"))
    rate = F.coalesce("rate", F.lit(0.5))
    shape = F.when(F.col("state").isin(*TERMINALS), "doublecircle").otherwise("box")
    return states.join(rates, "state", "left").select("state", F.round(rate, 6).alias("rate"), rate_color(rate).alias("color"), shape.alias("shape"))


def dot(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as DOT text; at most max_edges rows and their states reach the driver."""
    lines = ["digraph conversation {", "  rankdir=LR;", "  node [style=filled];"]
    lines += [f'  "{r.state}" [fillcolor="{r.color}", shape={r.shape}];' for r in nodes.orderBy("state").collect()]
    lines += [f'  "{r.from_state}" -> "{r.to_state}" [penwidth={r.width:.1f}, label="{r.label}"];' for r in edges.orderBy("from_state", "to_state").collect()]
    return "\n".join([*lines, "}"])


def ngrams(signals: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(conversation_id, turn_index, pattern) for each run of low to high states."""
    ahead = [F.lead("intent", i).over(_turn()) for i in range(1, high)]
    rows = signals.select("conversation_id", "turn_index", F.array("intent", *ahead).alias("states"))
    # a run that a missing state cuts short is none
    runs = F.filter(F.array(*[F.slice("states", 1, n) for n in range(low, high + 1)]), lambda p: F.forall(p, lambda s: s.isNotNull()))
    return rows.select("conversation_id", "turn_index", F.explode(runs).alias("pattern"))


def lost_patterns(signals: DataFrame, convs: DataFrame, low: int = 2, high: int = 4, top: int = 15, support: int = 3) -> DataFrame:
    """Patterns by conversations that have them and do not convert, each counted once in each."""
    once = ngrams(signals, low, high).select("conversation_id", "pattern").distinct().join(convs.select("conversation_id", "converted"), "conversation_id")
    counts = once.groupBy("pattern").agg(F.count("*").alias("n"), F.avg(F.coalesce("converted", F.lit(False)).cast("double")).alias("conv_rate")).where(F.col("n") >= support)
    out = counts.select("pattern", F.size("pattern").alias("length"), "n", "conv_rate", (F.col("n") * (1 - F.col("conv_rate"))).alias("score"))
    return out.orderBy(F.desc(F.round("score", 6)), F.array_join("pattern", " ")).limit(top)


def transition_examples(signals: DataFrame, first: str, then: str, n: int = 3) -> DataFrame:
    """The first place of the step in each conversation, of n conversations."""
    pair = signals.select("conversation_id", "intent", "turn_index", F.lead("intent").over(_turn()).alias("next"), F.lead("turn_index").over(_turn()).alias("to_turn"))
    found = pair.where((F.col("intent") == first) & (F.col("next") == then)).groupBy("conversation_id").agg(F.min("turn_index").alias("from_turn"), F.min_by("to_turn", "turn_index").alias("to_turn"))
    return found.orderBy("conversation_id").limit(n)


def transcripts(examples: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns of the conversations that `examples` names, each once."""
    named = examples.select("conversation_id").distinct()
    return turns.join(named, "conversation_id", "left_semi").select("conversation_id", "turn_index", "role", "raw_text")


def pattern_examples(signals: DataFrame, convs: DataFrame, patterns: DataFrame, n: int = 2) -> DataFrame:
    """n lost conversations for each pattern. Patterns are joined before the rows are made distinct;
    Spark broadcasts them where they are few, so that only their runs are shuffled."""
    lost = convs.where("not converted").select("conversation_id")
    hits = ngrams(signals).join(patterns.select("pattern"), "pattern").select("pattern", "conversation_id").distinct().join(lost, "conversation_id", "left_semi")
    own = Window.partitionBy("pattern").orderBy("conversation_id")
    return hits.withColumn("r", F.row_number().over(own)).where(F.col("r") <= n).select(F.array_join("pattern", " > ").alias("pattern"), "conversation_id", "r")
