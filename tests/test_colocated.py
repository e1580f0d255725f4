"""Tables bucketed by conversation: the same results as without, and no shuffle by conversation."""

import re

import pytest

from parley.operators import labels, sentiment, sequences
from parley.sources import colocated

DATA = "conversation_id string, turn_index int, turn_id string, role string, raw_text string, intent string, sentiment double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty conversations, one of them with a third of all turns."""
    rows = []
    for c in range(40):
        for t in range(90 if c == 7 else 1 + c % 9):
            rows.append((f"c{c}", t, f"c{c}:{t}", "client" if t % 2 == 0 else "agent", f"text {t}", ("ask", "doubt", "pay")[(c + t) % 3], ((c * 7 + t * 3) % 11 - 5) / 5))
    signals = spark.createDataFrame(rows, DATA)
    convs = spark.createDataFrame([(f"c{c}", "closed" if c % 3 else "lost", c % 3 != 0) for c in range(40)], "conversation_id string, outcome string, converted boolean")
    done = signals.where("turn_index % 4 = 0 or conversation_id < 'c2'").select("conversation_id", "turn_index")
    plain = {"signals": signals, "convs": convs, "done": done}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    made = {k: colocated.write(df, f"co_{k}", str(tmp_path_factory.mktemp(k) / "t"), 6) for k, df in plain.items()}
    yield plain, made
    for k in plain:
        spark.sql(f"drop table if exists co_{k}")
    for k, v in kept.items():
        spark.conf.set(k, v)


JOBS = {
    "turns to label": lambda t: labels.turns_to_label(t["signals"], t["done"]),
    "fully labelled": lambda t: labels.fully_labeled(t["signals"], t["done"]),
    "transitions": lambda t: sequences.transition_table(t["signals"], t["convs"], 1),
    "trajectory": lambda t: sentiment.trajectory_features(t["signals"]),
    "transition examples": lambda t: sequences.transition_examples(t["signals"], "ask", "doubt"),
}


def by_conversation(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(conversation_id", plan)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_no_shuffle_by_conversation(tables, name):
    plain, made = tables
    far, near = JOBS[name](plain), JOBS[name](made)
    assert by_conversation(far) and not by_conversation(near)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(near) == rows(far) and rows(far)


def test_attach(spark, tables, tmp_path):
    plain, _ = tables
    path = str(tmp_path / "again")
    colocated.write(plain["signals"], "co_first", path, 4)
    spark.sql("drop table co_first")  # its files stay, as they are outside the warehouse
    again = colocated.attach(spark, "co_again", path, 4)
    assert sorted(again.collect()) == sorted(plain["signals"].collect())
    assert not by_conversation(again.groupBy("conversation_id").count())
    spark.sql("drop table co_again")


def test_empty_null_keys_and_sizes(spark, tables, tmp_path):
    plain, _ = tables
    none = colocated.write(plain["convs"].limit(0), "co_none", str(tmp_path / "none"), 3)
    assert none.collect() == [] and none.columns == plain["convs"].columns
    odd = spark.createDataFrame([(None, "a", True), ("x", None, None), ("x", None, None)], plain["convs"].schema)
    made = colocated.write(odd, "co_odd", str(tmp_path / "odd"), 3)
    assert sorted(map(str, made.collect())) == sorted(map(str, odd.collect()))
    sizes = colocated.keys_by_bucket(plain["signals"], 6).collect()
    assert sum(r.n_rows for r in sizes) == plain["signals"].count() and sum(r.n_keys for r in sizes) == 40 and max(r.largest for r in sizes) == 90
    for t in ("co_none", "co_odd"):
        spark.sql(f"drop table {t}")
