"""Small cases with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from parley.functions.columns import canonical_intent, terminal_state, worth_embedding
from parley.functions.stats import correlation_p
from parley.operators import annotations, archetypes, ingest, labels, metrics, sentiment, sequences, topics
from parley.sources import tables
from parley.streaming import resume

SIGNALS = "conversation_id string, turn_index int, role string, intent string, sentiment double"
CONVS = "conversation_id string, converted boolean, outcome string"


def signals(spark, sequences_):
    return spark.createDataFrame([(c, i, "client", s, None) for c, states in sequences_.items() for i, s in enumerate(states)], SIGNALS)


def test_transitions(spark):
    convs = spark.createDataFrame([("a", True, "closed"), ("b", False, "lost")], CONVS)
    table = sequences.transition_table(signals(spark, {"a": ["greeting", "price_inquiry"], "b": ["greeting", "objection_price"], "c": ["greeting"]}), convs, 1)
    rows = {(r.from_state, r.to_state): r for r in table.collect()}
    assert rows["greeting", "price_inquiry"].n == 1 and rows["objection_price", "LOST"].conv_rate == 0 and len(rows) == 4
    nodes, edges = sequences.transition_nodes(table), sequences.transition_edges(table)
    assert '"greeting" -> "price_inquiry"' in sequences.dot(nodes, edges)


def test_worst(spark):
    both = {f"l{i}": ["greeting", "objection_price"] for i in range(5)} | {f"w{i}": ["greeting", "ready_to_buy"] for i in range(5)}
    convs = spark.createDataFrame([(c, c[0] == "w", "closed" if c[0] == "w" else "lost") for c in both], CONVS)
    worst = sequences.worst_transitions(sequences.transition_table(signals(spark, both), convs)).collect()
    assert (worst[0].from_state, worst[0].to_state) == ("greeting", "objection_price")
    assert all(r.to_state not in ("CLOSED", "LOST") for r in worst)


def test_patterns_and_archetypes(spark):
    both = {f"l{i}": ["greeting", "objection_price", "request_human"] for i in range(10)} | {f"w{i}": ["greeting", "ready_to_buy", "shares_contact"] for i in range(10)}
    convs = spark.createDataFrame([(c, c[0] == "w", "closed" if c[0] == "w" else "lost") for c in both], CONVS)
    s = signals(spark, both)
    found = {tuple(r.pattern): r for r in sequences.lost_patterns(s, convs).collect()}
    assert found["objection_price", "request_human"].n == 10 and found["objection_price", "request_human"].conv_rate == 0
    got = archetypes.archetypes(s)
    summary = archetypes.archetype_summary(got, convs, s).collect()
    assert sum(r["size"] for r in summary) == 20
    assert {r.conv_rate for r in summary} <= {0.0, 1.0}


@pytest.mark.parametrize("values,final,low,drop,n,run", [([0.5, 0.0, -0.5], -0.5, -0.5, 1.0, 3, 1), ([0.2, -0.1, -0.2, -0.3, 0.1], 0.1, -0.3, 0.5, 5, 3)])
def test_trajectory(spark, values, final, low, drop, n, run):
    df = spark.createDataFrame([("a", i, "client", "x", v) for i, v in enumerate(values)], SIGNALS)
    r = sentiment.trajectory_features(df).first()
    assert (r.final, r["min"], round(r.max_drop, 9), r.n_client_turns, r.neg_run_len) == (final, low, drop, n, run)
    assert r.slope < 0 if n == 3 else True


def test_correlations(spark):
    rows = [(c, 0.1, f, 0.0, 0.0, s, 0, 0.0, 3) for c, f, s in (("a", 0.8, 0.1), ("b", 0.6, 0.2), ("c", -0.5, 0.15), ("d", -0.7, 0.1))]
    features = spark.createDataFrame(rows, ["conversation_id", *sentiment.FEATURES])
    convs = spark.createDataFrame([("a", True, ""), ("b", True, ""), ("c", False, ""), ("d", False, "")], CONVS)
    got = {r.feature: r for r in sentiment.correlations(features, convs).collect()}
    assert got["final"].r > 0.9 and got["mean"].r == 0 and got["mean"].p_value == 1
    assert math.isnan(sentiment.logistic_auc(features, convs).first().auc)


def test_p_values():
    assert abs(correlation_p(0.5, 12) - 0.0978) < 1e-3
    assert correlation_p(1.0, 9) == 0 and correlation_p(0.0, 9) == pytest.approx(1)
    assert abs(correlation_p(0.632, 10) - 0.05) < 1e-3


def test_labels(spark):
    raw = [('{"intent": "Price Inquiry", "intent_confidence": 0.9, "sentiment": 5, "sentiment_confidence": "0.5"}', "client"), ('{"act": "gave_price", "confidence": 0.7}', "agent"), ("not json", "client"), ("[1]", "agent"), ('{"intent": null, "sentiment": "x"}', "client"), (None, "client")]
    got = [tuple(r)[2:] for r in labels.parse_label(spark.createDataFrame(raw, "raw string, role string")).collect()]
    assert got == [("price_inquiry", 0.9, 1.0, 0.5), ("gave_price", 0.7, None, 0.0), ("other", 0.0, None, 0.0), ("other", 0.0, None, 0.0), ("other", 0.0, None, 0.0), ("other", 0.0, None, 0.0)]


def test_taxonomy(spark):
    df = spark.createDataFrame([("price_inquiry",), (" Price Inquiry ",), ("",), (None,), ("wants_refund",)], "x string")
    assert [r[0] for r in df.select(canonical_intent(F.col("x"))).collect()] == ["price_inquiry", "price_inquiry", "other", "other", "wants_refund"]
    df = spark.createDataFrame([("closed",), ("human-closed",), ("lost",), ("abandoned",), (None,)], "x string")
    assert [r[0] for r in df.select(terminal_state(F.col("x"))).collect()] == ["CLOSED", "CLOSED", "LOST", "LOST", "LOST"]
    df = spark.createDataFrame([("ok",), ("+7 (700) 12",), ("http://a.b",), ("++++",), ("hello",), ("٣٤٥٦",)], "x string")
    assert [r[0] for r in df.select(worth_embedding(F.col("x"))).collect()] == [False, False, False, True, True, False]


def chat(*messages):
    return json.dumps(list(messages), ensure_ascii=False)


def test_parser_edges(spark):
    user, bot = {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}
    texts = {
        "empty": "[]", "null": "null", "bad": "not json", "object": json.dumps(user), "none": None, "mixed": chat(user, "x", 3, user),
        "content": chat({"role": "user", "content": None}, {"role": "user"}, {"role": "user", "content": 5}, {"role": "user", "content": "\t  a \n"}),
        "closed": chat(user, {"role": "tool", "tool_result": '{"result": "success"}'}), "closed2": chat(user, {"role": "tool", "tool_result": '{"result":"success"}'}),
        "objecttool": chat(user, user, {"role": "tool", "tool_result": {"result": "success"}}), "ru": chat(user, {"role": "tool", "tool_result": {"x": "Успешно"}}),
        "taken": chat(user, {"role": "info", "content": "-- PAUSE_DIALOG_OPERATOR_INTERVENTION --"}), "marker": chat(user, user, {"role": "user", "content": "PAUSE_DIALOG_OPERATOR_INTERVENTION"}),
        "manager": chat(user, bot | {"type": "manager"}), "ai": chat(user, bot, user),
    }
    raw = spark.createDataFrame([(k, None, i, v) for i, (k, v) in enumerate(texts.items())], "chat_id string, user_id string, ordinal long, messages string")
    parsed = ingest.parse_messages(raw).withColumn("conversation_id", ingest.conversation_id())
    got = {r.conversation_id: r for r in parsed.select("conversation_id", F.size("msgs").alias("n"), ingest.outcome().alias("o"), ingest.is_ai().alias("ai"), ingest.has_operator_intervention().alias("op")).collect()}
    assert [got[k].n for k in ("empty", "null", "bad", "object", "none", "mixed")] == [0, 0, 0, 0, 0, 4]
    assert {k: got[k].o for k in ("closed", "closed2", "objecttool", "ru", "taken", "marker", "ai", "empty")} == {"closed": "closed", "closed2": "closed", "objecttool": "lost", "ru": "closed", "taken": "human-closed", "marker": "lost", "ai": "lost", "empty": "abandoned"}
    assert got["ai"].ai and not got["manager"].ai and got["marker"].op and not got["taken"].op
    turns = {(r.conversation_id, r.turn_index): r.raw_text for r in ingest.turns(parsed).collect()}
    assert [turns["content", i] for i in range(4)] == ["", "", "5", "a"] and ("mixed", 1) not in turns and turns["mixed", 3] == "hi"


def test_ids(spark):
    raw = spark.createDataFrame([(None, "u", 1), ("", "", 2), ("c", "u", 3)], "chat_id string, user_id string, ordinal long")
    assert [r[0] for r in raw.select(ingest.conversation_id()).collect()] == ["u", "2", "c"]


TIMES = {
    "2026-01-01 10:00:00.123": "10:00:00.123", "2026-01-01 10:00:00+00:00": "10:00:00", "2026-01-01T10:00:00.5Z": "10:00:00.5", "2026-01-01 10:00": "10:00:00",
    "2026-01-01T12:30:00+02:30": "10:00:00", "2026-01-01 05:00:00 -0500": "10:00:00", "2026/01/01 10:00:05": "10:00:05", "01.01.2026 10:00": "10:00:00", "1/1/2026 10:00 AM": "10:00:00",
    "Jan 1, 2026 10:00:00 UTC": "10:00:00", "Thu, 1 Jan 2026 10:00:00 +0000": "10:00:00", "2026-01-01": "00:00:00", " 2026-01-01 10:00:00 ": "10:00:00", "20:26": None, "soon": None, "": None, None: None, "2026-13-01": None,
}


def test_created(spark):
    df = spark.createDataFrame([(t, n, 1) for n, t in enumerate(TIMES)], "created string, n int, x int")
    got = {r.created: r.at for r in df.select("created", ingest.created(F.col("created")).cast("string").alias("at")).collect()}
    assert got == {t: None if v is None else f"2026-01-01 {v}" for t, v in TIMES.items()}
    assert tuple(ingest.created_report(df).first()) == (len(TIMES), 2, 3)


#: Forms, with month first and with day first where that differs.
DATES = {
    "20250403": "2025-04-03 00:00:00", "20250403T100000": "2025-04-03 10:00:00", "20250403T1030": "2025-04-03 10:30:00", "20250403 100000Z": "2025-04-03 10:00:00", "2025-04-03 5:00 PM": "2025-04-03 17:00:00",
    "Apr 3 2025 5PM": "2025-04-03 17:00:00", "3 April 2025 12:05 am": "2025-04-03 00:05:00", "April 3, 2025": "2025-04-03 00:00:00", "03-Apr-2025 07:08": "2025-04-03 07:08:00", "Wednesday, 3 Sept 2025": "2025-09-03 00:00:00",
    "03-04-2025": ("2025-03-04 00:00:00", "2025-04-03 00:00:00"), "03.04.2025": ("2025-03-04 00:00:00", "2025-04-03 00:00:00"), "3/4/2025 7:08:09": ("2025-03-04 07:08:09", "2025-04-03 07:08:09"), "13/04/2025": "2025-04-13 00:00:00", "04/13/2025 23:59": "2025-04-13 23:59:00",
    "2025": "2025-01-01 00:00:00", "2025-04": "2025-04-01 00:00:00", "2025-04-03T10:00:00.123456+0300": "2025-04-03 07:00:00.123456", "4/3/2025 10:00 -05:00": ("2025-04-03 15:00:00", "2025-03-04 15:00:00"), "2025-04-03 17": None,
    "13/13/2025": None, "2025-02-30": None, "2025-04-03 13:00 PM": None, "2025-04-03 25:00": None, "Abc 3 2025": None, "3": None, "12-04": None, "1234567": None,
}


def test_created_forms(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    for day_first in (False, True):
        got = {r.t: r.at for r in df.select("t", ingest.created(F.col("t"), day_first).cast("string").alias("at")).collect()}
        assert got == {t: v[day_first] if isinstance(v, tuple) else v for t, v in DATES.items()}


def test_labeler_chars(spark):
    turns = spark.createDataFrame([("a", 0, "client", "x" * 5000), ("a", 1, "client", "short")], "conversation_id string, turn_index int, role string, raw_text string")
    got = labels.label_turns(turns, lambda asked: [str(len(t)) for _, t in asked]).collect()
    assert sorted((r.raw, len(r.raw_text)) for r in got) == [("2000", 5000), ("5", 5)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "turn_id string, intent string, batch int")
    new = spark.createDataFrame([("a", "y", 2), ("a", "z", 2)], old.schema)
    assert sorted(map(tuple, labels.upsert(old, new).collect())) == [("a", "z", 2), ("b", "x", 1)]
    assert [tuple(r) for r in labels.upsert(old, new, reset=True).collect()] == [("a", "z", 2)]


def test_folds(spark):
    rows = spark.createDataFrame([(str(i), float(i % 4 == 0)) for i in range(203)], "conversation_id string, y double")
    got = sentiment.stratified(rows, 5).groupBy("y", "fold").count().collect()
    for y in (0.0, 1.0):
        n = [r["count"] for r in got if r.y == y]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_adjusted_p(spark):
    rng = random.Random(2)
    rows = [(str(i), *[rng.gauss(0.4 * k * (i % 2), 1) for k in range(8)]) for i in range(60)]
    convs = spark.createDataFrame([(str(i), i % 2 == 1, "") for i in range(60)], CONVS)
    got = sorted(sentiment.correlations(spark.createDataFrame(rows, ["conversation_id", *sentiment.FEATURES]), convs).collect(), key=lambda r: r.p_value)
    assert all(abs(r.p_value - correlation_p(r.r, 60)) < 1e-9 for r in got)
    for k, r in enumerate(got):
        assert r.p_adj == pytest.approx(min(1, min(x.p_value * 8 / (j + 1) for j, x in enumerate(got) if j >= k)))


def test_tfidf_vectors(spark):
    s = signals(spark, {"a": ["x", "y", "x"], "b": ["x"], "c": ["y", "y"]})
    want = {}
    for r in archetypes.intent_tfidf(s).collect():
        want.setdefault(r.conversation_id, []).append(r.weight)
    for r in archetypes.tfidf_vectors(s).collect():
        assert sorted(v for v in r.features.toArray() if v) == pytest.approx(sorted(want[r.conversation_id]))


def test_reduce_narrow(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(i * i)]) for i in range(9)], "id long, embedding array<double>")
    assert all(len(r.reduced) == 3 for r in topics.reduce(df, 20).collect())


def test_stable_ids(spark):
    one = spark.createDataFrame([("b:1", 7), ("a:2", 7), ("c:1", 9), ("d:1", None)], "turn_id string, cluster long")
    points = one.select("turn_id", F.lit(0.5).alias("x"), F.lit(1.5).alias("y"))
    got = {r.turn_id: r.cluster_id for r in topics.turn_coords(points, one, "faq").collect()}
    again = {r.turn_id: r.cluster_id for r in topics.turn_coords(points, one.withColumn("cluster", F.col("cluster") + 100), "faq").collect()}
    other = {r.turn_id: r.cluster_id for r in topics.turn_coords(points, one, "failure").collect()}
    assert got == again and got["a:2"] == got["b:1"] != got["c:1"] and got["d:1"] is None and other["a:2"] != got["a:2"]


def test_weeks(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-20",)], "d string").select(F.to_timestamp("d").alias("created"), F.lit(True).alias("converted"))
    got = [(str(r.period), r.total, r.label) for r in metrics.by_period(df, "weekly").orderBy("period").collect()]
    assert got == [("2024-01-01", 1, "Week of Jan 01"), ("2024-01-08", 1, "Week of Jan 08"), ("2024-01-15", 0, "Week of Jan 15"), ("2024-01-22", 1, "Week of Jan 22")]


def test_density(spark):
    rng = random.Random(4)
    points = [[10.0 * (k == d) + rng.gauss(0, 0.05) for d in range(8)] for k in range(3) for _ in range(20)]
    points += [[50.0 + 30 * k + 7 * d for d in range(8)] for k in range(5)] + [points[0]] * 3
    df = spark.createDataFrame(list(enumerate(points)), "id long, reduced array<double>")
    got = topics.density_clusters(df, 1.0).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got if r.cluster is not None) == [20, 20, 23]
    assert [r["count"] for r in got if r.cluster is None] == [5]


def test_annotations(spark):
    rows = [("a", "1", 1, '["x","y"]'), ("a", "2", 2, "z"), ("b", "3", 1, "[]"), ("b", "4", 2, None)]
    df = spark.createDataFrame(rows, "conversation_id string, id string, annotated_at long, failure_type string")
    assert {r.tag: r.n for r in annotations.tag_distribution(df).collect()} == {"x": 1, "y": 1, "z": 1}
    assert {r.tag for r in annotations.tag_distribution(df, latest_only=True).collect()} == {"z"}
    assert [r.tags for r in annotations.merge_tags(df, ["x"], "y").collect()] == [["y"]]
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    assert [r.name for r in annotations.merged_tag_list(names, ["x"], "y").collect()] == ["y"]


def test_sources(spark, tmp_path):
    text = chat({"role": "user", "content": 'say "hi"\nthere'}, {"role": "assistant", "content": "ok"})
    quoted = text.replace('"', '""')
    (tmp_path / "in.csv").write_text(f'chat_id,user_id,user_name,from_messenger,created,messages\nc1,u1,n,web,2024-01-01,"{quoted}"\n', encoding="utf-8")
    raw = tables.with_ordinal(tables.read_transcripts(spark, str(tmp_path / "in.csv")))
    parsed = ingest.parse_messages(raw).withColumn("conversation_id", ingest.conversation_id())
    assert ingest.conversations(parsed).first().turn_count == 2
    tables.export_json(ingest.merged_user_messages(parsed), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().content == 'say "hi"\nthere'
    one = spark.createDataFrame([("faq", 1), ("failure", 2)], "cluster_type string, n int")
    tables.write_table(one, str(tmp_path / "t"), partition="cluster_type")
    tables.write_table(spark.createDataFrame([("faq", 9)], "cluster_type string, n int"), str(tmp_path / "t"), partition="cluster_type")
    assert {(r.cluster_type, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("faq", 9), ("failure", 2)}


def test_resume(spark, tmp_path):
    schema = "chat_id string, user_id string, from_messenger string, created timestamp, messages string, ordinal long"
    text = chat({"role": "user", "content": "a"}, {"role": "assistant", "content": "b"})
    for ids in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(c, None, "web", None, text, i) for i, c in enumerate(ids)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        resume.load_new(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "c"))
    assert sorted(r.conversation_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]


def test_plan_has_one_exchange(spark):
    df = spark.createDataFrame([("a", 0, "client", "x", 0.1)], SIGNALS)
    plan = sentiment.trajectory_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan
