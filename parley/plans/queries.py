"""Every registered query of the library, each beside its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_intent, worth_embedding
from ..operators import annotations as notes
from ..operators import archetypes, hierarchy, ingest, labels, layout, listing, metrics, sentiment, sequences, topics
from ..sources import colocated, keyed, scratch, tables, transcripts
from ..streaming import labelling
from .fixtures import Inputs, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CREATED = "timestamp '2024-01-01' + to_hours(cast(conv_id * 7 as int))"


def query(sql: str | None = None, *bindings: str):
    def register(f: Callable[[Inputs], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (duck(*bindings) if bindings else "") + sql
        return f

    return register


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- parsing and loading -----------------------------------------------------------------------

ALL_TURNS = """
rows_ as (
  select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as i, role, case when role = 'assistant' and conv_id % 11 = 0 then 'manager' end as kind, text from conversations),
sizes as (select conv_id, count(*) as n from conversations group by conv_id),
raw_turns as (
  select * from rows_
  union all select conv_id, n + k, case k when 0 then 'tool_calls' else 'tool' end, null, '' from sizes cross join (select unnest([0, 1]) as k) where conv_id % 3 = 0
  union all select conv_id, n + case when conv_id % 3 = 0 then 2 else 0 end, 'info', null, 'PAUSE_DIALOG_OPERATOR_INTERVENTION' from sizes where conv_id % 7 = 3),
norm as (select *, case when role = 'user' then 'client' when role = 'assistant' then case when kind = 'manager' then 'human' else 'agent' end when role in ('tool_calls', 'tool') then 'tool' else role end as r from raw_turns)
"""


@query(f"with {ALL_TURNS} select cast(conv_id as varchar) as conversation_id, count(*) as n_elements, count(*) as n_objects from norm group by conv_id")
def parse_messages(x):
    objects = F.size(F.filter("msgs", lambda m: m["is_object"]))
    return x.parsed.select("conversation_id", F.size("msgs").cast("long").alias("n_elements"), objects.cast("long").alias("n_objects"))


@query(f"with {ALL_TURNS} select cast(conv_id as varchar) as conversation_id, i as turn_index, conv_id || ':' || i as turn_id, r as role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as raw_text from norm")
def turns(x):
    return ingest.turns(x.parsed).withColumn("turn_index", F.col("turn_index").cast("long"))


@query(f"with {ALL_TURNS} select role as raw_role, r as role, count(*) as n from norm group by all")
def normalize_role(x):
    m = F.col("m")
    rows = x.parsed.select(F.explode("msgs").alias("m"))
    return rows.groupBy(m["role"].alias("raw_role"), ingest.normalize_role(m["role"], m["type"]).alias("role")).agg(F.count("*").alias("n"))


@query("select distinct conv_id as ordinal, case when conv_id % 10 = 0 then cast(conv_id as varchar) when conv_id % 5 = 0 then 'user_' || conv_id % 37 else cast(conv_id as varchar) end as conversation_id from conversations")
def conversation_id(x):
    chat = F.when(F.col("ordinal") % 10 == 0, "").when(F.col("ordinal") % 5 == 0, None).otherwise(F.col("chat_id"))
    return x.raw.withColumn("chat_id", chat).withColumn("user_id", F.when(F.col("ordinal") % 10 != 0, F.col("user_id"))).select("ordinal", ingest.conversation_id().alias("conversation_id"))


@query("select conversation_id, is_ai from convs", "convs")
def is_ai(x):
    return x.parsed.select("conversation_id", ingest.is_ai().alias("is_ai"))


@query("select conversation_id, conv_id % 7 = 3 as operator_intervention from convs", "convs")
def operator_intervention(x):
    return x.parsed.select("conversation_id", ingest.has_operator_intervention().alias("operator_intervention"))


@query("select cast(conv_id as varchar) as conversation_id, count(*) filter (role = 'user') = 1 and max(length(trim(text))) filter (role = 'user') < 2 as low_quality from (select conv_id, role, case when conv_id % 2 = 0 then left(text, 1) else text end as text from conversations) group by conv_id")
def low_quality(x):
    short = F.transform("msgs", lambda m: m.withField("content", F.left(m["content"], F.lit(1))))
    parsed = x.parsed.withColumn("msgs", F.when(F.col("ordinal") % 2 == 0, short).otherwise(F.col("msgs")))
    return parsed.select("conversation_id", ingest.is_low_quality().alias("low_quality"))


@query("select conversation_id, outcome from convs", "convs")
def outcome(x):
    return x.parsed.select("conversation_id", ingest.outcome().alias("outcome"))


DROP_OFF = f", {ALL_TURNS}, drops as (select conv_id, max(i) as drop_off_turn from rows_ where role = 'user' group by conv_id)"


@query(f"{DROP_OFF} select conversation_id, cast(case when not converted then drop_off_turn end as double) as drop_off_turn from convs left join drops using (conv_id)", "convs")
def drop_off_turn(x):
    return x.parsed.withColumn("outcome", ingest.outcome()).select("conversation_id", ingest.drop_off_turn().cast("double").alias("drop_off_turn"))


@query(
    f"{DROP_OFF} select conversation_id, outcome, turn_count, user_turn_count, cast(case when not converted then drop_off_turn end as double) as drop_off_turn, outcome = 'human-closed' as intervention_flag, is_ai as is_ai_conversation, platform, {CREATED} as created, converted, outcome = 'closed' as ai_closed from convs left join drops using (conv_id) where is_ai",
    "convs",
)
def conversations(x):
    out = ingest.conversations(x.parsed).withColumns({c: F.col(c).cast("long") for c in ("turn_count", "user_turn_count")})
    return out.withColumn("drop_off_turn", F.col("drop_off_turn").cast("double"))  # so that nulls compare alike


@query("select cast(conv_id as varchar) as conversation_id, platform from convs where conv_id % 2 = 1", "convs")
def ingest_incremental(x):
    first = x.raw.withColumn("conversation_id", ingest.conversation_id())
    again = first.withColumns({"ordinal": F.col("ordinal") + 1_000_000_000, "from_messenger": F.lit("again")})
    loaded = first.where("ordinal % 2 = 0").select("conversation_id")
    return ingest.new_only(first.unionByName(again), loaded).select("conversation_id", F.col("from_messenger").alias("platform"))


@query("select conversation_id, outcome, turn_count, rank() over (order by conversation_id) - 1 as ordinal from convs", "convs")
def transcripts_from_csv(x):
    """Transcripts written as CSV files and read by ranges; places follow the files and the records in them."""
    path = scratch.folder(x.spark)
    raw = x.raw.select("chat_id", "user_id", "user_name", "from_messenger", F.col("created").cast("string").alias("created"), "messages")
    raw.repartitionByRange("chat_id").sortWithinPartitions("chat_id").write.options(header=True, quoteAll=True, escape='"').csv(path)
    parsed = ingest.parse_messages(transcripts.read_split(x.spark, f"{path}/*.csv"))
    out = ingest.conversations(parsed.withColumn("conversation_id", ingest.conversation_id()), ai_only=False)
    places = parsed.select(ingest.conversation_id().alias("conversation_id"), "ordinal")
    return out.join(places, "conversation_id").select("conversation_id", "outcome", F.col("turn_count").cast("long").alias("turn_count"), "ordinal")


@query("select turn_id, cluster_id, 'failure' as cluster_type from members union all select turn_id, cluster_id + 10, 'faq' from members where cluster_id is not null", "members")
def clusters_replaced(x):
    """The clusters of one type replaced in a stored table, those of the other kept."""
    path = scratch.folder(x.spark)
    first = x.members.select("turn_id", "cluster_id", F.explode(F.array(F.lit("faq"), F.lit("failure"))).alias("cluster_type"))
    tables.write_table(first, path, partition="cluster_type")
    again = x.members.where("cluster_id is not null").select("turn_id", (F.col("cluster_id") + 10).alias("cluster_id"), F.lit("faq").alias("cluster_type"))
    tables.write_table(again, path, partition="cluster_type")
    return x.spark.read.parquet(path).select("turn_id", "cluster_id", "cluster_type")


@query("select turn_id || ':failure' as member, turn_id, cluster_id, 'failure' as cluster_type from members union all select turn_id || ':faq', turn_id, cluster_id + 10, 'faq' from members where cluster_id is not null", "members")
def clusters_merged(x):
    """As clusters_replaced, in a table kept by key: the other type's rows and the new ones become visible at once."""
    path, kind = scratch.folder(x.spark), F.lit("faq").alias("cluster_type")
    keyed_by = lambda df: df.withColumn("member", F.concat_ws(":", "turn_id", "cluster_type"))
    first = x.members.select("turn_id", "cluster_id", F.explode(F.array(F.lit("faq"), F.lit("failure"))).alias("cluster_type"))
    again = x.members.where("cluster_id is not null").select("turn_id", (F.col("cluster_id") + 10).alias("cluster_id"), kind)
    keyed.merge(path, keyed_by(first), "member")
    keyed.merge(path, keyed_by(again), "member", instead_of=F.col("cluster_type") == "faq")
    return keyed.read(x.spark, path)


@query("select turn_id, raw_text from members", "members")
def json_export(x):
    path = scratch.folder(x.spark)
    tables.export_json(x.members.select("turn_id", "raw_text"), path)
    return x.spark.read.schema("turn_id string, raw_text string").json(path)


@query("select event_id, date_trunc('second', ts) as created from events")
def created_norm(x):
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd.MM.yyyy HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", forms[0])).when(F.col("event_id") % 3 == 1, F.date_format("ts", forms[1])).otherwise(F.date_format("ts", forms[2]))
    return x.table("events").select("event_id", ingest.created(text, day_first=True).alias("created"))


@query("select event_id, strftime(case event_id % 6 when 0 then date_trunc('day', ts) when 1 then date_trunc('second', ts) when 3 then date_trunc('hour', ts) when 4 then date_trunc('day', ts) else date_trunc('minute', ts) end, '%Y-%m-%d %H:%M:%S') as created from events")
def created_month_first(x):
    """Compact, 12-hour and numeric forms; the month comes before the day unless it cannot."""
    ts = F.col("ts")
    forms = ["yyyyMMdd", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd h:mm a", "MMM d yyyy ha", "MM-dd-yyyy"]
    text = F.when(F.dayofmonth("ts") > 12, F.date_format(ts, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(ts, "MM/dd/yyyy HH:mm"))
    for i, form in enumerate(forms):
        text = F.when(F.col("event_id") % 6 == i, F.date_format(ts, form)).otherwise(text)
    return x.table("events").select("event_id", F.date_format(ingest.created(text), "yyyy-MM-dd HH:mm:ss").alias("created"))


def _forms(x):
    """Times of events in forms that transcripts mix."""
    k, ts = F.col("event_id") % 8, F.col("ts")
    at = lambda form, c=ts: F.date_format(c, form)
    forms = [at("yyyy-MM-dd HH:mm:ss.SSS"), at("yyyy-MM-dd HH:mm:ss'+00:00'"), at("yyyy-MM-dd HH:mm:ss' +0300'", ts + F.expr("interval 3 hours")), at("yyyy-MM-dd'T'HH:mm:ss'.5Z'"), at("yyyy/MM/dd HH:mm"), at("M/d/yyyy h:mm a"), at("'Mon, 'MMM d, yyyy HH:mm:ss' -05:30'", ts - F.expr("interval 330 minutes"))]
    text = F.lit("soon")
    for i, form in enumerate(forms):
        text = F.when(k == i, form).otherwise(text)
    return x.table("events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit(None)).otherwise(text).alias("created"))


@query("select event_id, case when event_id % 50 = 0 or event_id % 8 = 7 then 'none' else strftime(case when event_id % 8 = 0 then date_trunc('milliseconds', ts) when event_id % 8 = 3 then date_trunc('second', ts) + interval 500 millisecond when event_id % 8 in (4, 5) then date_trunc('minute', ts) else date_trunc('second', ts) end, '%Y-%m-%d %H:%M:%S.%g') end as created from events")
def created_forms(x):
    return _forms(x).select("event_id", F.coalesce(F.date_format(ingest.created(F.col("created")), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("none")).alias("created"))


@query("select count(*) as n, count(*) filter (event_id % 50 = 0) as n_missing, count(*) filter (event_id % 50 <> 0 and event_id % 8 = 7) as n_unparsed from events")
def created_report(x):
    return ingest.created_report(_forms(x))


# --- metrics -----------------------------------------------------------------------------------


@query(f"select conversation_id, outcome, {CREATED} as created from convs where platform = 'web' and is_ai and cast({CREATED} as date) between date '2024-01-05' and date '2024-02-20'", "convs")
def filter_slice(x):
    return metrics.filter_slice(x.full, "web", "2024-01-05", "2024-02-20", True).select("conversation_id", "outcome", "created")


@query(f"select distinct platform, cast(min(cast({CREATED} as date)) over () as varchar) as first_date, cast(max(cast({CREATED} as date)) over () as varchar) as last_date from convs", "convs")
def filter_domain(x):
    return metrics.filter_domain(x.full).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(
    """select turn_id, case when length(trim(t)) < 4 or t like 'http%' then false else not regexp_full_match(regexp_replace(t, '[+ ()-]', '', 'g'), '[0-9]+') end as worth from (
  select turn_id, case cast(conversation_id as bigint) % 4 when 0 then '+7 (' || conversation_id || ') 12-34' when 1 then 'https://x/' || conversation_id when 2 then ' ok ' else raw_text end as t from members)""",
    "members",
)
def worth_embedding_turns(x):
    k = F.col("conversation_id").cast("long") % 4
    t = F.when(k == 0, F.concat(F.lit("+7 ("), "conversation_id", F.lit(") 12-34"))).when(k == 1, F.concat(F.lit("https://x/"), "conversation_id")).when(k == 2, " ok ").otherwise(F.col("raw_text"))
    return x.members.select("turn_id", worth_embedding(t).alias("worth"))


@query("select count(*) as total, count(*) filter (outcome = 'closed') as ai_closed, count(*) filter (outcome = 'human-closed') as human_closed, count(*) filter (outcome = 'lost') as lost, count(*) filter (outcome = 'abandoned') as abandoned, count(*) filter (is_ai) as ai_total, round(count(*) filter (converted) * 100.0 / count(*), 6)::double as conversion_pct, round(count(*) filter (outcome = 'human-closed') * 100.0 / count(*), 6)::double as takeover_pct, round(count(*) filter (outcome = 'closed') * 100.0 / count(*) filter (is_ai), 6)::double as ai_close_pct from convs", "convs")
def kpi_overview(x):
    return metrics.kpi_overview(x.full)


@query("select count(*) as total, count(*) filter (not converted) as lost, round(count(*) filter (not converted) * 100.0 / count(*), 6)::double as loss_rate from convs where is_ai", "convs")
def loss_rate(x):
    return metrics.loss_rate(x.full)


@query("select outcome, count(*) as n, round_even(count(*) / sum(count(*)) over () * 100, 1)::double as share from convs group by outcome", "convs")
def outcome_breakdown(x):
    return metrics.outcome_breakdown(x.full)


@query("select platform, count(*) as total, count(*) filter (converted) as converted, round_even(count(*) filter (converted) / count(*) * 100, 1)::double as rate from convs group by platform", "convs")
def platform_breakdown(x):
    return metrics.platform_breakdown(x.full)


def _period_sql(end: str, series: str, label: str) -> str:
    return f"""with f as (select {end} as period, count(*) as total, count(*) filter (value > 50) as converted from events where day(ts) % 5 <> 0 group by 1),
    s as (select {series} as period)
    select cast(s.period as varchar) as period, coalesce(total, 0) as total, coalesce(converted, 0) as converted, coalesce(round(converted * 100.0 / total, 6), 0)::double as rate, {label} as label from s left join f on f.period = s.period"""


def _periods(x, granularity):
    e = x.table("events").where("day(ts) % 5 <> 0").select(F.col("ts").alias("created"), (F.col("value") > 50).alias("converted"))
    return metrics.by_period(e, granularity).withColumn("period", F.col("period").cast("string"))


_SPAN = "unnest(generate_series((select min(period) from f)::timestamp, (select max(period) from f)::timestamp, interval {0}))::date"


@query(_period_sql("cast(ts as date)", _SPAN.format("1 day"), "strftime(s.period, '%b %d')"))
def period_daily(x):
    return _periods(x, "daily")


@query(_period_sql("(cast(ts as date) + cast((8 - isodow(cast(ts as date))) % 7 as integer))", _SPAN.format("7 day"), "strftime(s.period, 'Week of %b %d')"))
def period_weekly(x):
    return _periods(x, "weekly")


@query(_period_sql("last_day(cast(ts as date))", "last_day(unnest(generate_series(date_trunc('month', (select min(period) from f))::timestamp, (select max(period) from f)::timestamp, interval 1 month))::date)", "strftime(s.period, '%b %Y')"))
def period_monthly(x):
    return _periods(x, "monthly")


@query(f"{DROP_OFF} select drop_off_turn, count(*) as n from convs join drops using (conv_id) where is_ai and not converted and drop_off_turn is not null group by 1", "convs")
def drop_off_distribution(x):
    return metrics.drop_off_distribution(x.full).withColumn("drop_off_turn", F.col("drop_off_turn").cast("long"))


@query("select platform, count(*) as n from convs group by platform", "convs")
def platform_counts(x):
    return metrics.value_counts(x.full, "platform")


COUNTS = f"with {ALL_TURNS}, counts as (select cast(conv_id as varchar) as conversation_id, count(*) as n_all, count(*) filter (role in ('user', 'assistant')) as n_chat, count(*) filter (role = 'tool_calls') > 0 as has_tools from raw_turns group by conv_id) "


@query(COUNTS + "select * from counts where n_all > 4")
def message_counts(x):
    return ingest.message_counts(x.parsed).where("n_all > 4").withColumns({c: F.col(c).cast("long") for c in ("n_all", "n_chat")})


@query(COUNTS + "select count(*) as n, round(avg(n_all), 6) as mean, round(stddev_samp(n_all), 6) as std, min(n_all) as low, quantile_cont(n_all, 0.25)::double as q1, quantile_cont(n_all, 0.5)::double as median, quantile_cont(n_all, 0.75)::double as q3, max(n_all) as high from counts")
def message_count_stats(x):
    return metrics.describe(ingest.message_counts(x.parsed).select(F.col("n_all").cast("long").alias("n_all")), "n_all")


@query(COUNTS + "select has_tools, n_all, count(*) as n from counts group by all")
def message_count_hist(x):
    return metrics.histogram(ingest.message_counts(x.parsed).withColumn("n_all", F.col("n_all").cast("long")), "n_all", "has_tools")


@query(f"select conversation_id, printf('[%s] %s  %s  %s', case when converted then '✓' else '✗' end, strftime({CREATED}, '%Y-%m-%d %H:%M'), platform, case when conv_id % 3 = 0 then 'user_' || conv_id % 37 else 'name_' || conv_id % 41 end) as label from convs", "convs")
def chat_labels(x):
    names = x.parsed.select("conversation_id", F.when(F.col("ordinal") % 3 != 0, F.col("user_name")).otherwise("").alias("user_name"), "user_id")
    return listing.chat_labels(x.full.join(names, "conversation_id"))


@query(f"with {ALL_TURNS}, runs as (select *, sum(case when role <> 'user' then 1 else 0 end) over (partition by conv_id order by i) as run from raw_turns) select cast(conv_id as varchar) as conversation_id, min(i) as turn_index, string_agg(text, ' ' order by i) as content from runs where role = 'user' group by conv_id, run")
def merged_user_messages(x):
    return ingest.merged_user_messages(x.parsed).withColumn("turn_index", F.col("turn_index").cast("long"))


@query(f"select conversation_id, {CREATED} as created from convs where not converted and conversation_id not in (select conversation_id from annotations)", "convs", "annotations")
def conversation_list(x):
    flags = x.parsed.select("conversation_id", ingest.is_low_quality().alias("low_quality"), ingest.has_operator_intervention().alias("operator_intervention"))
    convs = x.full.join(flags, "conversation_id")
    return listing.conversation_list(convs, x.annotations, converted=False, unannotated=True, hide_low_quality=True).select("conversation_id", "created")


@query(f"select conversation_id, {CREATED} as created from convs where converted and conv_id % 7 = 3", "convs")
def conversation_list_taken_over(x):
    flags = x.parsed.select("conversation_id", ingest.is_low_quality().alias("low_quality"), ingest.has_operator_intervention().alias("operator_intervention"))
    return listing.conversation_list(x.full.join(flags, "conversation_id"), converted=True, intervention=True).select("conversation_id", "created")


# --- labels ------------------------------------------------------------------------------------

CLIENT_TURNS = """, t as (select cast(conv_id as varchar) as conversation_id, turn as turn_index, conv_id || ':' || turn as turn_id, case when role = 'user' then 'client' else 'agent' end as role, text as raw_text, conv_id from conversations where role in ('user', 'assistant')),
todo as (select * from t where trim(raw_text) <> '' and conversation_id in (select conversation_id from t where role = 'client' and trim(raw_text) <> '' group by 1 having count(*) >= 2))"""


@query(CLIENT_TURNS.replace(", t as", "with t as", 1) + " select conversation_id, turn_index, turn_id, role, raw_text from todo where conv_id % 4 <> 0 or turn_index % 2 <> 0")
def turns_to_label(x):
    done = x.turns.where("cast(conversation_id as long) % 4 = 0 and turn_index % 2 = 0")
    return labels.turns_to_label(x.turns, done)


def _answers(x):
    """Answers of a labeler by rule, some of them no JSON and some out of bounds."""
    n = F.col("conversation_id").cast("long")
    client = F.format_string('{"intent": " Price Inquiry", "intent_confidence": %s, "sentiment": %s, "sentiment_confidence": "0.5"}', ((n % 15) / 10).cast("string"), (F.col("turn_index") % 5 - 2).cast("string"))
    agent = F.format_string('{"act": "Gave Price", "confidence": %s}', ((n % 15) / 10).cast("string"))
    return x.turns.withColumn("raw", F.when(n % 13 == 0, "not json").when(F.col("role") == "client", client).otherwise(agent))


@query(
    CLIENT_TURNS.replace(", t as", "with t as", 1)
    + """ select turn_id, case when conv_id % 13 = 0 then 'other' when role = 'client' then 'price_inquiry' else 'gave_price' end as intent,
  case when conv_id % 13 = 0 then 0.0 else least(1.0, (conv_id % 15) / 10) end::double as intent_confidence,
  case when conv_id % 13 <> 0 and role = 'client' then greatest(-1, least(1, turn_index % 5 - 2)) end::double as sentiment,
  case when conv_id % 13 <> 0 and role = 'client' then 0.5 else 0.0 end::double as sentiment_confidence from t"""
)
def parse_label(x):
    return labels.parse_label(_answers(x)).select("turn_id", "intent", "intent_confidence", "sentiment", "sentiment_confidence")


@query("select conv_id, turn, case when conv_id % 9 = 0 then 'other' else lower(role) || '_turn_' || turn end as intent from conversations")
def canonical_intents(x):
    label = F.when(F.col("conv_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("role"), F.lit(" Turn "), F.col("turn"), F.lit("\t")))
    return x.table("conversations").select("conv_id", "turn", canonical_intent(label).alias("intent"))


@query(
    """, counts as (select intent, count(*) as n from signals where role = 'client' and intent in ('asks_discount', 'sends_photo') group by 1)
select conversation_id, turn_index, role, sentiment, s.intent as raw_intent, case when c.n < 10 and role = 'client' then 'other' else s.intent end as intent, coalesce(c.n >= 10 and role = 'client', false) as discovered from signals s left join counts c on c.intent = s.intent""",
    "signals",
)
def discovered_intents(x):
    return labels.discovered_intents(x.signals, 10)


@query(CLIENT_TURNS.replace(", t as", "with t as", 1) + ", e as (select conversation_id, count(*) as n_expected from todo group by 1), l as (select conversation_id, count(*) as n_labeled from t where conv_id % 5 <> 0 or turn_index > 1 group by 1) select conversation_id, n_expected, n_labeled from e join l using (conversation_id) where n_labeled >= n_expected")
def fully_labeled(x):
    return labels.fully_labeled(x.turns, x.turns.where("cast(conversation_id as long) % 5 <> 0 or turn_index > 1"))


@query(CLIENT_TURNS.replace(", t as", "with t as", 1) + " select turn_id, case when conv_id % 3 = 0 then 'new' else 'old' end as intent, case when conv_id % 3 = 0 then 2 else 1 end as batch from t")
def labels_upsert(x):
    old = x.turns.select("turn_id", F.lit("old").alias("intent"), F.lit(1).alias("batch"))
    new = x.turns.where("cast(conversation_id as long) % 3 = 0").select("turn_id", F.lit("new").alias("intent"), F.lit(2).alias("batch"))
    return labels.upsert(old, new)


@query(CLIENT_TURNS.replace(", t as", "with t as", 1) + " select turn_id, case when conv_id % 3 = 0 then 'new' else 'old' end as intent, case when conv_id % 3 = 0 then 2 else 1 end as batch from t")
def labels_merged(x):
    """As labels_upsert, in a table kept by key; only the buckets of new labels are written again."""
    path, turns = scratch.folder(x.spark), x.turns.select("turn_id", "conversation_id")
    keyed.merge(path, turns.select("turn_id", F.lit("old").alias("intent"), F.lit(1).alias("batch")), "turn_id")
    keyed.merge(path, turns.where("cast(conversation_id as long) % 3 = 0").select("turn_id", F.lit("new").alias("intent"), F.lit(2).alias("batch")), "turn_id", "batch")
    return keyed.read(x.spark, path)


@query(CLIENT_TURNS.replace(", t as", "with t as", 1) + " select turn_id, case when role = 'client' then 'greeting' else 'follow_up' end as intent, case when role = 'client' then 0.9 else 0.8 end::double as intent_confidence, case when role = 'client' then 0.0 end::double as sentiment from todo where length(left(raw_text, 2000)) % 10 <> 0")
def label_turns(x):
    def labeler(asked):
        return [None if len(text) % 10 == 0 else '{"intent": "greeting", "intent_confidence": 0.9, "sentiment": 0}' if role == "client" else '{"act": "follow_up", "confidence": 0.8}' for role, text in asked]

    answered = labels.label_turns(labels.turns_to_label(x.turns), labeler)
    return labels.parse_label(answered).select("turn_id", "intent", "intent_confidence", "sentiment")


@query(ORACLES["label_turns"])
def label_turns_durable(x):
    """A labeler that fails on some turns leaves these alone unlabelled."""

    def labeler(role, text):
        if len(text) % 10 == 0:
            raise ConnectionError("no credit")
        return '{"intent": "greeting", "intent_confidence": 0.9, "sentiment": 0}' if role == "client" else '{"act": "follow_up", "confidence": 0.8}'

    answered = labelling.label_durably(labels.turns_to_label(x.turns), scratch.folder(x.spark), labeler, rows=20_000)
    return labels.parse_label(answered).select("turn_id", "intent", "intent_confidence", "sentiment")


@query(
    CLIENT_TURNS.replace(", t as", "with t as", 1)
    + r""" select turn_id, case when role = 'client' then case when regexp_matches(lower(raw_text), '\?|how much|price|cost') then 'price_inquiry' when regexp_matches(lower(raw_text), 'hello|hi |good (day|morning)') then 'greeting' when regexp_matches(lower(raw_text), 'buy|order') then 'ready_to_buy' when regexp_matches(lower(raw_text), '[0-9]{6,}|@') then 'shares_contact' else 'other' end
  else case when regexp_matches(lower(raw_text), '[0-9]+ ?(usd|eur|\$|€)') then 'gave_price' when regexp_matches(lower(raw_text), '\?') then 'asked_for_contact' when length(raw_text) > 40 then 'provided_info' else 'other' end end as intent from t"""
)
def rule_labels(x):
    return x.turns.select("turn_id", labels.rule_label(F.col("role"), F.col("raw_text")).alias("intent"))


# --- sequences ---------------------------------------------------------------------------------


@query("select conversation_id, string_agg(intent, '>' order by turn_index) as states from signals group by 1", "signals")
def state_sequences(x):
    return sequences.state_sequences(x.signals).withColumn("states", F.array_join("states", ">"))


STEPS = """, steps as (select s.conversation_id, s.turn_index, s.intent as from_state, coalesce(lead(s.intent) over w, case when c.converted then 'CLOSED' else 'LOST' end) as to_state, lead(s.turn_index) over w as to_turn, c.converted
  from signals s join convs c using (conversation_id) window w as (partition by s.conversation_id order by s.turn_index)),
edges as (select from_state, to_state, count(*) as n, avg(converted::int) as conv_rate, 1 - avg(converted::int) as p_lost, count(*) / sum(count(*)) over (partition by from_state) as prob from steps group by 1, 2),
tab as (select * from edges where n >= 5),
shown as (select * from tab order by n desc, from_state, to_state limit 40)
"""


def _table(x, **options):
    return sequences.transition_table(x.signals, x.convs, **options)


@query(STEPS + "select from_state, to_state, n, round(conv_rate, 6) as conv_rate, round(p_lost, 6) as p_lost, round(prob, 6) as prob from tab", "convs", "signals")
def transition_table(x):
    return _rounded(_table(x), "conv_rate", "p_lost", "prob")


def _colocated(df, buckets=8):
    """df as a table of a new name, bucketed by conversation."""
    path = scratch.folder(df.sparkSession)
    return colocated.write(df, path.rsplit("/", 1)[-1].replace("-", "_"), path, buckets)


@query(STEPS + "select from_state, to_state, n, round(conv_rate, 6) as conv_rate, round(p_lost, 6) as p_lost, round(prob, 6) as prob from tab", "convs", "signals")
def transition_table_colocated(x):
    return _rounded(sequences.transition_table(_colocated(x.signals), _colocated(x.convs)), "conv_rate", "p_lost", "prob")


@query(
    """, steps as (select intent as from_state, coalesce(lead(intent) over (partition by conversation_id order by turn_index), case when converted then 'CLOSED' else 'LOST' end) as to_state, converted from ev)
select from_state, to_state, count(*) as n, round(avg(converted::int), 6) as conv_rate, round(1 - avg(converted::int), 6) as p_lost, round(count(*) / sum(count(*)) over (partition by from_state), 6) as prob from steps group by 1, 2""",
    "ev",
)
def transition_table_events(x):
    convs = x.events.select("conversation_id", "outcome", "converted").distinct()
    return _rounded(sequences.transition_table(x.events, convs, 1), "conv_rate", "p_lost", "prob")


@query(STEPS + "select from_state, to_state, n, round(conv_rate, 6) as conv_rate, round(p_lost, 6) as p_lost, round(prob, 6) as prob, round((1 - conv_rate) * n, 6) as badness from tab where to_state not in ('CLOSED', 'LOST') order by conv_rate, n desc, from_state, to_state limit 15", "convs", "signals")
def worst_transitions(x):
    return _rounded(sequences.worst_transitions(_table(x)), "conv_rate", "p_lost", "prob", "badness")


@query(STEPS + "select from_state, to_state, round(1 + 4 * prob, 6) as width, cast(round_even(prob * 100, 0) as int) || '%' as label from shown", "convs", "signals")
def transition_edges(x):
    return sequences.transition_edges(_table(x))


@query(
    STEPS
    + """, states as (select from_state as state from shown union select to_state from shown), rates as (select from_state as state, avg(conv_rate) as r from shown group by 1)
select state, round(coalesce(r, 0.5), 6) as rate, printf('#%02x%02x88', cast(trunc(255 * (1 - coalesce(r, 0.5))) as int), cast(trunc(255 * coalesce(r, 0.5)) as int)) as color, case when state in ('CLOSED', 'LOST') then 'doublecircle' else 'box' end as shape from states left join rates using (state)""",
    "convs",
    "signals",
)
def transition_nodes(x):
    return sequences.transition_nodes(_table(x))


GRAMS = """, g as (select conversation_id, turn_index, intent as a, lead(intent, 1) over w as b, lead(intent, 2) over w as c, lead(intent, 3) over w as d from signals window w as (partition by conversation_id order by turn_index)),
grams as (select conversation_id, [a, b] as pattern from g where b is not null union select conversation_id, [a, b, c] from g where c is not null union select conversation_id, [a, b, c, d] from g where d is not null),
pats as (select pattern, len(pattern) as length, count(*) as n, avg(converted::int) as conv_rate, count(*) * (1 - avg(converted::int)) as score from grams join convs using (conversation_id) group by pattern having count(*) >= 3 order by round(score, 6) desc, array_to_string(pattern, ' ') limit 12)
"""


@query(GRAMS + "select array_to_string(pattern, ' > ') as pattern, length, n, round(conv_rate, 6) as conv_rate, round(score, 6) as score from pats", "convs", "signals")
def lost_patterns(x):
    out = sequences.lost_patterns(x.signals, x.convs, top=12)
    return _rounded(out.withColumns({"pattern": F.array_join("pattern", " > "), "length": F.col("length").cast("long")}), "conv_rate", "score")


@query(STEPS + "select conversation_id, min(turn_index) as from_turn, min(to_turn) as to_turn from steps where from_state = 'greeting' and to_state = 'gave_price' group by 1 order by 1 limit 3", "convs", "signals")
def transition_examples(x):
    return sequences.transition_examples(x.signals, "greeting", "gave_price")


@query(GRAMS + ", hits as (select array_to_string(pattern, ' > ') as pattern, conversation_id, row_number() over (partition by pattern order by conversation_id) as r from grams join pats using (pattern) join convs using (conversation_id) where not convs.converted) select pattern, conversation_id, r from hits where r <= 2", "convs", "signals")
def pattern_examples(x):
    return sequences.pattern_examples(x.signals, x.convs, sequences.lost_patterns(x.signals, x.convs, top=12)).withColumn("r", F.col("r").cast("long"))


@query(STEPS + ", hit as (select conversation_id from steps where from_state = 'greeting' and to_state = 'gave_price' group by 1 order by 1 limit 3) select cast(conv_id as varchar) as conversation_id, turn as turn_index, case when role = 'user' then 'client' else 'agent' end as role, text as raw_text from conversations where role in ('user', 'assistant') and cast(conv_id as varchar) in (select conversation_id from hit)", "convs", "signals")
def example_transcripts(x):
    return sequences.transcripts(sequences.transition_examples(x.signals, "greeting", "gave_price"), x.turns)


# --- sentiment ---------------------------------------------------------------------------------

FEATURE_SQL = """, v as (select conversation_id, sentiment as v, row_number() over (partition by conversation_id order by turn_index) - 1 as i from {0} where role = 'client' and sentiment is not null),
u as (select *, max(v) over (partition by conversation_id order by i) - v as drop_, i - coalesce(max(case when v >= 0 then i end) over (partition by conversation_id order by i), -1) as run from v),
features as (select conversation_id, avg(v) as mean, arg_max(v, i) as final, min(v) as min, max(drop_) as max_drop, coalesce(case when count(*) > 1 then regr_slope(v, i) end, 0) as slope, coalesce(max(case when v < 0 then run end), 0) as neg_run_len, arg_max(v, i) - arg_min(v, i) as start_to_end, count(*) as n_client_turns from u group by 1)
"""
FEATURES_OUT = "select conversation_id, round(mean, 6) as mean, round(final, 6) as final, round(min, 6) as min, round(max_drop, 6) as max_drop, round(slope, 6) as slope, neg_run_len, round(start_to_end, 6) as start_to_end, n_client_turns from features"
_REAL = ("mean", "final", "min", "max_drop", "slope", "start_to_end")


def _features(df):
    return _rounded(sentiment.trajectory_features(df).withColumn("neg_run_len", F.col("neg_run_len").cast("long")), *_REAL)


@query(FEATURE_SQL.format("signals") + FEATURES_OUT, "signals")
def trajectory_features(x):
    return _features(x.signals)


@query(FEATURE_SQL.format("ev") + FEATURES_OUT, "ev")
def trajectory_features_events(x):
    return _features(x.events)


BINS = """, v as (select s.conversation_id, c.converted, s.sentiment, row_number() over (partition by s.conversation_id order by turn_index) - 1 as i, count(*) over (partition by s.conversation_id) as n from signals s join convs c using (conversation_id) where role = 'client' and sentiment is not null)
select case when n > 1 then least(trunc(i::double / n * 10)::int, 9) else 0 end as bin, converted, round(avg(sentiment), 6) as mean, count(*) as n from v group by 1, 2"""


@query(BINS, "convs", "signals")
def avg_trajectory(x):
    return _rounded(sentiment.avg_trajectory(x.signals, x.convs), "mean")


@query(
    FEATURE_SQL.format("ev")
    + ", c as (select distinct conversation_id, converted::int as y from ev), j as (select * from features join c using (conversation_id)), r as ("
    + " union all ".join(f"select '{f}' as feature, case when stddev_pop({f}) = 0 or stddev_pop(y) = 0 then 0 else corr({f}, y) end as r from j" for f in sentiment.FEATURES)
    # two-sided p by Simpson's rule over the density of r, (1 - r * r) ** ((n - 4) / 2)
    + """), k as (select count(*)::double as n from j), step as (select unnest(range(0, 4001)) as i),
p as (select feature, any_value(r) as r, case when any_value(r) = 0 then 1.0 else least(1.0, 2 * exp(lgamma((any_value(n) - 1) / 2) - lgamma(0.5) - lgamma((any_value(n) - 2) / 2)) * (1 - abs(any_value(r))) / 4000 / 3
  * sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * pow(greatest(0, 1 - pow(abs(r) + (1 - abs(r)) * i / 4000, 2)), (n - 4) / 2))) end as p_value from r cross join k cross join step group by feature),
q as (select *, row_number() over (order by p_value) as pos, count(*) over () as m from p)
select feature, round(r, 6) as r, round(p_value, 6) as p_value, round(least(1.0, min(p_value * m / pos) over (order by pos desc)), 6) as p_adj, case when r >= 0 then 'higher → converts' else 'higher → loses' end as direction from q""",
    "ev",
)
def feature_correlations(x):
    convs = x.events.select("conversation_id", "converted").distinct()
    return sentiment.correlations(sentiment.trajectory_features(x.events), convs).select("feature", *[F.round(c, 6).alias(c) for c in ("r", "p_value", "p_adj")], "direction")


@query(FEATURE_SQL.format("signals") + "select count(*) as n, count(*) filter (converted) as converted, count(*) filter (not converted) as lost from features join convs using (conversation_id)", "convs", "signals")
def trajectory_summary(x):
    return sentiment.trajectory_summary(sentiment.trajectory_features(x.signals), x.convs)


@query()
def logistic_auc(x):
    return sentiment.logistic_auc(sentiment.trajectory_features(x.events), x.events.select("conversation_id", "converted").distinct())


# --- archetypes --------------------------------------------------------------------------------


@query(
    """, g as (select conversation_id, lower(intent) as a, lower(lead(intent) over (partition by conversation_id order by turn_index)) as b from signals),
terms as (select conversation_id, a as term from g union all select conversation_id, a || ' ' || b from g where b is not null),
tf as (select conversation_id, term, count(*) as tf from terms group by 1, 2), df as (select term, count(*) as df from tf group by 1), n as (select count(distinct conversation_id) as n from signals),
w as (select conversation_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term) cross join n)
select conversation_id, term, round(w / sqrt(sum(w * w) over (partition by conversation_id)), 6) as weight from w""",
    "signals",
)
def intent_tfidf(x):
    return _rounded(archetypes.intent_tfidf(x.signals), "weight")


@query()
def archetype_clusters(x):
    return archetypes.archetypes(x.signals)


@query()
def archetype_members(x):
    return archetypes.archetype_members(archetypes.archetypes(x.signals), x.convs)


@query(
    """, a as (select conversation_id, conv_id % 3 as cluster, converted from convs where conversation_id in (select conversation_id from signals)),
k as (select cluster, intent, row_number() over (partition by cluster order by count(*) desc, intent) as r from a join signals using (conversation_id) group by 1, 2)
select cluster, any_value(size) as size, any_value(conv_rate) as conv_rate, string_agg(intent, ', ' order by r) as top_intents from (select cluster, count(*) as size, round(avg(converted::int), 6) as conv_rate from a group by 1) join k using (cluster) where r <= 4 group by 1""",
    "convs",
    "signals",
)
def archetype_summary(x):
    assigned = x.convs.join(x.signals.select("conversation_id").distinct(), "conversation_id", "left_semi").select("conversation_id", (F.col("conv_id") % 3).alias("cluster"))
    return archetypes.archetype_summary(assigned, x.convs, x.signals)


# --- topics ------------------------------------------------------------------------------------

CORPUS = "select m.conversation_id, turn_id, outcome, raw_text from members m join convs using (conversation_id) where is_ai and length(trim(raw_text)) >= 4 and raw_text not like 'http%' and not regexp_full_match(regexp_replace(raw_text, '[+ ()-]', '', 'g'), '[0-9]+')"


@query(CORPUS + " and outcome in ('lost', 'abandoned')", "convs", "members")
def cluster_corpus_failure(x):
    return topics.cluster_corpus(x.turns, x.convs, "failure").drop("turn_index")


@query(CORPUS, "convs", "members")
def cluster_corpus_faq(x):
    return topics.cluster_corpus(x.turns, x.convs).drop("turn_index")


@query("select turn_id, x, y, case when cluster_id is null then 'Noise' else 'topic ' || cluster_id end as label, left(raw_text, 80) as text from members", "members")
def cluster_map(x):
    m = x.members
    names = m.where("cluster_id is not null").select("cluster_id").distinct().withColumn("label", F.concat(F.lit("topic "), "cluster_id"))
    return topics.cluster_map(m.select("turn_id", "x", "y", "cluster_id"), m, names)


@query("select turn_id, conversation_id, raw_text, outcome from members join convs using (conversation_id) where cluster_id = 2", "convs", "members")
def cluster_drilldown(x):
    return topics.cluster_drilldown(x.members, x.members, x.convs, 2)


@query("select outcome, count(*) as n from members join convs using (conversation_id) where cluster_id = 2 group by 1", "convs", "members")
def cluster_outcomes(x):
    return topics.cluster_outcomes(x.members, x.convs, 2)


@query(", t as (select cluster_id, count(*) as n from members where cluster_id is not null group by 1 order by 2 desc, 1 limit 3) select cluster_id, n, round_even(n / sum(n) over () * 100, 1)::double as share from t", "members")
def top_clusters(x):
    return topics.top_clusters(x.members, 3)


@query("select label, count(*) as n, 0.0::double as noise_share, row_number() over (order by count(*) desc, label) - 1 as rank from embeddings group by label")
def cluster_sizes(x):
    return topics.cluster_sizes(x.table("embeddings"), "label").withColumn("rank", F.col("rank").cast("long"))


@query(", s as (select cluster_id, row_number() over (partition by cluster_id order by turn_id) as r, turn_id, raw_text from members where cluster_id is not null) select * from s where r <= 12", "members")
def cluster_samples(x):
    return topics.cluster_samples(x.members).withColumn("r", F.col("r").cast("long"))


@query(
    """, words as (select cluster_id, unnest(string_split_regex(lower(raw_text), '[^a-z]+')) as term from members where cluster_id is not null),
tf as (select cluster_id, term, count(*) as tf from words where length(term) > 2 group by 1, 2), df as (select term, count(*) as df from tf group by 1), k as (select count(distinct cluster_id) as k from members),
w as (select cluster_id, term, row_number() over (partition by cluster_id order by round(tf * ln(1 + k / df), 6) desc, term) as r from tf join df using (term) cross join k)
select cluster_id, string_agg(term, ' ' order by r) as name from w where r <= 5 group by 1""",
    "members",
)
def cluster_terms(x):
    return topics.cluster_terms(x.members)


def _points(x, k):
    v = x.table("embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    return topics.reduce(v, k)


def _vectors(x):
    return x.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("reduced"))


PAIRS = "with p as (select a.vec_id as id, list_distance(a.embedding::double[], b.embedding::double[]) as d from embeddings a, embeddings b where a.embedding is not null and b.embedding is not null) "


@query(PAIRS + "select id, count(*) as n from p where d <= 0.6 group by id")
def neighbour_counts(x):
    return topics.neighbour_counts(_vectors(x), 0.6)


@query(PAIRS + "select id, round(d, 6) as core from (select id, d, row_number() over (partition by id order by d) as r from p) where r = 6")
def core_distance(x):
    return topics.core_distance(_vectors(x)).withColumn("core", F.round("core", 6))


@query()
def hierarchical_clusters(x):
    return hierarchy.hierarchical_clusters(_points(x, topics.DIMENSIONS).select("id", "reduced"))


@query()
def density_clusters(x):
    return topics.density_clusters(_points(x, topics.DIMENSIONS).select("id", "reduced"), 0.35)


def _corpus(x):
    """Reduced vectors of client turns, stored, so that texts are joined once."""
    said = scratch.stored(topics.cluster_corpus(x.turns, x.convs).select("turn_id", "raw_text"))
    out = scratch.stored(topics.reduce(topics.embed(said), topics.DIMENSIONS).select("turn_id", F.xxhash64("turn_id").alias("id"), "reduced"))
    scratch.drop(said)
    return out


@query()
def turn_coords(x):
    """From text to coordinates with cluster ids: one projection serves clusters and display."""
    corpus = _corpus(x)
    found = topics.density_clusters(corpus.select("id", "reduced"), 0.35).join(corpus.select("id", "turn_id"), "id").select("turn_id", "cluster")
    r = F.col("reduced")
    return topics.turn_coords(corpus.select("turn_id", r[0].alias("x"), r[1].alias("y")), found, "faq")


@query()
def turn_layout(x):
    """As turn_coords, with coordinates that keep neighbours."""
    corpus = _corpus(x)
    found = topics.density_clusters(corpus.select("id", "reduced"), 0.35).join(corpus.select("id", "turn_id"), "id").select("turn_id", "cluster")
    placed = layout.coordinates(corpus.select("id", "reduced")).join(corpus.select("id", "turn_id"), "id")
    return topics.turn_coords(placed.select("turn_id", "x", "y"), found, "faq")


@query()
def neighbour_graph(x):
    return layout.neighbour_graph(_vectors(x))


@query(", ids as (select cluster_id as c, md5('faq:' || min(turn_id)) as id from members where cluster_id is not null group by 1) select 'faq' as cluster_type, turn_id, x, y, coalesce(id, 'noise') as cluster_id from members left join ids on c = cluster_id", "members")
def turn_coords_clusters(x):
    m = x.members
    out = topics.turn_coords(m.select("turn_id", "x", "y"), m.select("turn_id", "cluster_id"), "faq", "cluster_id")
    return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit("noise")))


# --- annotations -------------------------------------------------------------------------------

TAGS = """, tagged as (select *, case when failure_type like '[%' then from_json(failure_type, '["VARCHAR"]') when failure_type <> '' then [failure_type] else [] end as tags from annotations)"""


@query(TAGS + ", t as (select unnest(tags) as tag from tagged) select tag, count(*) as n, round_even(count(*) / sum(count(*)) over () * 100, 1)::double as share from t group by tag", "annotations")
def tag_distribution(x):
    return notes.tag_distribution(x.annotations)


@query("select (select count(*) from annotations) as n_annotations, (select count(distinct conversation_id) from annotations) as n_annotated, (select count(*) from convs where is_ai and not converted) as n_lost, round((select count(distinct conversation_id) from annotations)::double / (select count(*) from convs where is_ai and not converted), 6) as coverage", "convs", "annotations")
def annotation_coverage(x):
    return notes.annotation_coverage(x.annotations, x.convs)


@query("select conversation_id, id, save_no, annotated_at, failure_type from annotations qualify row_number() over (partition by conversation_id order by annotated_at desc, id desc) = 1", "annotations")
def latest_annotation(x):
    return notes.latest(x.annotations)


@query(TAGS + ", m as (select id, case when list_contains(tags, 'trust') and list_contains(tags, 'price') then ['price'] else list_distinct([case when t in ('trust', 'timing') then 'price' else t end for t in tags]) end as new, tags from tagged) select id, array_to_string(new, ',') as tags from m where new <> tags", "annotations")
def merge_tags(x):
    return notes.merge_tags(x.annotations, ["trust", "timing"], "price").select("id", F.array_join("tags", ",").alias("tags"))


@query(f"select conversation_id, outcome, {CREATED} as created from convs where not converted and conversation_id not in (select conversation_id from annotations)", "convs", "annotations")
def unannotated_lost(x):
    return notes.unannotated_lost(x.full, x.annotations).select("conversation_id", "outcome", "created")


@query(TAGS + " select t.conversation_id, id, outcome, annotated_at from tagged t join convs using (conversation_id) where list_contains(tags, 'price')", "convs", "annotations")
def tag_examples(x):
    return notes.tag_examples(x.annotations, x.convs, "price").select("conversation_id", "id", "outcome", "annotated_at")
