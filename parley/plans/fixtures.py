"""The supplied tables as this library's inputs. SQL that both engines read is written once:
{conversations} and the like are views there and DataFrames here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVS = """
select cast(conv_id as string) as conversation_id, conv_id,
  case when conv_id % 7 = 3 then 'human-closed' when conv_id % 3 = 0 then 'closed'
       when sum(case when role = 'user' then 1 else 0 end) < 2 then 'abandoned' else 'lost' end as outcome,
  max(case when role = 'assistant' then 1 else 0 end) = 1 and conv_id % 11 <> 0 as is_ai,
  count(*) + case when conv_id % 3 = 0 then 2 else 0 end + case when conv_id % 7 = 3 then 1 else 0 end as turn_count,
  cast(sum(case when role = 'user' then 1 else 0 end) as bigint) as user_turn_count,
  case conv_id % 4 when 0 then 'whatsapp' when 1 then 'telegram' when 2 then 'instagram' else 'web' end as platform,
  conv_id % 7 = 3 or conv_id % 3 = 0 as converted
from {conversations} group by conv_id
"""

SIGNALS = """
select cast(t.conv_id as string) as conversation_id, t.turn as turn_index,
  case when t.role = 'user' then 'client' else 'agent' end as role,
  case when t.role = 'user' then
    case when length(t.text) % 17 = 0 then 'asks_discount' when length(t.text) % 41 = 1 then 'sends_photo'
    else case length(t.text) % 5 when 0 then 'greeting' when 1 then 'price_inquiry' when 2 then 'objection_price'
         when 3 then 'ready_to_buy' else 'shares_contact' end end
  else case length(t.text) % 3 when 0 then 'asked_for_contact' when 1 then 'gave_price' else 'provided_info' end end as intent,
  case when t.role = 'user' then cast((length(t.text) * 7 + t.turn * 3) % 21 - 10 as double) / 10 end as sentiment
from {conversations} t join {convs} c on c.conv_id = t.conv_id
where t.role in ('user', 'assistant') and c.is_ai and c.user_turn_count >= 2
"""

ANNOTATIONS = """
select conversation_id, n as save_no, concat(conversation_id, '-', n) as id, conv_id * 10 + n as annotated_at,
  case when (conv_id + n) % 4 = 0 then '["price","trust"]' when (conv_id + n) % 4 = 1 then '["price"]'
       when (conv_id + n) % 4 = 2 then 'timing' else '[]' end as failure_type
from {convs} c cross join (select 1 as n union all select 2 as n) k
where outcome in ('lost', 'abandoned') and conv_id % 2 = 0 and (n = 1 or conv_id % 10 = 0)
"""

EVENTS = """
select cast(user_id as string) as conversation_id,
  row_number() over (partition by user_id order by ts, event_id) - 1 as turn_index, 'client' as role,
  event_type as intent, cast(cast(floor(value) as bigint) % 21 - 10 as double) / 10 as sentiment,
  case when user_id % 3 = 0 then 'closed' else 'lost' end as outcome, user_id % 3 = 0 as converted
from {events}
"""

#: Client turns with a fixed cluster; 5 means noise.
MEMBERS = """
select concat(cast(conv_id as string), ':', cast(turn as string)) as turn_id, cast(conv_id as string) as conversation_id, text as raw_text,
  nullif(length(text) % 6, 5) as cluster_id, length(text) % 100 as x, turn as y
from {conversations} where role = 'user'
"""


def duck(*names: str) -> str:
    """A WITH clause of the bindings for DuckDB."""
    texts = {"convs": CONVS, "signals": SIGNALS, "annotations": ANNOTATIONS, "ev": EVENTS, "members": MEMBERS}
    order = [n for n in texts if n in names or n == "convs" and {"signals", "annotations"} & set(names)]
    made = [f"{n} as ({texts[n].format(conversations='conversations', convs='convs', events='events').replace('as string', 'as varchar')})" for n in order]
    return "with " + ", ".join(made) + " "


class Inputs:
    """The bindings over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def convs(self) -> DataFrame:
        return self.spark.sql(CONVS, conversations=self.table("conversations"))

    @property
    def signals(self) -> DataFrame:
        return self.spark.sql(SIGNALS, conversations=self.table("conversations"), convs=self.convs)

    @property
    def annotations(self) -> DataFrame:
        return self.spark.sql(ANNOTATIONS, convs=self.convs)

    @property
    def events(self) -> DataFrame:
        return self.spark.sql(EVENTS, events=self.table("events"))

    @property
    def members(self) -> DataFrame:
        return self.spark.sql(MEMBERS, conversations=self.table("conversations"))

    @property
    def turns(self) -> DataFrame:
        role = F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
        t = self.table("conversations").where("role in ('user', 'assistant')")
        return t.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("turn_index"), F.concat_ws(":", "conv_id", "turn").alias("turn_id"), role.alias("role"), F.col("text").alias("raw_text"))

    @property
    def raw(self) -> DataFrame:
        """Transcripts as JSON, with tool messages, hand-offs and managers added by rule."""
        message = lambda x: F.to_json(F.struct(x["role"].alias("role"), F.when((x["role"] == "assistant") & (F.col("conv_id") % 11 == 0), "manager").alias("type"), x["text"].alias("content")))
        said = self.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).withColumn("a", F.transform("m", message))
        tools = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit('{"role":"tool_calls","tool_calls":[]}'), F.lit('{"role":"tool","tool_result":"Успешно"}'))).otherwise(F.array().cast("array<string>"))
        info = F.when(F.col("conv_id") % 7 == 3, F.array(F.lit('{"role":"info","content":"PAUSE_DIALOG_OPERATOR_INTERVENTION"}'))).otherwise(F.array().cast("array<string>"))
        return said.select(
            F.col("conv_id").alias("ordinal"), F.col("conv_id").cast("string").alias("chat_id"), F.concat(F.lit("user_"), F.col("conv_id") % 37).alias("user_id"),
            F.concat(F.lit("name_"), F.col("conv_id") % 41).alias("user_name"),
            F.element_at(F.array(*map(F.lit, ("whatsapp", "telegram", "instagram", "web"))), (F.col("conv_id") % 4 + 1).cast("int")).alias("from_messenger"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id * 7 as int))").alias("created"),
            F.concat(F.lit("["), F.array_join(F.concat("a", tools, info), ","), F.lit("]")).alias("messages"),
        )

    @property
    def parsed(self) -> DataFrame:
        from ..operators import ingest

        return ingest.parse_messages(self.raw).withColumn("conversation_id", ingest.conversation_id())

    @property
    def full(self) -> DataFrame:
        """Conversations from transcripts, those of people alone included."""
        from ..operators import ingest

        return ingest.conversations(self.parsed, ai_only=False).withColumnRenamed("is_ai_conversation", "is_ai")
