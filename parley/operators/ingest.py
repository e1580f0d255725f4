"""Transcripts to conversations and turns. All rules about one transcript are higher-order
functions on its parsed array, so the only shuffle is that of removing repeated ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CONVERTED, HAND_OFF, SUCCESS_JSON, SUCCESS_TEXT, strip

_MESSAGE = """transform(coalesce(case when schema_of_variant(v) like 'ARRAY%' then cast(v as array<variant>) end, cast(array() as array<variant>)),
  (x, i) -> named_struct(
    'pos', i,
    'is_object', coalesce(schema_of_variant(x) like 'OBJECT%', false),
    'role', try_variant_get(x, '$.role', 'string'),
    'type', try_variant_get(x, '$.type', 'string'),
    'content', try_variant_get(x, '$.content', 'string'),
    'tool_result', try_variant_get(x, '$.tool_result', 'string'),
    'tool_is_text', coalesce(schema_of_variant(try_variant_get(x, '$.tool_result', 'variant')) = 'STRING', false)))"""


def parse_messages(raw: DataFrame) -> DataFrame:
    """raw with `msgs`, its JSON array as an array of structs. No JSON, or JSON that is no
    array, gives an empty one; elements that are no objects keep their position."""
    return raw.withColumn("v", F.try_parse_json("messages")).withColumn("msgs", F.expr(_MESSAGE)).drop("v")


def conversation_id(chat_id: str = "chat_id", user_id: str = "user_id", ordinal: str = "ordinal") -> Column:
    return F.coalesce(F.nullif(F.col(chat_id), F.lit("")), F.nullif(F.col(user_id), F.lit("")), F.col(ordinal).cast("string"))


def normalize_role(role: Column, kind: Column) -> Column:
    return (
        F.when(role == "user", "client")
        .when(role == "assistant", F.when(kind.eqNullSafe("manager"), "human").otherwise("agent"))
        .when(role.isin("tool_calls", "tool"), "tool")
        .otherwise(F.coalesce(role, F.lit("")))
    )


def _of(role: str):
    return lambda m: m["is_object"] & m["role"].eqNullSafe(role)


def is_ai() -> Column:
    return F.exists("msgs", lambda m: _of("assistant")(m) & ~m["type"].eqNullSafe("manager"))


def has_operator_intervention() -> Column:
    """Any message is the marker and nothing else, whatever its role."""
    return F.exists("msgs", lambda m: m["is_object"] & m["content"].eqNullSafe(HAND_OFF))


def is_low_quality() -> Column:
    """Exactly one user message, of under two characters."""
    users = F.filter("msgs", _of("user"))
    return (F.size(users) == 1) & F.forall(users, lambda m: F.length(strip(F.coalesce(m["content"], F.lit("")))) < 2)


def user_turns() -> Column:
    return F.size(F.filter("msgs", _of("user")))


def outcome() -> Column:
    """human-closed over closed over abandoned (under two user messages) over lost."""

    def success(m):
        text = F.coalesce(m["tool_result"], F.lit(""))
        found = F.contains(text, F.lit(SUCCESS_TEXT))
        for needle in SUCCESS_JSON:  # an object is not JSON text
            found = found | (m["tool_is_text"] & F.contains(text, F.lit(needle)))
        return _of("tool")(m) & found

    taken_over = F.exists("msgs", lambda m: _of("info")(m) & F.contains(F.coalesce(m["content"], F.lit("")), F.lit(HAND_OFF)))
    return F.when(taken_over, "human-closed").when(F.exists("msgs", success), "closed").when(user_turns() < 2, "abandoned").otherwise("lost")


def drop_off_turn(outcome_column: str = "outcome") -> Column:
    """Position of the last user message of a conversation that did not convert."""
    last = F.array_max(F.transform(F.filter("msgs", _of("user")), lambda m: m["pos"]))
    return F.when(~F.col(outcome_column).isin(*CONVERTED), last)


#: The months as names begin.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_OFFSET = r"\s*(Z|z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)$"
_CLOCK = r"^[ T]*([0-9]{1,2})(?::([0-9]{1,2}))?(?::([0-9]{1,2})(\.[0-9]+)?)?\s*([AaPp]\.?[Mm]\.?)?$"


def _date(text: Column, pattern: str, order: str, day_first: bool = False) -> Column:
    """struct<y, m, d, rest> of a text that begins with a date, null where the pattern does not fit. order says
    which groups are the year, the month and the day; 'a' and 'b' are a month and a day in either order. What follows
    the pattern is the rest."""
    part = {c: F.regexp_extract(text, pattern, i + 1) for i, c in enumerate(order)}
    if "a" in part:
        first, second = (part[c].try_cast("int") for c in "ab")
        # a number that no month has is the day, wherever it stands
        swap = (second <= 12) if day_first else (first > 12)
        month, day = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
    elif "n" in part:
        names = F.array(*map(F.lit, MONTHS))
        month, day = F.array_position(names, F.lower(F.substring(part["n"], 1, 3))).cast("int"), part["d"].try_cast("int")
    else:
        month, day = part["m"].try_cast("int"), part["d"].try_cast("int")
    return F.when(text.rlike(pattern), F.struct(part["y"].alias("y"), month.alias("m"), day.alias("d"), F.regexp_replace(text, pattern, "").alias("rest")))


def created(text: Column, day_first: bool = False) -> Column:
    """UTC time of mixed forms; null where none fits. The session's time zone should be UTC.

    A date is year-month-day, yyyymmdd, month-day-year, or has the name of a month; its parts stand between dashes,
    slashes or dots, and the name of a day may come first. The month is read before the day unless it is over 12;
    with day_first the day is, unless the second number is over 12. A time may follow after a blank or a T: of 24 or 12
    hours (with am or pm), with or without minutes, seconds and fractions, or as hhmm and hhmmss after yyyymmdd. Then an
    offset may follow (Z, UTC, +hh, +hhmm, +hh:mm, after a blank or not); without one it is UTC.
    """
    t = F.regexp_replace(F.trim(text), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*[, ]\s*", "")
    local = F.regexp_replace(t, r"(?<=[0-9MmT.])(?<![0-9]{4}-[0-9]{2})(?<!^[0-9]{4})(?<!^[0-9]{2}[-][0-9]{2})(?<!^[0-9][-][0-9]{2})(?<!^[0-9])(?<!^[0-9]{2})" + _OFFSET, "")
    plain = F.regexp_replace(F.regexp_replace(local, ",", " "), r"\s+", " ")
    spread = F.regexp_replace(plain, r"^([0-9]{4})([0-9]{2})([0-9]{2})[T ]?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?![0-9])", "$1-$2-$3 $4:$5:$6")
    spread = F.regexp_replace(spread, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) ((?:[0-9]{2})?(?::[0-9]{2})*):+$", "$1 $2")
    end = r"(?=[T ]|$)"
    date = F.coalesce(
        _date(spread, r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + end, "ymd"),
        _date(spread, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})" + end, "aby", day_first),
        _date(spread, r"^([A-Za-z]{3,9})\.?[ -]([0-9]{1,2})[ -]([0-9]{4})" + end, "ndy"),
        _date(spread, r"^([0-9]{1,2})[ -]([A-Za-z]{3,9})\.?[ -]([0-9]{4})" + end, "dny"),
        _date(spread, r"^([0-9]{4})()()$", "ymd"),
        _date(spread, r"^([0-9]{4})-([0-9]{1,2})()$", "ymd"),
    )
    clock = lambda i: F.regexp_extract(date["rest"], _CLOCK, i)
    rest = F.trim(date["rest"])
    hour, half = clock(1).try_cast("int"), F.lower(clock(5))
    hour = F.when(half == "", F.when((clock(2) != ""), hour)).when(hour.between(1, 12), hour % 12 + F.when(half.startswith("p"), 12).otherwise(0))
    zero = lambda c: F.when(c == "", "0").otherwise(c)
    time = F.when(rest.isin("", "T"), F.lit("0:0:0")).when(date["rest"].rlike(_CLOCK), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(zero(clock(2)), 2, "0"), F.lit(":"), F.lpad(zero(clock(3)), 2, "0"), clock(4)))
    iso = F.concat(date["y"], F.lit("-"), F.lpad(F.coalesce(date["m"], F.lit(1)).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.coalesce(date["d"], F.lit(1)).cast("string"), 2, "0"), F.lit(" "), time)
    zone = F.when(F.length(local) < F.length(t), F.regexp_extract(t, _OFFSET, 1))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone.rlike("^[+-]"), sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.coalesce(F.regexp_extract(zone, ":?([0-9]{2})$", 1).try_cast("int") * (F.length(zone) > 3).cast("int"), F.lit(0)))).otherwise(0)
    return iso.try_cast("timestamp") - F.make_dt_interval(mins=minutes)


def created_report(raw: DataFrame, column: str = "created") -> DataFrame:
    """Rows, and of them those without a time and those whose time is in no known form."""
    text = F.coalesce(F.trim(column), F.lit(""))
    return raw.agg(F.count("*").alias("n"), F.count_if(text == "").alias("n_missing"), F.count_if((text != "") & created(F.col(column)).isNull()).alias("n_unparsed"))


def first_of_id(raw: DataFrame) -> DataFrame:
    """Of rows with one conversation_id, that of least ordinal."""
    own = Window.partitionBy("conversation_id").orderBy("ordinal")
    return raw.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def new_only(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """The first row of each id that is not loaded yet."""
    return first_of_id(raw).join(loaded.select("conversation_id"), "conversation_id", "left_anti")


def conversations(parsed: DataFrame, ai_only: bool = True) -> DataFrame:
    """One row a conversation from parsed transcripts with conversation_id and ordinal."""
    out = parsed.withColumn("is_ai_conversation", is_ai()).withColumn("outcome", outcome())
    out = first_of_id(out.where("is_ai_conversation") if ai_only else out)
    return out.select(
        "conversation_id", "outcome", F.size("msgs").alias("turn_count"), user_turns().alias("user_turn_count"), drop_off_turn().alias("drop_off_turn"),
        (F.col("outcome") == "human-closed").alias("intervention_flag"), "is_ai_conversation", F.col("from_messenger").alias("platform"), "created",
        F.col("outcome").isin(*CONVERTED).alias("converted"), (F.col("outcome") == "closed").alias("ai_closed"),
    )


def turns(parsed: DataFrame) -> DataFrame:
    """One row a message that is an object; turn_index is its place in the array."""
    m = F.col("m")
    rows = parsed.select("conversation_id", F.explode("msgs").alias("m")).where(m["is_object"])
    return rows.select(
        "conversation_id", m["pos"].alias("turn_index"), F.concat_ws(":", "conversation_id", m["pos"]).alias("turn_id"),
        normalize_role(m["role"], m["type"]).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("raw_text"),
    )


def message_counts(parsed: DataFrame) -> DataFrame:
    """Messages of each conversation: all, of users and assistants, and whether tools are called."""
    n = lambda f: F.size(F.filter("msgs", f))
    return parsed.select("conversation_id", n(lambda m: m["is_object"]).alias("n_all"), n(lambda m: m["is_object"] & m["role"].isin("user", "assistant")).alias("n_chat"), F.exists("msgs", _of("tool_calls")).alias("has_tools"))


def merged_user_messages(parsed: DataFrame) -> DataFrame:
    """Each run of user messages as one text; any other object ends a run, other elements do not."""
    m = F.col("m")
    rows = parsed.select("conversation_id", F.explode("msgs").alias("m")).where(m["is_object"])
    own = Window.partitionBy("conversation_id").orderBy("pos")
    rows = rows.select("conversation_id", m["pos"].alias("pos"), m["role"].eqNullSafe("user").alias("is_user"), F.coalesce(m["content"], F.lit("")).alias("content"))
    runs = rows.withColumn("run", F.sum((~F.col("is_user")).cast("int")).over(own)).where("is_user")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " ")
    return runs.groupBy("conversation_id", "run").agg(F.min("pos").alias("turn_index"), text.alias("content")).drop("run")
