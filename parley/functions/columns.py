"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
CLIENT_INTENTS = (
    "greeting", "price_inquiry", "product_info", "dosage_safety", "child_condition", "order_details", "barter_partnership",
    "objection_price", "objection_trust", "objection_timing", "ready_to_buy", "shares_contact", "request_human", "complaint", "other",
)
AGENT_ACTS = ("greeting", "asked_for_contact", "gave_price", "answered_objection", "provided_info", "follow_up", "other")
TERMINALS = ("CLOSED", "LOST")
HAND_OFF = "PAUSE_DIALOG_OPERATOR_INTERVENTION"
SUCCESS_TEXT = "Успешно"
SUCCESS_JSON = ('"result":"success"', '"result": "success"')
CONVERTED = ("closed", "human-closed")


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_intent(label: Column) -> Column:
    """Trimmed, lower case, underscores for spaces; nothing left is 'other'."""
    clean = F.replace(F.lower(strip(F.coalesce(label, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(clean == "", "other").otherwise(clean)


def terminal_state(outcome: Column) -> Column:
    return F.when(outcome.isin(*CONVERTED), "CLOSED").otherwise("LOST")


def clamp(value: Column, low: float, high: float, default: float | None = 0.0) -> Column:
    """A number, or a string that is one, within bounds; anything else is the default."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default).cast("double")).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number)))


def worth_embedding(text: Column) -> Column:
    """Not under four characters, a link, or only digits and phone punctuation."""
    t = strip(text)
    number = F.regexp_replace(t, r"[+ \-()]", "").rlike(r"(?U)^\d+$")
    return (F.length(t) >= 4) & ~F.startswith(t, F.lit("http://")) & ~F.startswith(t, F.lit("https://")) & ~number


def rate_color(rate: Column) -> Column:
    """From red for 0 to green for 1."""
    return F.format_string("#%02x%02x88", (255 * (1 - rate)).cast("int"), (255 * rate).cast("int"))
