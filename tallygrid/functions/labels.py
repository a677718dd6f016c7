"""Text helpers: translated names, state labels, composed line labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.money import col

# Order state codes and the labels shown for them.
STATE_LABELS = {
    "draft": "Draft Quotation",
    "sent": "Sent Quotation",
    "sale": "Sales Order",
    "done": "Locked Order",
    "cancel": "Cancelled",
}
CONFIRMED = ("sale", "done")
QUOTATION = ("draft", "sent")


def state_label(state: Column | str) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATE_LABELS.items() for x in pair])
    return F.coalesce(labels[col(state)], col(state))


def filled(c: Column | str) -> Column:
    """Empty text counts as missing."""
    return F.nullif(col(c), F.lit(""))


def translated(names: Column | str, lang: str, fallback: str) -> Column:
    """Label out of a JSON object of language → text."""
    in_lang = F.get_json_object(col(names), f"$.{lang}")
    in_default = F.get_json_object(col(names), "$.en_US")
    return F.coalesce(filled(in_lang), filled(in_default), F.lit(fallback))


def named(c: Column | str, fallback: str) -> Column:
    return F.coalesce(filled(c), F.lit(fallback))
