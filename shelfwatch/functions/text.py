"""Sentences shown next to alerts and actions."""

from pyspark.sql import Column, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions.numeric import fixed_point


def alert_sentence(item, organization, location, usage: Column, lead: Column, days: Column) -> Column:
    return F.format_string(
        V.ALERT_SENTENCE,
        item,
        organization,
        location,
        fixed_point(usage, 1),
        lead.cast("string"),
        fixed_point(days, 1),
    )


def action_sentence(item, organization, location) -> Column:
    return F.format_string(V.ACTION_SENTENCE, item, organization, location)
