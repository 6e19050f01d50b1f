"""Review wording and reply reading as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.scoring import choose
from attestry.functions.text import blank_to_null, stripped


def field_label(field: Column) -> Column:
    """Display name of a finding's field."""
    base = F.coalesce(
        blank_to_null(F.trim(F.regexp_replace(field, K.FIELD_SUFFIX_RE, ""))), field)
    return F.coalesce(choose(base, K.FIELD_WORDS), F.regexp_replace(base, "_", " "))


def parse_reply(reply: Column) -> Column:
    """struct(kind, action) of a reviewer's reply."""
    body = F.lower(F.regexp_replace(stripped(F.coalesce(reply, F.lit(""))), "^/", ""))
    word = F.element_at(F.split(body, r"\s+", 2), 1)
    action = F.when(word.isin(*K.REPLY_ACTIONS), word)
    for name, pattern in K.REPLY_PATTERNS:
        action = action.when(word.rlike(pattern), name)
    kind = F.when(body == "", "unknown").when(word.startswith("?"), "evidence")
    for name, words in K.REPLY_WORDS.items():
        kind = kind.when(word.isin(*words), name)
    kind = kind.when(action.isNotNull(), "action").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(kind == "action", action).alias("action"))


def settle_action(kind: Column, requested: Column) -> Column:
    """The action to record for this kind of review, NULL when it is not offered.

    A structural review asks a yes/no question, so confirm and reject are read
    as its answers.
    """
    action = (
        F.when((kind == "structural") & (requested == "confirm"), "needs_fixing")
        .when((kind == "structural") & (requested == "reject"), "looks_right")
        .otherwise(requested)
    )
    offered = F.lit(False)
    for name, actions in K.ACTIONS_FOR.items():
        offered = offered | ((kind == name) & action.isin(*actions))
    return F.when(offered, action)


def outcome_of(action: Column) -> Column:
    return choose(action, K.OUTCOME_OF_ACTION)


def decision_of(action: Column) -> Column:
    return choose(action, K.DECISION_OF_ACTION)
