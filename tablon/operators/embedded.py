"""State embedded in pages, and pages that are blocks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the element that holds a page's state.
STATE = r'(?s)<script\s+id="__NEXT_DATA__"\s+type="application/json"\s*>(.*?)</script>'
# Fixed value: texts of challenge pages.
CHALLENGE = (
    r"(?i)just a moment|checking your browser|cf-?chl|/cdn-cgi/challenge|attention required|enable javascript and cookies|"
    r"datadome|px-captcha|perimeterx|hcaptcha|recaptcha|are you a human|unusual traffic|verify you are human"
)


def page_state(html: Column) -> Column:
    """The JSON text of a page's embedded state; null without one or if it is no JSON."""
    text = F.nullif(F.regexp_extract(html, STATE, 1), F.lit(""))
    return F.when(F.try_parse_json(text).isNotNull(), text)


def state_value(state: Column, path: str) -> Column:
    """The text at a known path (``$.a.b``) of a state."""
    return F.get_json_object(state, path)


def find_key(key: str, depth: int = 30):
    """Column function: JSON of the first value of ``key`` in a state, itself before what lies below, in the
    document's order, on ``depth`` levels of which the whole is the first; null if there is none or it is null."""

    @F.pandas_udf(T.StringType())
    def find(states: pd.Series) -> pd.Series:
        return pd.Series([_found(_parsed(text), key, depth) for text in states], dtype=object)

    return find


def _parsed(text: str | None):
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


def _found(node, key: str, depth: int) -> str | None:
    """JSON of the first value of ``key``; goes level by level on a stack of its own, so deep states don't fail."""
    open_ = [(node, 1)]
    while open_:
        here, level = open_.pop()
        if level > depth or not isinstance(here, (dict, list)):
            continue
        if isinstance(here, dict) and key in here:
            if here[key] is not None:
                return json.dumps(here[key], ensure_ascii=False)
            continue
        below = here.values() if isinstance(here, dict) else here
        open_ += [(x, level + 1) for x in reversed(list(below))]
    return None


def found_keys(keys: list[str], depth: int = 30):
    """Column function: map of those ``keys`` that a state has with a value, to its JSON; the state is parsed once."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def find(states: pd.Series) -> pd.Series:
        def one(text):
            node = _parsed(text)
            return {k: v for k in keys if (v := _found(node, k, depth)) is not None}

        return pd.Series([one(text) for text in states], dtype=object)

    return find


def stored_files(snapshots: Column) -> Column:
    """Of a JSON list of stored pages, those records (as maps) that name their file; none if it is no list."""
    records = F.from_json(snapshots, "array<map<string,string>>")
    none = F.array().cast("array<map<string,string>>")
    return F.coalesce(F.filter(records, lambda r: F.coalesce(F.try_element_at(r, F.lit("archivo")) != "", F.lit(False))), none)


def block_reason(status: Column, html: Column) -> Column:
    """Why a response is a block: its status, or a challenge in its first 20,000 characters; else null."""
    challenge = F.coalesce(F.substring(html, 1, 20_000).rlike(CHALLENGE), F.lit(False))
    return F.when(status.isin(403, 429), F.concat(F.lit("HTTP "), status.cast("string"))).when((status == 503) & challenge, "HTTP 503, desafío").when(challenge, "desafío")
