"""Values typed freely, mapped to the entries of a reference list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablon.functions.text import strip_accents
from tablon.llm.setjoin import grams, similarity_join
from tablon.session import cut_lineage, spread

CANDIDATE = 0.25  # Jaccard similarity from which an entry is a candidate
SURE = 0.45  # Jaccard similarity that is enough
CLOSE = 0.75  # or else this share of characters that edits leave alone
UNLISTED = -1
# Usual abbreviations in Spanish place names.
ABBREVIATIONS = {
    "sta": "santa", "sto": "santo", "sn": "san", "stgo": "santiago", "vlla": "villa", "nva": "nueva",
    "nvo": "nuevo", "est": "estacion", "qda": "quebrada", "qbda": "quebrada", "pto": "puerto",
    "pte": "puente", "mcal": "mariscal", "mrcal": "mariscal", "cmdte": "comandante", "cdte": "comandante",
    "cmte": "comandante", "dr": "doctor", "ing": "ingeniero", "pblo": "pueblo", "pta": "punta",
    "hda": "hacienda", "snrio": "senorio", "vgen": "virgen", "cdad": "ciudad", "co": "cerro",
}
_GENERIC = r"^(?:(?:distrito|dist|zona|sector) de|dist|distrito) +(?=[a-z])"


def plain_words(value: Column) -> Column:
    """Words of ``a-z``, accents, figures and signs dropped, abbreviations written out."""
    letters = F.trim(F.regexp_replace(strip_accents(F.lower(F.regexp_replace(value, "°", "o"))), r"[^a-z]+", " "))
    words = F.split(F.regexp_replace(letters, _GENERIC, ""), " ")
    text = F.lit(";".join(f"{k}={v}" for k, v in ABBREVIATIONS.items()))
    table = F.str_to_map(text, F.lit(";"), F.lit("="))
    return F.filter(F.transform(words, lambda w: F.coalesce(table[w], w)), lambda w: w != "")


def sound(letters: Column) -> Column:
    """Letters as Spanish ears hear them: ``qu``, ``k`` and ``c`` are one, so are ``ll`` and
    ``y``, ``b`` and ``v``, ``s``, ``z`` and soft ``c``, ``j`` and soft ``g``; letters aren't doubled."""
    s = letters
    for pattern, to in (
        ("qu", "k"), ("q", "k"), ("ll", "y"), ("v", "b"), ("z", "s"), ("w", "hu"), ("c(?=[ei])", "s"),
        ("ch", "#"), ("c", "k"), ("#", "ch"), ("g(?=[ei])", "j"), (r"(.)\1+", "$1"),
    ):
        s = F.regexp_replace(s, pattern, to)
    return s


def _edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that make ``b`` of ``a``."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


WIDE = 48  # letters of a pair that is computed together with others; longer ones go one by one


def edit_counts(a: list[str], b: list[str]) -> np.ndarray:
    """``_edits`` of many pairs of short texts at once: one row of the table for all pairs at a time."""
    n, wide, high = len(a), max(map(len, b), default=0), max(map(len, a), default=0)
    lengths_a, lengths_b = np.array([*map(len, a)], np.int32), np.array([*map(len, b)], np.int32)
    out = lengths_b.copy()
    if not n or not high:
        return out
    x = np.array(a, dtype=f"U{high}").view(np.uint32).reshape(n, high)
    y = np.array(b, dtype=f"U{max(wide, 1)}").view(np.uint32).reshape(n, max(wide, 1))
    steps = np.arange(y.shape[1] + 1, dtype=np.int32)
    older, before = None, np.broadcast_to(steps, (n, len(steps))).copy()
    for i in range(1, high + 1):
        differ = x[:, i - 1, None] != y
        best = np.minimum(before[:, :-1] + differ, before[:, 1:] + 1)
        if older is not None:
            swap = ~differ[:, :-1] & (x[:, i - 2, None] == y[:, 1:])
            best[:, 1:] = np.where(swap, np.minimum(best[:, 1:], older[:, :-2] + 1), best[:, 1:])
        # An insertion carries a cell to all that follow, at one each.
        row = np.concatenate([np.full((n, 1), i, np.int32), best], axis=1) - steps
        older, before = before, np.minimum.accumulate(row, axis=1) + steps
        ends = lengths_a == i
        out[ends] = before[ends, lengths_b[ends]]
    return out


@F.pandas_udf(T.DoubleType())
def unedited_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 less the edits per character of the longer text."""
    longest = np.maximum(np.maximum(a.str.len(), b.str.len()).to_numpy(np.int64), 1)
    edits = np.zeros(len(a), np.int64)
    short = longest <= WIDE
    for rows in np.array_split(np.flatnonzero(short), max(1, int(short.sum()) // 4096)):
        edits[rows] = edit_counts(a.iloc[rows].tolist(), b.iloc[rows].tolist())
    for i in np.flatnonzero(~short):
        edits[i] = _edits(a.iloc[i], b.iloc[i])
    return pd.Series(1 - edits / longest)


def entry_forms(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``form, letters, distrito_id`` (``form`` as it sounds): the ways in which an entry may be written: its name, also with its
    province before or behind, with the first word's initial, cut after any word where that is only
    its own, and its aliases. Forms that sound alike stay apart, so their letters can tell their entries."""
    e = entries.select("distrito_id", plain_words(F.col("nombre")).alias("w"), plain_words(F.col("provincia")).alias("p"))
    # Cuts of one, two, ... words; those that several entries share say nothing.
    cuts = e.select("distrito_id", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"), "w").where("k < size(w)")
    cuts = cuts.select("distrito_id", F.slice("w", F.lit(1), F.col("k")).alias("c"))
    cuts = cuts.where((F.size("c") > 1) | (F.length(F.get("c", F.lit(0))) >= 6))
    own = cuts.groupBy("c").agg(F.min("distrito_id").alias("distrito_id"), F.count("*").alias("n")).where("n = 1")
    initial = F.concat(F.array(F.substring(F.get("w", F.lit(0)), 1, 1)), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))))
    prov = F.array(F.lit("prov"))
    ways = F.array(
        F.col("w"), F.concat("w", "p"), F.concat("p", "w"), F.concat("w", prov, "p"), F.when(F.size("w") > 1, initial).otherwise(F.col("w")),
    )
    forms = (
        e.select(F.explode(ways).alias("form"), "distrito_id")
        .unionAll(own.select(F.col("c").alias("form"), "distrito_id"))
        .unionAll(aliases.select(plain_words(F.col("alias_texto")).alias("form"), "distrito_id"))
    )
    letters = forms.select(F.array_join("form", "").alias("letters"), "distrito_id").where("letters <> ''").distinct()
    return letters.select(sound(F.col("letters")).alias("form"), "letters", "distrito_id")


def map_to_entries(values: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``letters, distrito_id`` for distinct folded values (``letters``): the entry that is meant, or -1.

    Forms of entries come near by a set-similarity join on pairs of sounds; of the candidates, the
    one with the greatest sum of Jaccard similarity and unedited share (of letters or sounds) is kept
    (ties: the least ``distrito_id``) if either is high enough. A value without candidates is unlisted.
    """
    sounds = cut_lineage(values.select("letters", sound(F.col("letters")).alias("sound")))
    left = spread(sounds.select(F.col("sound").alias("id")).distinct(), "id").select("id", grams(F.col("id")).alias("tokens"))
    forms = cut_lineage(entry_forms(entries, aliases))
    right = forms.select(F.col("form").alias("id")).distinct().select("id", grams(F.col("id")).alias("tokens"))
    found = similarity_join(left, right, CANDIDATE)
    found = found.join(forms.withColumnRenamed("letters", "form_letters"), F.col("right_id") == F.col("form"))
    found = found.join(sounds, F.col("left_id") == F.col("sound"))
    kept = F.greatest(unedited_share(F.col("sound"), F.col("form")), unedited_share(F.col("letters"), F.col("form_letters")))
    # Short forms are near to many words: they must begin alike.
    alike = (F.length("form") > 6) | (F.substring("sound", 1, 1) == F.substring("form", 1, 1))
    scored = found.select(F.col("letters").alias("__letters"), "distrito_id", "jaccard", kept.alias("kept"), alike.alias("alike"))
    good = scored.where("alike").where((F.col("jaccard") >= SURE) | (F.col("kept") >= CLOSE))
    best = good.groupBy("__letters").agg(
        F.max(F.struct((F.col("jaccard") + F.col("kept")).alias("s"), (-F.col("distrito_id")).alias("d"))).alias("b")
    )
    return values.join(best, values["letters"] == best["__letters"], "left").select(
        "letters", F.coalesce(-F.col("b.d"), F.lit(UNLISTED)).cast("bigint").alias("distrito_id")
    )


def listings_entries(listings: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``anuncio_id, distrito_id``: every listing whose ``distrito`` is neither null nor blank, with the
    entry that is meant or -1. Each spelling is mapped once, however many listings have it, so a hot
    spelling costs nothing; spellings meet their listings by a join on the text as typed. Listings
    delivered twice count once. An empty list leaves all unlisted."""
    once = listings.select("anuncio_id", "distrito").where(F.trim("distrito") != "").dropDuplicates(["anuncio_id"])
    # Spellings, far fewer than listings, are written: what follows reads them several times.
    spelled = cut_lineage(once.select("distrito").distinct().select("distrito", F.array_join(plain_words(F.col("distrito")), "").alias("letters")))
    mapped = map_to_entries(spelled.select("letters").distinct(), entries, aliases)
    by_spelling = spelled.join(mapped, "letters").select("distrito", "distrito_id")
    return once.join(by_spelling, "distrito").select("anuncio_id", "distrito_id")
