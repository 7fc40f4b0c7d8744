"""Postal addresses of one place, however they are written.

A gazetteer is made of the addresses themselves: words are corrected to frequent ones, the spellings of
streets and estates are clustered within their localities, and each cluster is a street with an identifier. Every
address is then resolved by a beam search over the gazetteer's entries (where the name begins and ends), and
addresses meet on the street's identifier and the number or lot. Units of a building are one place here, so the
unit isn't part of the join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablon.llm.canonical import UNLISTED, listings_entries, plain_words, sound, unedited_share
from tablon.llm.components import connected_components
from tablon.llm.pairs import member_pairs
from tablon.llm.setjoin import grams, similarity_join
from tablon.session import cut_lineage, spread

# Words of Spanish addresses.
STREET_TYPES = "calle ca cl c/ avenida avda av ave jiron jron jr pasaje psje pje pj carretera prolongacion prol malecon mlc alameda"
ESTATE_TYPES = "urb urbanizacion res residencial asoc coop conjunto"
CONNECTORS = {"de", "del", "la", "las", "los", "el", "d", "l", "y", "al", "der"}
BLOCK = re.compile(r"\b(?:manzana|mza|mz)[. ]*([a-z]{0,2} ?\d{0,3}[a-z]?)[ ,.;/-]*(?:lote|lte|lt)[. ]*(\d+[a-z]?)\b")
UNIT = re.compile(r"\b(?:departamento|depto|dpto|dep|oficina|ofic|of|interior|int|piso)[. ]*(?:n[ro]*[. ]*|#)?\d+[a-z]?\b")
ASIDE = re.compile(
    r"\(.*?\)|\bref(?:erencia)?[.:].*$|\ba (?:media|una|\d+) (?:cuadras?|min).*$|\b(?:frente|cerca) (?:a|al|del?)\b.*$|\ba \d+ (?:m|mts|metros|minutos)\b.*$"
)
# A number with a mark may have any length; without one it has two to six figures (longer ones are telephones'), or is one
# figure that ends its part behind a name. A letter may follow at once or behind a dash: 1234B, 123-A.
_LETTER = r"(?:-?[a-z](?![a-z0-9/.]))?"
NUMBER = re.compile(
    rf"(?:\b(?:numero|nro|num|no|n)[. ]*|#\s*)(\d+{_LETTER})(?![a-z0-9])|(?<![\w.])(\d{{2,6}}{_LETTER})(?![a-z0-9]|[.]\d)|(?<=[a-z] )(\d{_LETTER})(?=\s*(?:[,;|/]|-\s|$))"
)
_TYPE = re.compile(rf"(?:^|(?<=\s))(?:{'|'.join(re.escape(t) for t in STREET_TYPES.split() if t != 'alameda')})(?:\.\s*|\s+)(?=\S)")
_ESTATE = re.compile(rf"(?:^|(?<=\s))(?:{'|'.join(ESTATE_TYPES.split())})(?:\.\s*|\s+)(?=\S)")
_PARTS = re.compile(r"[,;|]|\s[-/]\s")

LONGEST_NAME = 12  # words of the longest hypothesis but that of all words, connectors left out
LONGEST_WORD = 30  # letters; longer words aren't corrected
NEAR_NAMES = 0.4  # Jaccard similarity of letter pairs from which two spellings within a locality are compared
SAME_SPELLING = 0.8  # share of characters without edits from which two spellings may be one name
RARER = 3  # a word is a misspelling of one that is this many times as frequent


def plain_address(text: str) -> str:
    folded = unicodedata.normalize("NFD", text.lower().replace("°", "o").replace("º", "o"))
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).split())


def content_words(text: str) -> list[str]:
    return [w for w in re.findall(r"[a-z]+", text) if w not in CONNECTORS]


def parse_address(text: str | None) -> dict | None:
    """What an address states: ``number`` or ``block`` and ``lot``; ``words``, those of the name and of
    what may stand beside it, nearest the number first to be taken (``front``) or last; whether these
    are the name alone (``clean``); and ``phrases`` that may be a locality. None without number or lot."""
    if not text:
        return None
    s = UNIT.sub(" ", ASIDE.sub(" ", plain_address(text)))
    m = BLOCK.search(s)
    if m and (m.group(1).strip() or m.group(2)):
        rest = [p.strip() for p in _PARTS.split(s[: m.start()] + " | " + s[m.end() :]) if p.strip(" .")]
        names, phrases, clean = [], [], False
        for part in rest:
            cut = _ESTATE.split(part, 1)
            if len(cut) == 2:
                clean = not names
                names = [cut[1]]
                if cut[0].strip():
                    phrases.append(cut[0])
            else:
                phrases.append(part)
        if not names:
            # Without a mark the name is the first part that isn't the locality, which is told later.
            names = [" | ".join(phrases)]
        ends = _ends(names[0].split()) if "|" not in names[0] else []
        return {
            "number": "", "block": m.group(1).replace(" ", ""), "lot": m.group(2), "words": content_words(names[0]), "after": [],
            "name": names[0], "front": True, "clean": clean, "phrases": phrases + ends,
        }
    m = NUMBER.search(s)
    if not m:
        return None
    before, after = s[: m.start()], s[m.end() :]
    left, right = _PARTS.split(before), _PARTS.split(after)
    # The name is behind a number that begins its part, or that a street's type follows.
    front = not left[-1].strip(" .") or bool(_TYPE.match(right[0].strip()) and not _TYPE.search(left[-1]))
    own = right[0] if front else left[-1]
    others = [*left, *right[1:]] if front else [*left[:-1], *right]
    phrases = [p for p in others if p.strip(" .") and not _ESTATE.search(p)]
    for part in others:
        cut = _ESTATE.split(part, 1)
        if len(cut) == 2:
            phrases += [p for p in [cut[0], *_ends(cut[1].split())] if p.strip(" .")]
    # Without any type, it may also be behind a number in the middle.
    after = [] if front or _TYPE.search(own) else content_words(_ESTATE.split(right[0], 1)[0])
    typed = _TYPE.split(own, 1)
    if len(typed) == 2:
        name, lead = typed[1], typed[0]
        if lead.strip(" ."):
            phrases += [lead, *_ends(_ESTATE.sub(" ", lead).split())]
    else:
        name = own
    cut = _ESTATE.split(name, 1)
    if len(cut) == 2:
        name, lost = (cut[0], cut[1]) if front else (cut[1], cut[0])
        phrases += [p for p in [lost, *_ends(lost.split())] if p.strip(" .")]
    words = content_words(name)
    if len(words) > 2:
        phrases += _ends(name.split())
    phrases += [e for p in phrases if len(p.split()) > 4 for e in _ends(p.split())]
    return {
        "number": _plain_number(next(g for g in m.groups() if g)), "block": "", "lot": "", "words": words, "after": after, "name": name, "front": front,
        "clean": len(cut) == 1 and not after and (len(words) <= 2 or len(typed) == 2 and not front), "phrases": phrases,
    }


def _plain_number(text: str) -> str:
    figures = re.match(r"\d+", text).group()
    return str(int(figures)) + text[len(figures) :].lstrip("-")


def _ends(words: list[str]) -> list[str]:
    """The first and the last one to five words, from six letters on."""
    n = range(1, min(5, len(words)) + 1)
    return [p for p in dict.fromkeys([" ".join(words[:k]) for k in n] + [" ".join(words[-k:]) for k in n]) if len(p) >= 6]


PARSED = "id long, number string, block string, lot string, words array<string>, after array<string>, front boolean, clean boolean, name string, phrases array<string>"

FIELDS = ["number", "block", "lot", "words", "after", "front", "clean", "name", "phrases"]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, parse_address(t)) for i, t in zip(batch["id"], batch["address"])]
        yield pd.DataFrame(
            [(i, *(p[k] for k in FIELDS)) for i, p in rows if p], columns=["id", *FIELDS]
        )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletions(words: pd.Series) -> pd.Series:
    """A word and what is left of it without one letter, or without two if it has seven or more:
    words that one or two edits tell apart share one of these."""

    def of(w: str) -> list[str]:
        once = {w[:i] + w[i + 1 :] for i in range(len(w))}
        twice = {v[:i] + v[i + 1 :] for v in once for i in range(len(v))} if len(w) >= 7 else set()
        return sorted({w} | once | twice)

    return words.map(of)


def corrections(words: DataFrame) -> DataFrame:
    """``word, right``: words (``word``, one row for each use) that are misspellings of a much more
    frequent one: one edit away, or two if they have eight letters or more. They meet by an equi-join
    on what is left without one or two letters, which loses none. Words of under four letters, such
    as the numerals of stages, and of over LONGEST_WORD stay as they are."""
    counts = cut_lineage(spread(words.groupBy("word").agg(F.count("*").alias("n")).where(F.length("word").between(4, LONGEST_WORD))))
    left = counts.select(F.col("word").alias("left_id"), F.col("n").alias("na"), F.explode(_deletions("word")).alias("rest"))
    targets = counts.where(F.col("n") >= RARER)  # a word used less often can't be RARER times as frequent
    right = targets.select(F.col("word").alias("right_id"), F.col("n").alias("nb"), F.explode(_deletions("word")).alias("rest"))
    rated = left.join(right, "rest").where(F.col("nb") >= RARER * F.col("na")).select("left_id", "right_id", "nb").distinct()
    size = F.greatest(F.length("left_id"), F.length("right_id"))
    edits = F.round((1 - unedited_share(F.col("left_id"), F.col("right_id"))) * size)
    good = rated.withColumn("e", edits).where(F.col("e") <= F.when(size >= 8, 2).otherwise(1))
    best = F.max_by("right_id", F.struct(-F.col("e"), "nb", "right_id")).alias("right")
    return good.groupBy("left_id").agg(best).withColumnRenamed("left_id", "word")


def _corrected(parsed: DataFrame) -> DataFrame:
    """``parsed`` with its words corrected."""
    each = parsed.select("id", F.posexplode(F.concat("words", "after")).alias("pos", "word"))
    fixed = each.join(corrections(each.select("word")), "word", "left").select("id", "pos", F.coalesce("right", "word").alias("word"))
    back = fixed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("all"))
    none, n = F.array().cast("array<string>"), F.size("words")
    return parsed.join(back, "id", "left").withColumn("all", F.coalesce("all", none)).withColumns(
        {"words": F.when(n > 0, F.slice("all", F.lit(1), n)).otherwise(none), "after": F.slice("all", n + 1, F.greatest(F.size("after"), F.lit(0)))}
    ).drop("all")


def stated_localities(parsed: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, locality, phrase``: the list entry that an address names, and in which words. Distinct
    phrases are compared with the names (also with the first word's initial) and aliases; the nearest counts. Phrases
    of under six letters must be a name as it stands, and so must parts of longer ones. A form that several entries
    have names none of them."""
    each = parsed.select("id", F.explode("phrases").alias("phrase"))
    phrases = each.select("phrase").distinct().withColumn("letters", F.array_join(plain_words(F.col("phrase")), ""))
    phrases = cut_lineage(spread(phrases.where(F.length("letters") >= 2), "letters"))  # read three times
    names = entries.select(F.col("distrito_id").alias("entry"), plain_words(F.col("nombre")).alias("w"))
    initial = F.concat(F.array(F.substring(F.get("w", F.lit(0)), 1, 1)), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))))
    ways = names.select("entry", F.explode(F.array(F.col("w"), F.when(F.size("w") > 1, initial).otherwise(F.col("w")))).alias("w"))
    ways = ways.unionAll(aliases.select("distrito_id", plain_words(F.col("alias_texto"))))
    forms = ways.select("entry", F.array_join("w", "").alias("form")).where("form <> '' and entry is not null")
    forms = cut_lineage(forms.groupBy("form").agg(F.min("entry").alias("entry"), F.max("entry").alias("other")).where("entry = other").drop("other"))
    distinct = phrases.select("letters").distinct()
    known = distinct.join(forms, F.col("letters") == F.col("form"), "left")
    exact = known.where("entry is not null").select("letters", "entry", F.lit(1.0).alias("score"))
    left = spread(known.where("entry is null and length(letters) >= 6").select(F.col("letters").alias("id"))).select("id", grams(F.col("id")).alias("tokens"))
    right = forms.where("length(form) >= 6").select(F.col("form").alias("id"), grams(F.col("form")).alias("tokens"))
    near = similarity_join(left, right, 0.35).select("left_id", "right_id")
    rated = near.select("left_id", "right_id", F.greatest(
        unedited_share(F.col("left_id"), F.col("right_id")), unedited_share(sound(F.col("left_id")), sound(F.col("right_id")))
    ).alias("score")).where(F.col("score") >= SAME_SPELLING)
    # Short words are near to many: they must begin alike.
    rated = rated.where((F.least(F.length("left_id"), F.length("right_id")) >= 9) | (F.substring("left_id", 1, 1) == F.substring("right_id", 1, 1)))
    close = rated.join(forms, F.col("right_id") == F.col("form")).select(F.col("left_id").alias("letters"), "entry", F.col("score") * 0.99)
    best = exact.unionAll(close).groupBy("letters").agg(F.max(F.struct("score", (-F.col("entry")).alias("e"))).alias("b"))
    named = phrases.join(best, "letters").select("phrase", F.col("b.score").alias("score"), (-F.col("b.e")).alias("locality"))
    hit = each.join(named, "phrase")
    top = hit.groupBy("id").agg(F.max(F.struct("score", F.length("phrase").alias("n"), "phrase", "locality")).alias("h"))
    return top.select("id", F.col("h.locality").alias("locality"), F.col("h.phrase").alias("phrase"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lot_words(name: pd.Series, phrase: pd.Series, words: pd.Series) -> pd.Series:
    """Words of an estate's name without those of the locality: of several parts the first other one."""
    out = []
    for n, p, w in zip(name, phrase, words):
        parts = [x.strip() for x in n.split("|")]
        if len(parts) > 1:
            own = next((x for x in parts if x and x != (p or "").strip()), "")
            skip = len([y for x in parts[: parts.index(own)] for y in content_words(x)]) if own else 0
            out.append(list(w)[skip : skip + len(content_words(own))])
        elif p and n.strip().endswith(p.strip()) and n.strip() != p.strip():
            out.append(list(w)[: len(content_words(n)) - len(content_words(p))])
        elif p and n.strip().startswith(p.strip()) and n.strip() != p.strip():
            out.append(list(w)[len(content_words(p)) :])
        else:
            out.append(list(w))
    return pd.Series(out)


def gazetteer(names: DataFrame) -> DataFrame:
    """``locality, kind, name, entry, n``: every spelling (``names``: locality, kind, name, a row for each use) with the main
    spelling of its street, which is the most frequent one, and how often the street is named.

    A spelling that has a word of under RARER uses may be a misspelling (others of one were corrected by their words). These
    are joined with all spellings of their locality and kind by similarity of letter pairs; of two with SAME_SPELLING
    unedited letters, one that is RARER times as frequent takes the other in, and connected components make the
    clusters. So a misspelling is told by the same street at other numbers. Stages (I, II) keep names apart."""
    spelled = cut_lineage(names.where("name <> ''").groupBy("locality", "kind", "name").agg(F.count("*").alias("n")).withColumn("i", F.monotonically_increasing_id()))
    scope = F.concat_ws("|", F.coalesce("locality", F.lit(0)).cast("string"), "kind", F.lit(""))
    sets = spelled.select(F.col("i").alias("id"), F.transform(grams(F.col("name")), lambda g: F.concat(scope, g)).alias("tokens"))
    words = spelled.select("i", "n", F.explode(F.split("name", " ")).alias("word"))
    rare = words.groupBy("word").agg(F.sum("n").alias("uses")).where(F.col("uses") < RARER)
    odd = words.join(rare, "word", "left_semi").select(F.col("i").alias("id")).distinct()
    near = similarity_join(sets, sets.join(odd, "id", "left_semi"), NEAR_NAMES).where("left_id <> right_id")
    stage = F.regexp_extract("name", r"\b(i+v?|iv)\b", 1).alias("stage")
    facts = spelled.select("i", "name", "n", stage)
    both = near.join(facts.toDF("left_id", "x", "nx", "sx"), "left_id").join(facts.toDF("right_id", "y", "ny", "sy"), "right_id")
    length = [F.length("x"), F.length("y")]
    both = both.where((F.col("sx") == F.col("sy")) & (F.col("nx") >= RARER * F.col("ny")) & (F.least(*length) >= SAME_SPELLING * F.greatest(*length) - 1e-9))
    same = both.where(unedited_share(F.col("x"), F.col("y")) >= SAME_SPELLING)
    streets = connected_components(same, "left_id", "right_id")
    known = spelled.join(streets, spelled["i"] == streets["vertex"], "left").withColumn("street", F.coalesce("component", "i"))
    mains = known.groupBy("street").agg(F.max_by("name", F.struct("n", "name")).alias("entry"), F.sum("n").alias("total"))
    return cut_lineage(known.join(mains, "street").select("locality", "kind", "name", "entry", F.col("total").alias("n")))


def _street_names(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, locality, number, name, k``: the gazetteer's entry that the words at the number name, found by a beam search: a
    hypothesis for each stretch of one to LONGEST_NAME words, and of all words, next to the number, on the side where it
    may be. Each is looked up among the locality's entries and weighed by how often that street, and that spelling in any
    locality, is named, and by how many names have as many words; the best stays. Where no stretch is an entry, the best
    one is a new one."""
    clean = rows.where("clean and size(words) > 0").select(F.array_join("words", " ").alias("name"), F.size("words").alias("k"))
    lengths = clean.groupBy("k").agg(F.count("*").alias("nk"))
    total = F.sum("nk").over(Window.partitionBy(F.lit(1)))
    shares = lengths.select("k", (F.col("nk") / total).alias("share")).where(F.col("k") <= LONGEST_NAME)  # as many rows as lengths
    local = entries.where("kind = 's'").select("locality", "name", "entry", F.col("n").alias("nl"))
    everywhere = clean.groupBy("name").agg(F.count("*").alias("ng"))
    sides = rows.select("id", "locality", "words", "front").unionAll(rows.select("id", "locality", "after", F.lit(True))).where("size(words) > 0")
    size = F.size("words")
    stretches = F.sequence(F.lit(1), F.least(size, F.lit(LONGEST_NAME)))
    beam = sides.select("id", "locality", "words", "front", F.explode(F.array_union(stretches, F.array(size))).alias("k"))
    part = F.when(F.col("front"), F.slice("words", F.lit(1), F.col("k"))).otherwise(F.slice("words", -F.col("k"), F.col("k")))
    beam = beam.select("id", "locality", "k", F.array_join(part, " ").alias("name"))
    weighed = (
        beam.join(local, ["locality", "name"], "left").join(everywhere, "name", "left").join(F.broadcast(shares), "k", "left")
        .withColumn("weight", F.log(F.coalesce("share", F.lit(0.0)) + 1e-6) + F.log(1 + 10 * F.coalesce("nl", F.lit(0)) + F.coalesce("ng", F.lit(0))))
    )
    best = weighed.groupBy("id").agg(F.max(F.struct("weight", "k", "name", "entry")).alias("h"))
    return best.select("id", F.coalesce("h.entry", "h.name").alias("name"))


def resolved_addresses(listings: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, locality, name, place``: each address with its locality (null if unknown), the gazetteer's name of its
    street or estate, and its number or block and lot in one text."""
    once = listings.select("anuncio_id", "ubicacion", "distrito").where("anuncio_id is not null and ubicacion is not null").dropDuplicates(["anuncio_id"])
    parsed = cut_lineage(once.select(F.col("anuncio_id").alias("id"), F.col("ubicacion").alias("address")).mapInPandas(_parse, PARSED))
    typed = listings_entries(once, entries, aliases).where(F.col("distrito_id") != UNLISTED)
    rows = (
        _corrected(parsed)
        .join(stated_localities(parsed, entries, aliases), "id", "left")
        .join(typed.select(F.col("anuncio_id").alias("id"), F.col("distrito_id").alias("typed")), "id", "left")
        .withColumn("locality", F.coalesce(F.col("locality").cast("bigint"), "typed"))
    )
    lot_name = F.when(F.col("number") == "", F.array_join(_lot_words(F.col("name"), F.col("phrase"), F.col("words")), " ")).alias("estate")
    rows = cut_lineage(rows.select("id", "number", "block", "lot", "words", "after", "front", "clean", "locality", lot_name))
    numbered, lots = rows.where("number <> ''"), rows.where("number = ''")
    clean = numbered.where("clean and size(words) > 0").select("locality", F.lit("s").alias("kind"), F.array_join("words", " ").alias("name"))
    known = gazetteer(clean.unionAll(lots.select("locality", F.lit("e"), F.col("estate"))).where("locality is not null"))
    streets = numbered.join(_street_names(numbered, known), "id").select("id", "locality", "name", F.col("number").alias("place"))
    place = F.concat_ws(" ", F.lit("mz"), "block", F.lit("lt"), "lot").alias("place")
    estates = known.where("kind = 'e'").select("locality", F.col("name").alias("estate"), "entry")
    named = lots.join(estates, ["locality", "estate"], "left").select("id", "locality", F.coalesce("entry", "estate").alias("name"), place)
    # A block and lot without an estate's name are the locality's own.
    return streets.unionAll(named).where("name <> '' or place like 'mz%'")


def place_ids(resolved: DataFrame) -> DataFrame:
    """``id, place_id``: one identifier for each building or lot.

    Addresses of unknown locality get that in which their street and place are known, if it is only one. Streets (and
    estates) of a locality are numbered, and addresses meet on that number and their place. Entries that
    share a (locality, place) and are spellings of each other, however frequent, are one there: all of them are compared by
    edits and joined through connected components. Stages (I, II) keep names apart.
    """
    known = resolved.where("locality is not null")
    single = known.groupBy("name", "place").agg(F.min("locality").alias("a"), F.max("locality").alias("b")).where("a = b").select("name", "place", F.col("a").alias("found"))
    lost = resolved.where("locality is null").join(single, ["name", "place"], "left")
    rows = cut_lineage(known.unionByName(lost.select("id", F.coalesce("found", F.lit(0)).alias("locality"), "name", "place")))
    streets = rows.select("locality", "name").distinct().withColumn("street", F.monotonically_increasing_id())
    places = rows.join(cut_lineage(streets), ["locality", "name"]).select("id", "street", "place", "locality", "name")
    spots = cut_lineage(places.groupBy("street", "place", "locality", "name").agg(F.count("*").alias("n")).withColumn("spot", F.monotonically_increasing_id()))
    staged = spots.select("spot", "locality", "place", "name", F.regexp_extract("name", r"\b(i+v?|iv)\b", 1).alias("stage"))
    pairs = staged.join(staged.select(F.col("spot").alias("other_spot"), F.col("name").alias("other"), "locality", "place", "stage"), ["locality", "place", "stage"]).where("name < other")
    # There are as many edits at least as the lengths differ by.
    length = [F.length("name"), F.length("other")]
    pairs = pairs.where(F.least(*length) >= SAME_SPELLING * F.greatest(*length) - 1e-9)
    same = pairs.where(unedited_share(F.col("name"), F.col("other")) >= SAME_SPELLING)
    clusters = connected_components(same, "spot", "other_spot")
    final = spots.join(clusters, spots["spot"] == clusters["vertex"], "left").select("street", "place", F.coalesce("component", "spot").alias("place_id"))
    return places.select("id", "street", "place").join(final, ["street", "place"]).select("id", "place_id")


def same_address_pairs(listings: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``anuncio_a, anuncio_b`` (a < b): all pairs of listings whose address denotes one building or lot.

    Units of a building are one place; equal streets of two localities are two. The locality is
    the one that the address names, else that of ``distrito``. Addresses without number or lot, null
    and blank ones denote no place. Listings delivered twice count once; texts of any length are
    parsed whole. Pairs are made last, from the membership (``place_ids``); places of many listings are dealt
    out to several tasks.
    """
    return member_pairs(place_ids(resolved_addresses(listings, entries, aliases)), "place_id", "id").toDF("anuncio_a", "anuncio_b")
