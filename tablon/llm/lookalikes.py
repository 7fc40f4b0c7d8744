"""One form for texts that look the same: width, combining marks, spaces, invisible characters and
look-alike letters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablon.llm.pairs import member_pairs
from tablon.session import cut_lineage

# Letters of other scripts, and a few signs, that look like the character below them.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮѴԌԚԜӀаеорсухѕіјһԁԛԝѵӏү"
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ"
        "ՕՏԼօսոհզցյ"
        "ɑɡ"
        "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ‐‑․",
        "ABESIJKMHOPCTYXYVGQWIaeopcyxsijhdqwvly"
        "ABEZHIKMNOPTYXCJovcj"
        "OSLounhqgj"
        "ag"
        "IVXLCDMivxlcdm--.",
    )
)
# Format characters that are visible, so they stay.
VISIBLE_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}"
#: Stands for a joiner between emoji, which is visible: without it they fall apart. A noncharacter.
JOINER = "﷐"


def _all_characters() -> range:
    return range(0x110000)


def _class(codes: set[int]) -> str:
    """A regex class of code points, as ranges."""
    out, codes_sorted = [], sorted(codes)
    start = last = codes_sorted[0]
    for c in [*codes_sorted[1:], -1]:
        if c != last + 1:
            out.append(f"\\x{{{start:X}}}" + (f"-\\x{{{last:X}}}" if last > start else ""))
            start = c
        last = c
    return "".join(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str], str, str]:
    """Code point -> its decomposition with look-alikes replaced, where that isn't itself; base and
    mark -> composed letter; and the regex classes of what attaches to a character before
    it, and of usual characters that are in their form. From the Unicode data of this Python."""
    apart: dict[str, str] = {}
    together: dict[str, str] = {}
    attached: set[int] = set()
    special: set[int] = set()
    for code in _all_characters():
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co"):
            continue
        if kind == "Cf" and code not in VISIBLE_FORMATS:
            apart[c] = ""
            attached.add(code)
            continue
        if unicodedata.combining(c):
            attached.add(code)
        how = unicodedata.decomposition(c)
        if kind == "Zs":
            flat = " "
        elif code in (0x85, 0x2028, 0x2029, 0x0D):
            flat = "\n"
        elif how.startswith(("<wide>", "<narrow>")):
            flat = unicodedata.normalize("NFD", chr(int(how.split()[1], 16)))
        else:
            flat = unicodedata.normalize("NFD", c)
        flat = "".join(LOOKALIKES.get(x, x) for x in flat)
        if flat != c:
            apart[c] = flat
            marks_only = all(unicodedata.combining(x) for x in flat[1:])
            if not (how and not how.startswith("<") and marks_only and unicodedata.normalize("NFC", flat) == c):
                special.add(code)
        if how and not how.startswith("<") and " " in how and unicodedata.normalize("NFC", how_text(how)) == c:
            base, mark = how_text(how)
            if unicodedata.combining(mark):
                together[base + mark] = c
    # A class of few ranges is quick; what it leaves out is exploded and found unchanged.
    usual = {9, 10, *range(0x20, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2040), *range(0x3041, 0x3100), *range(0x4E00, 0xA000)}
    usual |= {c for c in range(0x0410, 0x0450)}
    return apart, together, _class(attached), _class({c for c in usual if c not in special and c not in attached})


@lru_cache(maxsize=1)
def published_lookalikes(spark: SparkSession) -> dict[str, str]:
    """Cased letters of scripts that LOOKALIKES doesn't list, and Lisu ones, that the published table of confusable
    characters (Unicode's, from the ICU library that comes with Spark) has as a form of one ASCII letter. Letters of
    which that table makes one form of several (I and l) aren't told apart by it, so they are left out."""
    check = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    ascii_letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    forms: dict[str, list[str]] = {}
    for x in [*ascii_letters, *"01|"]:
        forms.setdefault(check.getSkeleton(0, x), []).append(x)
    single = {k: v[0] for k, v in forms.items() if len(v) == 1}
    listed = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "FULLWIDTH")
    out = {}
    for code in range(0x370, 0x1F000):
        c = chr(code)
        cased = unicodedata.category(c) in ("Lu", "Ll") or 0xA4D0 <= code <= 0xA4FF
        if cased and not unicodedata.decomposition(c) and not unicodedata.name(c, "LATIN").startswith(listed):
            form = single.get(check.getSkeleton(0, c))
            if form:
                out[c] = form
    return out


def how_text(decomposition: str) -> str:
    return "".join(chr(int(x, 16)) for x in decomposition.split())


def _mapping(spark: SparkSession) -> DataFrame:
    """``cp, parts``: the parts of a code point with their combining classes. Bounded by Unicode:
    about 16,000 rows, most of them Han compatibility forms."""
    apart = _tables()[0]
    marks = {chr(c) for c in _all_characters() if unicodedata.combining(chr(c))}
    apart = apart | published_lookalikes(spark)
    rows = [
        (c, [(unicodedata.combining(x), x) for x in apart.get(c, c)]) for c in {*apart, *marks}
    ]
    return spark.createDataFrame(rows, "cp string, parts array<struct<ccc:int,ch:string>>")


def _recompose(parts: Column) -> Column:
    """Text of a character and its marks, in order of class: each mark that isn't blocked by one of
    its class joins the base where a composed letter exists."""
    together = _tables()[1]
    text = "\x1f".join(f"{k}\x1e{v}" for k, v in sorted(together.items()))
    pairs = F.str_to_map(F.lit(text), F.lit("\x1f"), F.lit("\x1e"))  # folded to a constant
    start = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, part: Column) -> Column:
        ch, ccc = part["ch"], part["ccc"]
        joined = pairs[F.concat(acc["base"], ch)]
        first = F.struct(F.concat(acc["base"], ch).alias("base"), acc["rest"].alias("rest"), F.lit(0).alias("last"))
        merged = F.struct(joined.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))
        kept = F.struct(acc["base"].alias("base"), F.concat(acc["rest"], ch).alias("rest"), ccc.alias("last"))
        free = (ccc != acc["last"]) & joined.isNotNull()
        return F.when(ccc == 0, first).when(free, merged).otherwise(kept)

    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["base"], acc["rest"]))


def canonical_texts(texts: DataFrame) -> DataFrame:
    """``key, canon`` for the distinct texts of ``texts`` (``key, text``; key is one text's own), as ``unusual_texts`` gives them.

    They are cut into positioned pieces: runs that are in their
    form already stay whole, every other character comes with the marks behind it. Distinct pieces of this kind
    (``piece_forms``) are exploded to code points and recomposed once, however often they occur, and meet their
    places by an equi-join; texts are put together again by position. Long texts are rows of many pieces, not one row
    in Python. Conjoining Korean letters stay as they are.
    """
    _, _, attached, usual = _tables()
    others = cut_lineage(texts)  # read twice below
    attached = rf"[\p{{M}}\p{{Cf}}&&[{attached}]]"  # the general classes are told apart first, and quickly
    joiners = rf"\x{{200D}}(?<=[{EMOJI}]\x{{FE0F}}?\x{{200D}})(?=[{EMOJI}])"
    marked = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), joiners, JOINER)
    pieces = F.regexp_extract_all(marked, F.lit(rf"(?s)[{usual}]+(?!{attached})|.{attached}*"), F.lit(0))
    cut = others.select("key", F.posexplode(pieces).alias("pos", "piece"))
    cut = cut.select("key", "pos", "piece", F.when(~F.col("piece").rlike(rf"^[{usual}]"), F.col("piece")).otherwise(F.when(F.col("piece").rlike(rf"{attached}$"), F.col("piece"))).alias("odd"))
    forms = cut_lineage(piece_forms(cut.select(F.col("odd").alias("piece")).where("piece is not null").distinct())).toDF("odd", "form")
    few = forms.limit(FORMS_SENT + 1).count() <= FORMS_SENT
    placed = cut.join(F.broadcast(forms) if few else forms, "odd", "left").select("key", F.struct("pos", F.coalesce("form", "piece").alias("s")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "")
    return placed.groupBy("key").agg(F.regexp_replace(whole, JOINER, "‍").alias("canon"))


FORMS_SENT = 100_000  # distinct pieces whose forms are broadcast, after a count; beyond, they are joined by a shuffle


def piece_forms(pieces: DataFrame) -> DataFrame:
    """``piece, form`` of distinct pieces: each a character and the marks behind it. Their positioned code points meet
    the mapping (decomposition, width, spaces, look-alikes; broadcast, its size is Unicode's) by an equi-join, are ordered
    by combining class and recomposed."""
    mapping = F.broadcast(_mapping(pieces.sparkSession))
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("i", "cp"))
    parts = (
        points.join(mapping, "cp", "left")
        .select("piece", "i", F.coalesce("parts", F.array(F.struct(F.lit(0).alias("ccc"), F.col("cp").alias("ch")))).alias("parts"))
        .select("piece", F.transform("parts", lambda p, n: F.struct(p["ccc"].alias("ccc"), F.col("i").alias("i"), n.alias("n"), p["ch"].alias("ch"))).alias("parts"))
    )
    sorted_ = parts.groupBy("piece").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))
    built = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["ch"]).when(F.size("parts") == 0, F.lit("")).otherwise(_recompose(F.col("parts")))
    return sorted_.select("piece", built.alias("form"))


def unusual_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``key, text``: each text once that has a character which isn't usual, with its SHA-256 as key. All others are their own
    form; only texts found here are moved."""
    usual = _tables()[3]
    return (
        df.select(F.col(text).alias("text")).where(~F.col("text").rlike(rf"^[{usual}]*$"))
        .select(F.sha2("text", 256).alias("key"), "text")
        .groupBy("key").agg(F.first("text").alias("text"))
    )


def normalise_lookalikes(df: DataFrame, text: str = "text", out: str = "canon") -> DataFrame:
    """All rows, with ``out``: the one form of ``text``; null for null, '' for '' and for texts of
    invisible characters only. Copies of a text are normalised once. ``out`` mustn't be a column
    already; other columns may have any name."""
    forms = canonical_texts(unusual_texts(df, text)).select(F.col("key").alias("__key"), F.col("canon").alias("__canon"))
    keyed = df.withColumn("__text_key", F.sha2(F.col(text), 256))
    joined = keyed.join(forms, keyed["__text_key"] == forms["__key"], "left")
    form = F.coalesce("__canon", df[text])
    return joined.select(*[keyed[c] for c in df.columns], form.alias(out))


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_a, doc_b`` (a < b): documents whose texts differ in characters but have one form.

    Membership (``form_members``) comes first; then one row for each two different texts of a form; documents
    join their text last, so byte-identical copies never meet each other and only pairs that are wanted
    are made. Forms of many texts are dealt out to several tasks. Blank texts, and documents of null id, are in no
    pair; a repeated row counts once.
    """
    members = cut_lineage(form_members(df, key, text))
    several = members.select("form", "key").distinct()
    texts = member_pairs(several, "form", "key").toDF("ka", "kb")
    docs = members.select("doc", "key")
    pairs = (
        texts.join(docs.select(F.col("doc").alias("da"), F.col("key").alias("ka")), "ka")
        .join(docs.select(F.col("doc").alias("db"), F.col("key").alias("kb")), "kb")
        .where("da <> db")
    )
    return pairs.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))


def form_members(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, key, form``: documents of a form that several different texts have, with the hashes of their text and of its
    form. Blank texts and null ids have no row, a repeated row has one."""
    visible = F.col(text).rlike(r"(?U)\S")
    docs = df.select(F.col(key).alias("doc"), F.sha2(F.col(text), 256).alias("key"), visible.alias("seen")).where("doc is not null and key is not null").distinct()
    # Hashes of texts that aren't their own form, read twice below: written once.
    forms = cut_lineage(canonical_texts(unusual_texts(df, text)).select("key", F.sha2("canon", 256).alias("form"), F.col("canon").rlike(r"(?U)\S").alias("shown")))
    known = cut_lineage(docs.join(forms, "key", "left").where(F.coalesce("shown", "seen")).select("doc", "key", F.coalesce("form", "key").alias("form")))
    groups = known.groupBy("form").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("form")
    return known.join(groups, "form", "left_semi").select("doc", "key", "form")
