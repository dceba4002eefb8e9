"""Tokenising transcripts, phone lookups and compound splitting, as Column expressions and joins."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIL = "<SIL>"
#: The phone of what has none; single phones that may be collected.
NOISE, MOST_PHONES = "noise", 10_000
#: Punctuation that ends a sentence (two pauses) and that parts a clause (one).
ENDERS = ".!?؟।॥។៕。！？፡።፨܀܁܂။;"
PAUSES = ",;:،٬؛、，፣፤·၊๚๛"
#: Languages written without spaces.
NO_SPACE = ("zh", "cmn", "yue", "hak", "ja", "ko", "th", "my")
#: Languages in other scripts than Latin and Cyrillic, whose words stand between spaces unless they are in NO_SPACE too.
OTHER_SCRIPTS = (
    "zh", "cmn", "yue", "hak", "ja", "ko", "hi", "mr", "ne", "kok", "bn", "as", "gu", "pa", "or", "sd", "si", "bpy", "ta", "te", "kn", "ml",
    "ar", "ur", "fa", "he", "am", "my", "ka", "hy", "hyw", "el", "grc", "th", "ug",
)
#: Other names of a language.
LANG_ALIASES = {"zh-CN": "cmn", "fr": "fr-fr", "en": "en-us", "uk": "zle", "sv-SE": "sv", "ga-IE": "ga", "cv": "cu"}
#: Letters, digits and underscore in any script; the same in Java and RE2, unlike \w.
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[.,!?;:]"


def language(lang: Column) -> Column:
    out = lang
    for name, code in LANG_ALIASES.items():
        out = F.when(lang == name, code).otherwise(out)
    return out


def words_alpha(text: Column) -> Column:
    """Words and one pause for each of . , ! ? ; :"""
    tokens = F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^[.,!?;:]$"), SIL).otherwise(t))


def _pauses(mark: Column) -> Column:
    two, one, none = F.array(F.lit(SIL), F.lit(SIL)), F.array(F.lit(SIL)), F.array().cast("array<string>")
    return F.when(F.instr(F.lit(ENDERS), mark) > 0, two).when(F.instr(F.lit(PAUSES), mark) > 0, one).otherwise(none)


def _class(marks: str) -> str:
    return "[" + "".join("\\" + c if c in ".!?;:,·" and c.isascii() else c for c in dict.fromkeys(marks)) + "]"


def words_unspaced(text: Column) -> Column:
    """Each character is a token; sentence enders give two pauses, other marks one."""
    tokens = F.regexp_extract_all(text, F.lit(r"<SIL>|\S"), F.lit(0))
    marks = _class(ENDERS + PAUSES)
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(f"^{marks}$"), _pauses(t)).otherwise(F.array(t))))


def words_spaced(text: Column) -> Column:
    """Tokens between white space; marks before and after a word become pauses, marks inside it stay."""
    marks = _class(ENDERS + PAUSES)
    tokens = F.regexp_extract_all(text, F.lit(r"<SIL>|(?:(?!<SIL>)\S)+"), F.lit(0))

    def parts(t: Column) -> Column:
        before = F.regexp_extract(t, f"^({marks}*)", 1)
        core = F.regexp_extract(t, f"^{marks}*(.*?){marks}*$", 1)
        after = F.when(core == "", "").otherwise(F.regexp_extract(t, f"({marks}*)$", 1))
        pauses = lambda s: F.flatten(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), _pauses))
        return F.concat(pauses(before), F.when(core == "", F.array().cast("array<string>")).otherwise(F.array(core)), pauses(after))

    return F.flatten(F.transform(tokens, lambda t: F.when(t == SIL, F.array(F.lit(SIL))).otherwise(parts(t))))


def tokens(text: Column, lang: Column) -> Column:
    """The tokeniser that a language, by any of its names, calls for."""
    code = language(lang)
    return F.when(code.isin(*NO_SPACE), words_unspaced(text)).when(code.isin(*OTHER_SCRIPTS), words_spaced(text)).otherwise(words_alpha(text))


def normalised(label: Column) -> Column:
    """A phone label trimmed and canonically composed, in Arrow batches."""

    @F.pandas_udf("string")
    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize("NFC", v).strip(), na_action="ignore")

    return composed(label)


def vocabulary_stats(df: DataFrame, token: str) -> DataFrame:
    """token, n, is_pause."""
    counts = df.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("is_pause", F.col("token") == SIL)


def reindexed_words(df: DataFrame, keys: list[str], word_idx: str, kept: Column) -> DataFrame:
    """Rows whose word keeps a phone, with word_num dense from 0."""
    return df.where(kept).withColumn("word_num", F.dense_rank().over(Window.partitionBy(*keys).orderBy(word_idx)) - 1)


#: Sound classes that a split is judged by.
VOWELS = ("i", "i:", "ɨ", "ɪ", "e", "e:", "ɛ", "ə", "ɚ", "ʌ", "u", "u:", "ʊ", "ɯ", "o", "o:", "ɔ", "a", "a:", "æ", "y", "ø")
RHOTICS = ("ɹ", "ɾ", "rʲ", "ɚ")
#: How well a phone of the first class is followed by one of the second; else 1.
FOLLOWS = (
    ("vowel", "rhotic", 10), ("vowel", "schwa", 8), ("schwa", "consonant", 8), ("vowel", "vowel", 7), ("consonant", "vowel", 6), ("vowel", "consonant", 5), ("consonant", "consonant", 3),
)
#: What a compound may collapse to, in order: a pattern, and a phone or what is left without the pattern.
COLLAPSES = (("[rɹɚ]", "ɚ"), ("[rɹɚ]", "ɹ"), ("[:ː]", None), ("ə", "ə"))


def _is(phone: Column, kind: str) -> Column:
    return {"vowel": phone.isin(*VOWELS), "consonant": ~phone.isin(*VOWELS), "rhotic": phone.isin(*RHOTICS), "schwa": phone == "ə"}[kind]


def split_score(left: Column, right: Column) -> Column:
    """How likely two phones make a compound: the best that their classes have in FOLLOWS."""
    return F.greatest(F.lit(1), *(F.when(_is(left, a) & _is(right, b), score).otherwise(1) for a, b, score in FOLLOWS))


def compound_splits(df: DataFrame, label: str, phones: DataFrame) -> DataFrame:
    """label, left, right, score: the best split of each label into two phones, the earliest cut on ties.

    phones has one column; both halves are joined to it by value.
    """
    p = phones.columns[0]
    cuts = df.select(label).distinct().where(F.char_length(label) > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.char_length(label) - 1)))
    cuts = cuts.withColumn("left", F.substr(F.col(label), F.lit(1), F.col("cut"))).withColumn("right", F.substr(F.col(label), F.col("cut") + 1))
    known = phones.select(F.col(p).alias("left")).distinct()
    both = cuts.join(known, "left", "left_semi").join(known.withColumnRenamed("left", "right"), "right", "left_semi")
    both = both.withColumn("score", split_score(F.col("left"), F.col("right")))
    best = both.groupBy(label).agg(F.max_by(F.struct("left", "right", "score"), F.struct("score", -F.col("cut"))).alias("b"))
    return best.select(label, "b.left", "b.right", "b.score")


def collapsed(label: Column, known: Column) -> Column:
    """One phone in place of a compound that can't be split: the first of COLLAPSES and its first character that is known; known: array of phones."""
    tried = [F.when(label.rlike(pattern), F.regexp_replace(label, pattern, "") if phone is None else F.lit(phone)) for pattern, phone in COLLAPSES]
    usable = F.filter(F.array(*tried, F.substring(label, 1, 1)), lambda c: F.array_contains(known, c))
    return F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit("noise"))


def longest_matches(label: str, phones: dict[str, str]) -> list[str]:
    """The phones of a label read from the left, each time the longest one that is known; unknown characters are passed over."""
    longest, out, at = max(map(len, phones), default=0), [], 0
    while at < len(label):
        size = next((n for n in range(min(longest, len(label) - at), 0, -1) if label[at : at + n] in phones), 0)
        out += [phones[label[at : at + size]]] if size else []
        at += size or 1
    return out


def mapped_labels(df: DataFrame, label: str, mapping: DataFrame, phones: DataFrame) -> DataFrame:
    """label, phones ARRAY<STRING>, way: what each distinct label stands for, by the first way that gives something.

    mapping: label, phones ARRAY, a table of fixed decompositions, of one phone or several.  phones: one
    column of single phones, which stand for themselves.  Ways: direct, compound, split (the best two
    parts), greedy (longest matches from the left), noise.  A label has a row, however often it occurs;
    phones that are collected are bounded by MOST_PHONES.
    """
    single = phones.select(F.col(phones.columns[0]).alias("_p")).where("_p IS NOT NULL").distinct()
    rows = single.limit(MOST_PHONES + 1).collect()
    if len(rows) > MOST_PHONES:
        raise ValueError(f"more than {MOST_PHONES} phones")
    known = {r[0]: r[0] for r in rows}
    labels = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_l")).distinct()
    table = mapping.select(F.col("label").alias("_l"), F.col("phones").alias("_m")).dropDuplicates(["_l"])
    split = compound_splits(labels.withColumnRenamed("_l", label), label, single).select(F.col(label).alias("_l"), F.array("left", "right").alias("_s"))
    joined = labels.join(table, "_l", "left").join(single.select(F.col("_p").alias("_l"), F.array("_p").alias("_d")), "_l", "left").join(split, "_l", "left")

    @F.pandas_udf("array<string>")
    def greedy(x: pd.Series) -> pd.Series:
        return x.map(lambda v: longest_matches(v, known))

    g = joined.withColumn("_g", F.when(F.coalesce("_d", "_m", "_s").isNull(), greedy("_l")))
    g = g.withColumn("_g", F.when(F.size("_g") > 0, F.col("_g")))
    way = F.when(F.col("_d").isNotNull(), "direct").when(F.col("_m").isNotNull(), "compound").when(F.col("_s").isNotNull(), "split").when(F.col("_g").isNotNull(), "greedy").otherwise("noise")
    return g.select(F.col("_l").alias(label), F.coalesce("_d", "_m", "_s", "_g", F.array(F.lit(NOISE))).alias("phones"), way.alias("way"))


def expanded_phones(df: DataFrame, phone: str, mapping: DataFrame, known: DataFrame, keep_noise: bool = False) -> DataFrame:
    """df with mapped, part and ipa: each phone as what it stands for in the mapping, in parts from 0.

    The first part has the original label as ipa, further ones '-'.  What is in no mapping, and parts
    that aren't known, are noise, which is left out unless it is to be kept; so a phone whose first part
    is noise may begin with '-'.
    """
    names = known.select(F.col(known.columns[0]).alias("_p")).where("_p IS NOT NULL").distinct()
    single = names.select(F.col("_p").alias("_l"), F.array("_p").alias("_m"))
    table = single.unionByName(mapping.select(F.col("label").alias("_l"), F.col("phones").alias("_m")).join(names, F.col("_l") == F.col("_p"), "left_anti").dropDuplicates(["_l"]))
    out = df.join(table, df[phone] == table["_l"], "left").withColumn("_m", F.coalesce("_m", F.array(F.lit(NOISE))))
    out = out.select(*df.columns, F.posexplode("_m").alias("part", "_e")).join(names, F.col("_e") == F.col("_p"), "left")
    out = out.withColumn("mapped", F.coalesce("_p", F.lit(NOISE))).withColumn("ipa", F.when(F.col("part") == 0, F.col(phone)).otherwise("-")).drop("_e", "_p")
    return out if keep_noise else out.where(F.col("mapped") != NOISE)


def mapping_faults(mapping: DataFrame, phones: DataFrame, label: str = "label", target: str = "phone") -> DataFrame:
    """label, fault of a one-to-one mapping: 'repeated' labels, an 'unknown' target, a 'chain' (a target that is mapped on to another), a 'cycle' (two labels mapped to each other).

    Joins on the mapping's own columns; a row has each of its faults once.
    """
    m = mapping.select(F.col(label).alias("label"), F.col(target).alias("phone"))
    names = phones.select(F.col(phones.columns[0]).alias("phone")).distinct()
    repeated = m.groupBy("label").agg(F.countDistinct("phone").alias("n")).where("n > 1").select("label", F.lit("repeated").alias("fault"))
    unknown = m.join(names, "phone", "left_anti").select("label", F.lit("unknown").alias("fault"))
    on = m.where("label <> phone").join(m.where("label <> phone").select(F.col("label").alias("phone"), F.col("phone").alias("_to")), "phone")
    fault = F.when(F.col("_to") == F.col("label"), "cycle").otherwise("chain")
    return repeated.unionByName(unknown).unionByName(on.select("label", fault.alias("fault"))).distinct()
