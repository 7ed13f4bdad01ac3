"""Porter (1980) stems of a vocabulary, as staged column expressions over distinct terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# y counts as a consonant at the start of a word and after a vowel; there it is written Y below
C, V = "[^aeiouy]", "[aeiouy]"
SOME = f"^{C}*{V}+{C}"  # measure above 0
TWO = f"^{C}*{V}+{C}+{V}+{C}"  # measure above 1
ONE = f"^{C}*{V}+{C}+{V}*$"  # measure 1
HAS_VOWEL = V
SHORT_END = f"{C}{V}[^aeiouywxY]$"

# fixed values: suffix pairs of steps 2 and 3, suffixes of step 4
STEP_2 = """ational ate  tional tion  enci ence  anci ance  izer ize  abli able  alli al  entli ent  eli e  ousli ous
ization ize  ation ate  ator ate  alism al  iveness ive  fulness ful  ousness ous  aliti al  iviti ive  biliti ble"""
STEP_3 = "icate ic  ative -  alize al  iciti ic  ical ic  ful -  ness -"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    flat = text.split()
    pairs = [(a, "" if b == "-" else b) for a, b in zip(flat[::2], flat[1::2])]
    return sorted(pairs, key=lambda p: -len(p[0]))


def _cut(word: Column, suffix: str) -> Column:
    return F.regexp_replace(word, f"{suffix}$", "")


def _longest(word: Column, rules: list[tuple[str, str]], condition: str) -> Column:
    """Replace the longest matching suffix when what precedes it meets the condition."""
    out = None
    for suffix, new in rules:
        stem = _cut(word, suffix)
        fits = stem.rlike(condition)
        if suffix == "ion":
            fits = fits & stem.rlike("[st]$")
        value = F.when(fits, F.concat(stem, F.lit(new))).otherwise(word)
        out = F.when(word.endswith(suffix), value) if out is None else out.when(word.endswith(suffix), value)
    return out.otherwise(word)


def stem_vocabulary(terms: DataFrame, term: str = "term") -> DataFrame:
    """Adds column stem; each stage is a column of its own, so no expression is repeated."""
    w = F.col("_w")
    marked = F.regexp_replace(F.regexp_replace(F.col(term), "^y", "Y"), "(?<=[aeiou])y", "Y")
    d = terms.withColumn("_w", marked)
    plural = (
        F.when(w.endswith("sses"), _cut(w, "es")).when(w.endswith("ies"), _cut(w, "es"))
        .when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, "s")).otherwise(w)
    )
    d = d.withColumn("_w", plural)
    ed, ing = _cut(w, "ed"), _cut(w, "ing")
    d = d.withColumn("_cut", F.when(w.endswith("eed"), F.lit(None)).when(w.endswith("ed") & ed.rlike(HAS_VOWEL), ed).when(w.endswith("ing") & ing.rlike(HAS_VOWEL), ing))
    x = F.col("_cut")
    tidy = (
        F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e")))
        .when(x.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(x, ".$", ""))
        .when(x.rlike(ONE) & x.rlike(SHORT_END), F.concat(x, F.lit("e"))).otherwise(x)
    )
    eed = F.when(w.endswith("eed") & _cut(w, "eed").rlike(SOME), _cut(w, "d")).otherwise(w)
    d = d.withColumn("_w", F.coalesce(tidy, eed))
    d = d.withColumn("_w", F.when(w.rlike("[yY]$") & F.regexp_replace(w, ".$", "").rlike(HAS_VOWEL), F.regexp_replace(w, ".$", "i")).otherwise(w))
    d = d.withColumn("_w", _longest(w, _pairs(STEP_2), SOME))
    d = d.withColumn("_w", _longest(w, _pairs(STEP_3), SOME))
    d = d.withColumn("_w", _longest(w, sorted([(s, "") for s in STEP_4.split()], key=lambda p: -len(p[0])), TWO))
    e = _cut(w, "e")
    d = d.withColumn("_w", F.when(w.endswith("e") & (e.rlike(TWO) | (e.rlike(ONE) & ~e.rlike(SHORT_END))), e).otherwise(w))
    d = d.withColumn("_w", F.when(w.endswith("ll") & w.rlike(TWO), _cut(w, "l")).otherwise(w))
    short = F.length(term) <= 2
    return d.withColumn("stem", F.when(short, F.col(term)).otherwise(F.lower("_w"))).drop("_w", "_cut")
