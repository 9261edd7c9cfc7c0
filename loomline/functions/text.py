"""Syllable, phone and name functions as Column expressions; only NFKC and the spelling of numbers need Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions.pitch import _c

# Spelling and phonetics of Mandarin syllables, as the orthography and the phone set define them.
INITIALS = ("zh", "ch", "sh", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "r", "z", "c", "s")
ZERO_INITIAL = {
    "yi": "i", "ya": "ia", "yo": "io", "ye": "ie", "yao": "iao", "you": "iou", "yan": "ian", "yin": "in", "yang": "iang", "ying": "ing", "yong": "iong",
    "yu": "v", "yue": "ve", "yuan": "van", "yun": "vn",
    "wu": "u", "wa": "ua", "wo": "uo", "wai": "uai", "wei": "uei", "wan": "uan", "wen": "uen", "wang": "uang", "weng": "ueng",
}
CONTRACTED = {"iu": "iou", "ui": "uei", "un": "uen"}
TONE_LETTERS = "˥˦˧˨˩"
CONTOURS = {1: "˥", 2: "˧˥", 3: "˨˩˦", 4: "˥˩", 5: "˧"}
INITIAL_PHONE = {"b": "p", "p": "pʰ", "m": "m", "f": "f", "d": "t", "t": "tʰ", "n": "n", "l": "l", "g": "k", "k": "kʰ", "h": "x", "j": "tɕ", "q": "tɕʰ", "x": "ɕ", "zh": "ʈʂ", "ch": "ʈʂʰ", "sh": "ʂ", "r": "ʐ", "z": "ts", "c": "tsʰ", "s": "s"}
CONSONANT_PHONES = ("p", "t", "k", "m", "n", "f", "x", "ɕ", "ʂ", "ʐ", "s", "l", "ʎ", "ɲ", "ts", "tɕ", "ʈʂ", "ʔ")
#: final: glide, nucleus, coda
FINAL_PHONES = {
    "a": ("", "a", ""), "ai": ("", "aj", ""), "ao": ("", "aw", ""), "an": ("", "a", "n"), "ang": ("", "a", "ŋ"), "o": ("", "o", ""), "ou": ("", "ow", ""), "ong": ("", "u", "ŋ"),
    "e": ("", "o", ""), "ei": ("", "ej", ""), "en": ("", "ə", "n"), "eng": ("", "ə", "ŋ"), "er": ("", "o", "ɻ"), "i": ("", "i", ""), "ir": ("", "ʐ̩", ""), "i0": ("", "z̩", ""),
    "ia": ("j", "a", ""), "ie": ("j", "e", ""), "iao": ("j", "aw", ""), "iou": ("j", "ow", ""), "ian": ("j", "e", "n"), "in": ("", "i", "n"), "iang": ("j", "a", "ŋ"), "ing": ("", "i", "ŋ"), "iong": ("", "u", "ŋ"), "io": ("j", "o", ""),
    "u": ("", "u", ""), "ua": ("w", "a", ""), "uo": ("w", "o", ""), "uai": ("w", "aj", ""), "uei": ("w", "ej", ""), "uan": ("w", "a", "n"), "uen": ("w", "ə", "n"), "uang": ("w", "a", "ŋ"), "ueng": ("w", "ə", "ŋ"),
    "v": ("", "y", ""), "ve": ("ɥ", "e", ""), "van": ("ɥ", "e", "n"), "vn": ("", "y", "n"),
}
#: vowel groups of voicebank aliases by final
VOWEL_GROUP = {"ia": "a", "ua": "a", "uai": "ai", "uan": "an", "iang": "ang", "uang": "ang", "iao": "ao", "uei": "ei", "ie": "e0", "ve": "e0", "ue": "e0", "uen": "en", "ian": "en0", "van": "en0", "ueng": "eng", "uo": "o", "iong": "ong", "iou": "ou"}
DIGITS = "零一二三四五六七八九"
UNITS, GROUPS = ("", "十", "百", "千"), ("", "万", "亿", "万亿")


def lookup(key, values: dict, default=None) -> Column:
    """values[key] from a map literal; default where the key is unknown."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    found = F.try_element_at(table, _c(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


_WITH_INITIAL = f"^({'|'.join(INITIALS)})(.+)$"
_NO_INITIAL = [*ZERO_INITIAL, "er", "r"]


def _plain(pinyin) -> Column:
    return F.replace(F.replace(F.lower(_c(pinyin)), F.lit("ü"), F.lit("v")), F.lit("u:"), F.lit("v"))


def initial_of(pinyin) -> Column:
    """'' for syllables without initial."""
    p = _plain(pinyin)
    return F.when(p.isin(_NO_INITIAL), F.lit("")).otherwise(F.regexp_extract(p, _WITH_INITIAL, 1))


def final_of(pinyin) -> Column:
    """The phonetic final: zhi has ir, zi has i0, ju has v, liu has iou."""

    def parts(p: Column) -> Column:
        return F.struct(p.alias("p"), F.regexp_extract(p, _WITH_INITIAL, 1).alias("i"), F.regexp_extract(p, _WITH_INITIAL, 2).alias("f"))

    def spoken(x: Column) -> Column:
        i, f = x["i"], x["f"]
        return (
            F.when(i.isin("j", "q", "x") & f.startswith("u"), F.regexp_replace(f, "^u", "v"))
            .when(i.isin("zh", "ch", "sh", "r") & (f == "i"), F.lit("ir"))
            .when(i.isin("z", "c", "s") & (f == "i"), F.lit("i0"))
            .otherwise(f)
        )

    def final(x: Column) -> Column:
        own = _let(spoken(x), lambda f: F.coalesce(lookup(f, CONTRACTED), f))
        return F.coalesce(lookup(x["p"], ZERO_INITIAL | {"er": "er", "r": "er"}), F.when(x["i"] != "", own).otherwise(x["p"]))

    return _let(_let(_plain(pinyin), parts), final)


def main_vowel_position(final) -> Column:
    """Where the held vowel lies in a final, as a share of its length."""
    f = _c(final)
    return (
        F.when(f.isin("ai", "ei", "ao", "ou"), F.lit(0.3))
        .when(f.isin("iao", "iou", "uai", "uei"), F.lit(0.5))
        .when(f.isin("ia", "ie", "ua", "uo", "ve", "io"), F.lit(0.7))
        .when(f.endswith("n") | f.endswith("ng"), F.lit(0.35))
        .otherwise(F.lit(0.5))
    )


def vowel_nucleus(final) -> Column:
    """The letter that names a final's vowel: glides go, then the first of a o e i u v that is left, else its first letter."""

    def named(core: Column) -> Column:
        out = F.when(F.contains(core, F.lit("a")), F.lit("a"))
        for v in "oeiuv":
            out = out.when(F.contains(core, F.lit(v)), F.lit(v))
        return out.otherwise(F.substring(core, 1, 1))

    f = _c(final)
    return _let(F.coalesce(F.nullif(F.ltrim(f, F.lit("iuv")), F.lit("")), f), named)


def vowel_group(pinyin) -> Column:
    return lookup(final_of(pinyin), {f: f for f in FINAL_PHONES} | VOWEL_GROUP)


def consonant_group(pinyin) -> Column:
    """Group of what a syllable begins with; glides after m n l h s sh j q x count, and bare vowels share 'ou'."""

    def group(x: Column) -> Column:
        p, i, f = x["p"], x["i"], x["f"]
        return (
            F.when(i.isin("m", "n", "l") & f.startswith("i"), F.concat(i, F.lit("y")))
            .when(i.isin("j", "q", "x"), F.concat(i, F.when(f.startswith("v"), F.lit("w")).otherwise(F.lit("y"))))
            .when(i.isin("h", "s", "sh") & f.startswith("u"), F.concat(i, F.lit("w")))
            .when(i != "", i)
            .when(p.startswith("yu"), F.lit("v"))
            .when(p.startswith("y"), F.lit("y"))
            .when(p.startswith("w"), F.lit("w"))
            .otherwise(F.lit("ou"))
        )

    return _let(F.struct(_plain(pinyin).alias("p"), initial_of(pinyin).alias("i"), final_of(pinyin).alias("f")), group)


def voicebank_spelling(pinyin) -> Column:
    p = _c(pinyin)
    return F.coalesce(lookup(p, {"lve": "lue", "nve": "nue"}), p)


def is_hanzi(char) -> Column:
    return _c(char).rlike(r"^[㐀-䶿一-鿿豈-﫿]$")


def toned(reading) -> Column:
    """struct(pinyin, tone) of a reading such as ni3; NULL if it isn't one."""
    r = _c(reading)
    return F.when(r.rlike("^[a-zv]+[1-5]$"), F.struct(F.regexp_extract(r, "^([a-zv]+)", 1).alias("pinyin"), F.substring(r, -1, 1).cast("int").alias("tone")))


def spelt_number(digits: str) -> str:
    """A number in Chinese numerals (12 is 十二), decimals digit by digit; all digits one by one with leading zeros or over 16 places.

    Digits get the unit of their place in groups of four, groups get 万, 亿 and 万亿; zeros between count once.
    """
    whole, point, rest = digits.partition(".")
    one_by_one = lambda x: "".join(DIGITS[int(c)] for c in x)
    if point:
        return f"{spelt_number(whole)}点{one_by_one(rest)}"
    if len(whole) > 16 or whole[0] == "0":
        return one_by_one(whole)
    out, owed, n = "", False, len(whole)
    for place, group in zip(range((n - 1) // 4, -1, -1), re.findall(".{1,4}", whole.rjust(-(-n // 4) * 4))):
        word = ""
        for unit, c in zip(reversed(UNITS), group):
            if c in " 0":
                owed = owed or c == "0"
                continue
            word += ("零" if owed else "") + DIGITS[int(c)] + unit
            owed = False
        out += word + (GROUPS[place] if word else "")
    return re.sub("^一十", "十", out)


@F.pandas_udf(StringType())
def _normalized(text: pd.Series) -> pd.Series:
    number = re.compile("[0-9]+(?:[.][0-9]+)?")
    return text.map(lambda x: None if x is None else number.sub(lambda m: spelt_number(m[0]), unicodedata.normalize("NFKC", x)))


def normalize_text(text) -> Column:
    """NFKC, numbers spelt out, white space dropped."""
    return F.regexp_replace(_normalized(_c(text)), r"\s+", "")


def syllables(texts: DataFrame, readings: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, pos, char, pinyin, tone, initial, final: a row for each character of a text, without reading (NULL) for those that are no hanzi.

    readings (char, reading such as ni3) is a table or what a provider gives; it meets distinct characters only.
    """
    chars = texts.select(*key, F.posexplode(F.split(F.col(text), "")).alias("pos", "char")).filter("char <> ''")
    known = chars.select("char").distinct().filter(is_hanzi("char")).join(readings.groupBy("char").agg(F.min("reading").alias("reading")), "char")
    read = known.select("char", toned("reading").alias("__r")).select("char", "__r.pinyin", "__r.tone")
    parts = read.withColumns({"initial": initial_of("pinyin"), "final": final_of("pinyin")})
    return chars.join(parts, "char", "left").select(*key, "pos", "char", "pinyin", "tone", "initial", "final")


def pinyin_sequence(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, sequence: the pinyin of a text's syllables in order; characters without reading are left out."""
    held = F.sort_array(F.collect_list(F.when(F.col("pinyin").isNotNull(), F.struct(F.col(order).alias("at"), "pinyin"))))
    return rows.groupBy(*key).agg(F.transform(held, lambda x: x["pinyin"]).alias("sequence"))


def base_phone(phone) -> Column:
    return F.translate(_c(phone), TONE_LETTERS + "ʰʷʲ", "")


def is_toned(phone) -> Column:
    return _c(phone).rlike(f"[{TONE_LETTERS}]")


def is_consonant(phone) -> Column:
    return ~is_toned(phone) & base_phone(phone).isin(*CONSONANT_PHONES)


def expected_coda(pinyin) -> Column:
    p = _c(pinyin)
    return F.when(p.endswith("ng"), F.lit("ŋ")).when(p.endswith("n"), F.lit("n")).when(p.endswith("r") & (F.length(p) > 1), F.lit("ɻ"))


def rule_pronunciation(reading) -> Column:
    """Phones of a toned reading by rule; NULL if it isn't one."""

    def parts(t: Column) -> Column:
        return F.struct(t["tone"].cast("string").alias("tone"), initial_of(t["pinyin"]).alias("i"), final_of(t["pinyin"]).alias("f"))

    def phones(x: Column) -> Column:
        part = lambda k: lookup(x["f"], {f: p[k] for f, p in FINAL_PHONES.items()})
        first = F.when((x["i"] == "r") & (x["f"] == "ir"), F.lit("")).otherwise(lookup(x["i"], INITIAL_PHONE, ""))
        glide = F.when(x["i"].isin("j", "q", "x"), F.lit("")).otherwise(part(0))
        own = F.array(first, glide, F.concat(part(1), lookup(x["tone"], {str(t): c for t, c in CONTOURS.items()})), part(2))
        return F.when(part(1).isNotNull(), F.array_join(F.filter(own, lambda p: p != ""), " "))

    return F.when(_c(reading).rlike("^[a-zv]+[1-5]$"), _let(_let(toned(reading), parts), phones))


def phone_signature(phones) -> Column:
    """struct(first, vowel): consonant class of the first phone and vowel class of the toned one."""

    def sign(p: Column) -> Column:
        head = F.when(is_consonant(p[0]), base_phone(p[0])).otherwise(F.lit(""))
        first = _let(head, lambda h: F.coalesce(lookup(h, {"ɲ": "n", "ʎ": "l", "ʔ": ""}), h))
        vowel = F.substring(base_phone(F.get(F.filter(p, is_toned), F.lit(0))), 1, 1)
        return F.struct(first.alias("first"), _let(vowel, lambda v: F.coalesce(F.when(v.isin("o", "ə", "e"), F.lit("e")).otherwise(v), F.lit(""))).alias("vowel"))

    return _let(F.split(_c(phones), " "), sign)


def split_phones(phones: Column, syllables: Column) -> Column:
    """A word's phones cut by syllable: each takes all up to its tone and its coda; NULL unless all are used.

    phones and syllables are arrays of strings; the result is an array of arrays.
    """

    def step(acc, syllable):
        ahead = F.filter(F.sequence(acc["at"], F.greatest(F.size(phones) - 1, acc["at"])), lambda k: is_toned(F.get(phones, k)))
        found = F.get(ahead, F.lit(0))
        end = found + 1
        end = end + F.when(F.coalesce(base_phone(F.get(phones, end)) == expected_coda(syllable), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        lost = ~acc["ok"] | found.isNull()
        return F.struct(
            F.when(lost, acc["at"]).otherwise(end).alias("at"),
            (~lost).alias("ok"),
            F.when(lost, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.slice(phones, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0)))))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<array<string>>").alias("out"))
    return F.aggregate(syllables, start, step, lambda a: F.when(a["ok"] & (a["at"] == F.size(phones)), a["out"]))


def safe_name(alias) -> Column:
    """A file name for an alias: '- ba' and 'a R' are told from 'head ba' in words, and 'a b' from 'ab'."""
    a = _c(alias)
    named = F.when(a.startswith("- "), F.concat(F.lit("head "), F.substring(a, F.lit(3), F.length(a)))).when(a.endswith(" R"), F.concat(F.lit("end "), F.substring(a, F.lit(1), F.length(a) - 2))).when(F.contains(a, F.lit(" ")), F.concat(F.lit("vc "), a)).otherwise(a)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(named, "[^0-9A-Za-z]+", "_"), F.lit("_")), F.lit("")), F.lit("x"))


def source_id(path) -> Column:
    """A readable id of a file: its cleaned stem and a hash of its path."""
    p = _c(path)
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    clean = F.btrim(F.substring(F.regexp_replace(stem, "[^0-9A-Za-z_-]+", "_"), 1, 32), F.lit("_"))
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("src")), F.lit("_"), F.substring(F.sha1(p.cast("binary")), 1, 8))


def strip_time_tags(text) -> Column:
    return F.regexp_replace(_c(text), r"\[[^\]]*\]", "")


def quoted(text, quote: str) -> Column:
    """Quotes doubled, and around."""
    return F.concat(F.lit(quote), F.replace(_c(text), F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def token_distance(left: Column, right: Column) -> Column:
    """Edit distance between two arrays of tokens.

    Tokens become single letters of an alphabet of their own (their place in the union of both), so Spark's Levenshtein
    counts tokens. Pairs of arrays with over 40,000 different tokens raise an error.
    """
    union = F.array_distinct(F.concat(left, right))
    letters = lambda a: F.array_join(F.transform(a, lambda x: _letter(F.array_position(union, x).cast("int"))), "")
    many = F.raise_error(F.lit("token_distance: over 40000 different tokens")).cast("int")
    return F.when(F.size(union) > 40_000, many).otherwise(F.levenshtein(letters(left), letters(right)))


def _letter(n: Column) -> Column:
    """The n-th character from U+3400 on, three bytes of UTF-8 each."""
    n = n + 0x33FF
    high = F.concat(F.lpad(F.hex(F.shiftright(n, 12).bitwiseOR(0xE0)), 2, "0"), F.hex(F.shiftright(n, 6).bitwiseAND(0x3F).bitwiseOR(0x80)), F.hex(n.bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.decode(F.unhex(high), "UTF-8")
