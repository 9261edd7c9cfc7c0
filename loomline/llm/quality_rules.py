"""Quality rules: a threshold table compiled into one Spark projection.

The stop-word rule asks for one in a hundred words. Texts whose letters beyond ASCII weigh half of them or more (other scripts) pass it.

Nulls and empty texts have no words and fail the length rule. Whole texts are counted, however long. Rows keep their number: repeated rows and ties are scored
alike, an empty table gives an empty table. Extra columns stay out of the report and are kept by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import let

#: Common short words of languages in Latin script. Texts that are mostly in other scripts have none and aren't judged by them.
STOP_WORDS = tuple(
    "the of and to in a is that for it on was with as be at by this from are or an not which but have "
    "le la les de des du et en un une que qui dans pour par sur au avec est pas ne se il elle "
    "der die das und zu den von mit ist im ein eine sich auf für dem nicht als auch es an "
    "el los las del y una por con para su se no lo es al como más o "
    "não uma os da do em com il di che della per non het een van niet i się w na nie jest och att det som är inte ja ei on että bir ve bu için yang dan di".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= top / bottom <= high; a bottom of zero passes."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


#: Ratios of the counts that ``counts`` names.
RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.3),
    Rule("exclamations_per_word", "n_exclamations", "n_words", high=0.5),
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("stop_word_share", "n_stop_words", "n_latin_words", low=0.01),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bits of window hashes to leave out besides those that positions take; tests force clashes with it.
SPARE_BITS = 0
#: Words as the contract cuts them, and plain words: runs of digits, letters and characters beyond ASCII.
WORD, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Word positions covered by three-word windows that occur twice or more.

    Each window becomes one long: hash above, position below, with just the bits that positions need. Sorting longs
    brings equal windows together, and neighbours with equal hashes are compared word by word. If any two of those differ, the text's
    windows are sorted as strings instead, so the count is exact at any length.
    """

    def windows(w: Column) -> Column:
        bits = F.least(F.ceil(F.log2(F.size(w) + F.lit(1))).cast("int") + F.lit(SPARE_BITS), F.lit(62))
        return let(F.call_function("shiftleft", F.lit(-1).cast("long"), bits), lambda keep: let(packed(w, keep), lambda s: starts(w, s, keep)))

    def places(w: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), (F.size(w) - 3).cast("long"))

    def packed(w: Column, keep: Column) -> Column:
        window = lambda at, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(keep).bitwiseOR(at)
        return F.sort_array(F.transform(places(w), window))

    def starts(w: Column, s: Column, keep: Column) -> Column:
        low, none = keep.bitwiseXOR(F.lit(-1).cast("long")), F.lit(0).cast("long")
        hashed = lambda x, y: x.bitwiseXOR(y).bitwiseAND(keep) == none

        def alike(x: Column, y: Column) -> Column:
            a, b = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
            return (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))

        same = lambda x, y: hashed(x, y) & alike(x, y)
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        clash = F.size(F.filter(s, lambda x, i: hashed(x, F.get(s, i + 1)) & ~alike(x, F.get(s, i + 1)))) > 0
        return F.when(clash, _covered(by_string(w))).otherwise(_covered(F.transform(twice, lambda x: x.bitwiseAND(low))))

    def by_string(w: Column) -> Column:
        window = lambda at, i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), at.alias("at"))
        twice = lambda s: F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
        return F.transform(let(F.sort_array(F.transform(places(w), window)), twice), lambda x: x["at"])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, windows))


def _covered(starts: Column) -> Column:
    """Positions within the three-word windows that begin at starts."""
    starts = F.sort_array(starts)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(
        starts,
        none,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def counts(text: Column) -> Column:
    """A struct of the counts that rules may name; words, plain words and lines are cut once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    cut = F.struct(words_of(text).alias("words"), words_of(F.lower(text), PLAIN).alias("plain"), lines.alias("lines"))

    def count(c: Column) -> Column:
        found = {
            "n_words": F.size(c["words"]),
            "word_chars": F.length(F.array_join(c["words"], "")),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
            "n_exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
            "n_dup_lines": F.size(c["lines"]) - F.size(F.array_distinct(c["lines"])),
            "n_lines": F.size(c["lines"]),
            "n_repeat_words": _repeat_words(c["words"]),
            "n_latin_words": F.when(2 * (F.octet_length(text) - F.length(text)) < F.length(F.array_join(c["words"], "")), F.size(c["plain"])).otherwise(F.lit(0)),
            "n_stop_words": F.size(F.filter(c["plain"], lambda x: x.isin(*STOP_WORDS))),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in found.items()))

    return let(cut, count)


def _passes(rule: Rule, count) -> Column:
    """count: gives the column of a count's name."""
    top, bottom = count(rule.top).cast("double"), count(rule.bottom).cast("double")
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (top >= bottom * F.lit(rule.low))
    if rule.high is not None:
        ok = ok & (top <= bottom * F.lit(rule.high))
    return ok


def _base_failed(count) -> Column:
    return (count("n_words") < MIN_WORDS) | (100 * count("n_repeat_words") > MAX_REPEAT_PERCENT * count("n_words"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: the id, the counts, base_failed, the names of failed rules and kept."""
    measured = docs.select(F.col(id_col).alias("doc_id"), counts(F.col(text_col)).alias("counts")).select("doc_id", "counts.*")
    failed = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~_passes(r, F.col), F.lit(r.name)) for r in rules)))
    judged = measured.withColumns({"base_failed": _base_failed(F.col), "failed_rules": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns only."""
    def kept(m: Column) -> Column:
        ok = ~_base_failed(m.getField)
        for rule in rules:
            ok = ok & _passes(rule, m.getField)
        return ok

    return docs.filter(let(counts(F.col(text_col)), kept))
