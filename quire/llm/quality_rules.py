"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WHITE, let

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that for it was on are as with be at by this from or an "
    "der die das und in zu den mit von ist für auf dem des ein eine nicht als auch es "
    "le la les de et un une des que en du est pour dans qui sur au par ne il "
    "el los las y un una del que por con para se su al lo como más o es la"
).split()

#: (rule, metric, comparison, bound): a document that meets the comparison is rejected. Ratios lie in 0..1.
THRESHOLDS = (
    ("too_short", "n_words", "<", 20),
    ("repeated_windows", "repeat_ratio", ">", 0.30),
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 14.0),
    ("symbols", "symbol_ratio", ">", 0.10),
    ("few_stop_words", "stop_ratio", "<", 0.02),
    ("duplicate_lines", "dup_line_ratio", ">", 0.35),
)

WINDOW = 8


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words covered by windows of eight that occur twice or more in the text.

    Windows are compared by 64-bit hash. Sorting (hash, position) brings equal windows together; a fold over the
    positions of those with an equal neighbour adds up what they cover. Sorting is skipped where all are distinct.
    """

    def paired(h: Column, step: int) -> Column:
        """At each position the hash of what stands there and `step` further on."""
        return let(h, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    # 1, 2, then 4 further on: each value now stands for WINDOW words; the last ones reach past the end
    windows = F.slice(paired(paired(paired(hashes, 1), 2), 4), 1, n - (WINDOW - 1))

    def covered(w: Column) -> Column:
        order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            order,
            lambda o: F.filter(
                o,
                lambda x, j: (F.get(o, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(o, j + 1)["h"].eqNullSafe(x["h"])),
            ),
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(n >= WINDOW, counted).otherwise(0).cast("long")


def stop_hashes(spark: SparkSession) -> list[int]:
    """The stop words' hashes as literals, so that the test is one look-up in a constant set."""
    words = list(dict.fromkeys(STOP_WORDS))
    return list(spark.range(1).select(*[F.xxhash64(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)]).first())


def measures(spark: SparkSession, text: str = "text") -> Column:
    """A struct of the metrics; null text counts as empty. It is costly: use it once, or within let()."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\t\n\x0b\f\r", t)
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    symbols = F.regexp_count(t, F.lit("[#*$%&|<>]"))
    stops = stop_hashes(spark)

    def with_words(w: Column) -> Column:
        return let(
            F.struct(F.transform(w, lambda x: F.xxhash64(x)).alias("h"), F.length(F.array_join(w, "")).alias("chars")),
            lambda v: let(v["h"], lambda h: by_word(h, v["chars"])),
        )

    def by_word(h: Column, chars: Column) -> Column:
        return F.struct(
                F.size(h).cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                _repeat_words(h, F.size(h)).alias("n_repeat_words"),
                F.size(F.filter(h, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        )

    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(let(words, with_words).alias("w"), by_line.alias("l"), symbols.cast("long").alias("n_symbols"))


def _ratios(q: Column) -> dict[str, Column]:
    n = F.greatest(q["w"]["n_words"], F.lit(1))
    return {
        "n_words": q["w"]["n_words"],
        "repeat_ratio": q["w"]["n_repeat_words"] / n,
        "mean_word_chars": q["w"]["word_chars"] / n,
        "symbol_ratio": q["n_symbols"] / n,
        "stop_ratio": q["w"]["n_stop_words"] / n,
        "dup_line_ratio": q["l"]["n_dup_lines"] / F.greatest(q["l"]["n_lines"], F.lit(1)),
    }


def compile_rules(q: Column, thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a document breaks, as an array: one expression for the whole table."""
    metrics = _ratios(q)
    compare = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}
    return F.array_compact(F.array(*[F.when(compare[op](metrics[m], F.lit(bound)), F.lit(name)) for name, m, op, bound in thresholds]))


def base_failed(q: Column) -> Column:
    return (q["w"]["n_words"] < 20) | (100 * q["w"]["n_repeat_words"] > 30 * q["w"]["n_words"])


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: its measures, the rules it breaks, and whether it is kept.

    No user function runs and nothing is shuffled. Empty or null text has no words and fails the base rule. Repeated
    rows are judged alike, each on its own. An empty table gives an empty result; columns besides id and text are not
    read, whatever their names.
    """
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    def judged(q: Column) -> Column:
        base, broken = base_failed(q), compile_rules(q, thresholds)
        return F.struct(
            q["w"]["n_words"].alias("n_words"),
            q["w"]["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            q["l"]["n_dup_lines"].alias("n_dup_lines"),
            q["w"]["n_repeat_words"].alias("n_repeat_words"),
            base.alias("base_failed"),
            (~base & (F.size(broken) == 0)).alias("kept"),
            q["w"]["n_stop_words"].alias("n_stop_words"),
            q["l"]["n_lines"].alias("n_lines"),
            F.array_join(broken, ",").alias("broken_rules"),
        )

    # let(), not a plain struct: the optimizer would copy a struct's fields into each use and compute them again
    return own.select("doc_id", let(measures(docs.sparkSession), judged).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that break no rule, with all their columns as they were, whatever these are called.

    Null, empty and wordless texts go, as they have too few words; repeated rows are judged one by one; a null id makes
    no difference; an empty table stays empty; a measure at its threshold breaks no rule.
    """
    # the verdict is one expression within let(): a filter on a column of measures would compute them at each mention
    good = let(measures(docs.sparkSession, f"`{text}`"), lambda q: ~base_failed(q) & (F.size(compile_rules(q, thresholds)) == 0))
    return docs.where(good)
