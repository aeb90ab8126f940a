"""Quality rules: fixed base rules, then adaptive thresholds per language and source.

Every text is measured once, inside its row, by built-in functions. For each language and source a mergeable quantile
sketch of each measure is kept: a histogram over buckets whose width grows with the value (32 to an octave, exact below
32), so sketches of any parts of the table add up to the sketch of the whole whatever the order, and a quantile is at
most 1/32 off. A group's sketch is blended with `prior` documents' worth of its language's, and that one with as much of
all documents': the fewer documents a group has, the more it is judged like its language, and no size is a border. The
thresholds are fences around the blended sketch: quartiles widened by `reach` times their distance, which leave ordinary
documents of a group alone whatever its style, and cut what lies far outside it. They are joined to the measured
documents, which are then filtered.

Defined results: a null text has no words; null language and null source are values of their own; a group without a
document that passes the base rules has no thresholds and needs none; repeated rows are judged each; an empty table
gives an empty result; other columns pass through, and working columns never clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, small_enough, staged

SPACE = r"\x20\x09-\x0D"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fences reach this many times the distance of the quartiles beyond them; so many documents of its language stand beside a group's own.
REACH, PRIOR = 6, 50
#: Weight of one document in a blended sketch, whose weights are whole numbers.
UNIT = 1000
#: The least distance of quartiles, for measures that hardly vary.
LEAST = {"word_length": 20, "symbols": 20, "repeats": 50, "dup_lines": 60}
#: Up to so many repeated windows of a text are looked up in a list.
FEW = 128
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice in the array, its first occurrence included.

    Most texts repeat no window, and most others a few, which are looked up in a short list; where that list is long,
    windows are sorted with their places instead. Both ways find the same places. `words` must be cheap to read often."""
    n = F.size(words) - 2
    windows = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(n, F.lit(0)))
    twice = lambda h: let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))

    def looked_up(h: Column, repeated: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())

    def sorted_out(h: Column) -> Column:
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.sort_array(let(placed, lambda s: F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"])))

    def covered(places: Column) -> Column:
        # each window adds its three words, less those that the one before it has already
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), step, lambda a: a["n"])

    def of(h: Column) -> Column:
        return let(twice(h), lambda r: F.when(F.size(r) == 0, 0).otherwise(covered(F.when(F.size(r) <= FEW, looked_up(h, r)).otherwise(sorted_out(h)))))

    return F.when(n >= 2, let(windows, of)).otherwise(0).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text: other blanks become spaces, and a cut at a plain space needs no pattern matching."""
    for blank in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text (null: none), as long columns; those on words and lines are the fields of structs."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    on_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return {
        "on_words": on_words,
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "on_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    }


def base_failed() -> Column:
    c = F.col
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def ratios() -> dict[str, Column]:
    """What thresholds are set on: whole numbers, so that they are equal wherever they are computed."""
    c = F.col
    share = lambda x, of, unit=1000: F.floor(unit * c(x) / F.greatest(c(of), F.lit(1))).cast("long")
    return {
        "word_length": share("word_chars", "n_words", 100),
        "symbols": share("n_symbols", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
    }


def bucket(x: Column) -> Column:
    """The lower end of the sketch's bucket of a whole number: its six leading bits."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, n: counts by bucket. Partial sums are made before the shuffle, so a hot group costs no more than others."""
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(v).alias("bucket")) for name, v in ratios().items()])
    return measured.select(*keys, F.inline(pairs)).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def blended(own: DataFrame, wider: DataFrame, keys: list[str], of: list[str], prior: int = PRIOR) -> DataFrame:
    """keys, measure, bucket, n: the sketch `own` (counts by keys) in units, with `prior` documents' worth of the sketch
    `wider` (by `of`, some of the keys; in units of any size)."""
    every = wider.withColumn("all", F.sum("n").over(Window.partitionBy(*of, "measure")))
    every = every.withColumn("n", F.expr(f"({prior * UNIT} * n) div all")).drop("all")
    beside = own.select(*keys, "measure").distinct().join(every, [*of, "measure"])
    both = own.select(*keys, "measure", "bucket", (F.col("n") * UNIT).alias("n")).unionByName(beside.select(*keys, "measure", "bucket", "n"))
    return both.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n")).filter("n > 0")


def fences(sketch: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """keys and for each measure its lower and upper fence, from blended sketches. A sketch is a bounded number of buckets,
    so its running sum is a small window."""
    by = Window.partitionBy(*keys, "measure")
    run = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(by)})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    quart = run.groupBy(*keys, "measure").agg(at(25).alias("q1"), at(75).alias("q3"))
    # a measure that hardly varies still gets a margin: a tenth of its level, and some units
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])[F.col("measure")]
    spread = F.greatest(F.col("q3") - F.col("q1"), F.floor(F.col("q3") / 10), least)
    quart = quart.withColumns({"low": F.col("q1") - reach * spread, "high": F.col("q3") + reach * spread})
    value = lambda name, c: F.max(F.when(F.col("measure") == name, F.col(c))).alias(f"{name}_{c}")
    return quart.groupBy(*keys).agg(*[value(m, c) for m in LEAST for c in ("low", "high")])


def verdict(prefix: str = "") -> Column:
    """Whether the ratios lie inside the fences: word length on both sides, the others on the upper one."""
    r = ratios()
    f = lambda name: F.col(prefix + name)
    inside = (r["word_length"] >= f("word_length_low")) & (r["word_length"] <= f("word_length_high"))
    for m in ("symbols", "repeats", "dup_lines"):
        inside = inside & (r[m] <= f(f"{m}_high"))
    return inside


def thresholds(measured: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """lang, source and their fences, from measured documents that pass the base rules."""
    group = staged(sketches(measured, ["lang", "source"]), "quality-sketches")
    total = lambda keys: group.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by_lang = staged(blended(total(["lang"]), total([]), ["lang"], [], prior), "quality-languages")
    return fences(blended(group, by_lang, ["lang", "source"], ["lang"], prior), ["lang", "source"], reach)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """The columns `keep` of docs (all by default) in a struct `row`, the base measures, base_failed and kept."""
    cols = docs.columns if keep is None else keep
    m = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
        F.coalesce(F.col(lang).cast("string"), F.lit("\0null")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("\0null")).alias("source"),
        *[v.alias(n) for n, v in measures(F.col(text)).items()],
    )
    m = m.select("row", "lang", "source", "on_words.*", "n_symbols", "on_lines.*")
    m = staged(m.withColumn("base_failed", base_failed()), "quality-measures")
    limits = staged(thresholds(m.filter("not base_failed"), reach, prior), "quality-fences")
    df = m.join(small_enough(limits), ["lang", "source"], "left")
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict(), F.lit(True))).select("row", *MEASURES, "base_failed", "kept")


def passed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are kept."""
    return judge(docs, **options).filter("kept").select("row.*")
