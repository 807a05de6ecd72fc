"""Quality rules as robust multivariate outliers.

Counts of every text are transformed to a vector; for each language and source
the minimum covariance determinant estimate of centre and scatter is found by
concentration steps from a robust start, and vectors too far by Mahalanobis
distance are rejected. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import n_words, words
from querent.session import stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Scales below which a difference says nothing, by dimension of the vector.
FLOORS = (0.3, 0.1, 0.4, 0.6, 0.25)
CORE = 0.75
STEPS = 3
MIN_GROUP = 100
#: Squared distances beyond the chi-square quantile of 1 - 1e-7 with 5 degrees of freedom.
CUTOFF = 41.7
#: Median of the chi-square distribution with 5 degrees of freedom.
CHI2_MEDIAN = 4.351
D = len(FLOORS)
BIN = 50.0


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the five counts of every whole text (null: none).

    ``n_repeat_words`` counts words in a 3-word window that occurs twice or more
    in the text. Windows are compared by 64-bit hashes: hashes are packed with
    their positions into one long and sorted; where packing merges two hashes
    (seen from the number of distinct ones), hash and position are sorted as pairs.
    """
    one = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    one = one.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    one = one.withColumn("lines", lines)
    one = one.select(
        *keep,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    hashes = F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")
    two = one.select(*kept, F.when(F.col("n_words") >= 3, hashes).alias("h"))
    two = two.select(*kept, "h", F.size(F.array_distinct("h")).alias("different"), F.expr("int(ceil(log2(n_words + 1)))").alias("bits"))
    repeats = F.col("different") < F.size("h")
    packed = F.expr("sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, bits), bits) | bigint(i)))")
    three = two.select(*kept, "h", "different", "bits", F.when(repeats, packed).alias("s"))
    seen = F.expr("1 + size(filter(sequence(1, size(s) - 1), k -> shiftright(s[k], bits) <> shiftright(s[k - 1], bits)))")
    three = three.withColumn("whole", seen == F.col("different"))
    pairs = F.expr("array_sort(transform(h, (x, i) -> struct(x as x, i as i)))")
    three = three.withColumn("pairs", F.when(~F.col("whole"), pairs))
    fast = F.expr(
        """transform(filter(sequence(0, size(s) - 1), k ->
             (k > 0 and shiftright(s[k], bits) = shiftright(s[k - 1], bits))
             or (k < size(s) - 1 and shiftright(s[k], bits) = shiftright(s[k + 1], bits))),
           k -> int(s[k] & (shiftleft(1L, bits) - 1)))"""
    )
    slow = F.expr(
        """transform(filter(sequence(0, size(pairs) - 1), k ->
             (k > 0 and pairs[k].x = pairs[k - 1].x) or (k < size(pairs) - 1 and pairs[k].x = pairs[k + 1].x)),
           k -> pairs[k].i)"""
    )
    at = F.sort_array(F.when(F.col("whole"), fast).otherwise(F.when(F.col("pairs").isNotNull(), slow)))
    four = three.select(*kept, at.alias("at"))
    covered = F.expr("aggregate(sequence(0, size(at) - 1), 0L, (n, k) -> n + if(k = 0, 3, least(3, at[k] - at[k - 1])))")
    return four.select(*kept, F.when(F.size("at") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.col("n_words") + 1
    return [
        F.log(n.cast("double")),
        F.log((F.col("word_chars") + 1) / n),
        F.log(1 + 100 * F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(10 * F.col("n_repeat_words") / n),
    ]


def _group(level: int) -> Column:
    """Null-safe name of a group: 2 language and source, 1 language, 0 all."""
    parts = [F.lit(level).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")][: level + 1]
    return F.to_json(F.struct(*parts))


def _binned_quantile(table: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """A quantile by groups from counts of bins; the same whatever the order of rows.

    The number of bins depends on the range of values, not on the rows.
    """
    counts = table.groupBy(*keys, F.floor(F.col(value) * BIN).alias("bin")).agg(F.count("*").alias("n"))
    line = Window.partitionBy(*keys).orderBy("bin")
    counts = counts.withColumn("upto", F.sum("n").over(line)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    reached = counts.filter(F.col("upto") >= share * F.col("all"))
    return reached.groupBy(*keys).agg(((F.min("bin") + 0.5) / BIN).alias(name))


def _inverse_factor(moments: DataFrame) -> DataFrame:
    """Per group the mean and the inverse Cholesky factor of the scatter, as ``m_i`` and ``f_i_j``."""
    table = moments
    for i in range(D):
        for j in range(i + 1):
            left = F.col(f"c_{i}_{j}") - reduce(lambda a, k: a + F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.lit(0.0))
            value = F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 4))) if i == j else left / F.col(f"l_{j}_{j}")
            table = table.withColumn(f"l_{i}_{j}", value)
    for i in range(D):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = -reduce(lambda a, k: a + F.col(f"l_{i}_{k}") * F.col(f"f_{k}_{j}"), range(j, i), F.lit(0.0)) / F.col(f"l_{i}_{i}")
            table = table.withColumn(f"f_{i}_{j}", value)
    return table.select("group", *[f"m_{i}" for i in range(D)], *[f"f_{i}_{j}" for i in range(D) for j in range(i + 1)])


def _distance() -> Column:
    off = [F.col(f"x_{i}") - F.col(f"m_{i}") for i in range(D)]
    z = [reduce(lambda a, j, i=i: a + F.col(f"f_{i}_{j}") * off[j], range(i + 1), F.lit(0.0)) for i in range(D)]
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _moments(core: DataFrame) -> DataFrame:
    """Mean and scatter of each group; the floors keep flat dimensions from a zero scatter."""
    sums = [F.avg(f"x_{i}").alias(f"m_{i}") for i in range(D)]
    sums += [F.avg(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"p_{i}_{j}") for i in range(D) for j in range(i + 1)]
    table = core.groupBy("group").agg(*sums)
    scatter = {
        f"c_{i}_{j}": F.col(f"p_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for i in range(D)
        for j in range(i + 1)
    }
    return table.withColumns(scatter)


def robust_distances(rows: DataFrame) -> DataFrame:
    """``rows`` (group, x_0 ..) with ``distance``: squared; scaled down where its median is above the chi-square's."""
    flat = rows.select("group", F.posexplode(F.array(*[f"x_{i}" for i in range(D)])).alias("i", "x"))
    centre = stored(_binned_quantile(flat, ["group", "i"], "x", 0.5, "middle"), "mcd-centre")
    off = flat.join(centre, ["group", "i"]).withColumn("off", F.abs(F.col("x") - F.col("middle")))
    spread = _binned_quantile(off, ["group", "i"], "off", 0.5, "spread").join(centre, ["group", "i"])
    start = spread.groupBy("group").agg(
        *[F.max(F.when(F.col("i") == i, F.col("middle"))).alias(f"m_{i}") for i in range(D)],
        *[F.max(F.when(F.col("i") == i, 1 / F.greatest(1.4826 * F.col("spread"), F.lit(FLOORS[i])))).alias(f"f_{i}_{i}") for i in range(D)],
    )
    start = start.withColumns({f"f_{i}_{j}": F.lit(0.0) for i in range(D) for j in range(i)})
    fit = stored(start, "mcd-fit")
    for _ in range(STEPS):
        near = rows.join(fit, "group").withColumn("d", F.log1p(_distance()))
        core = stored(_binned_quantile(near, ["group"], "d", CORE, "most"), "mcd-core")
        fit = stored(_inverse_factor(_moments(near.join(core, "group").filter(F.col("d") <= F.col("most")))), "mcd-fit")
    far = rows.join(fit, "group").withColumn("d", F.log1p(_distance()))
    middle = stored(_binned_quantile(far, ["group"], "d", 0.5, "median"), "mcd-median")
    scale = F.greatest(F.expm1("median") / CHI2_MEDIAN, F.lit(1.0))
    return far.join(middle, "group").withColumn("distance", F.expm1("d") / scale).select(*rows.columns, "distance")


def quality_outliers(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts and verdict of every document (doc_id, text, lang, source).

    ``base_failed``: under 50 words, or over half the words in repeated windows.
    ``kept``: not base_failed and the robust distance within ``cutoff``. Groups of
    fewer than ``MIN_GROUP`` documents are judged with the other small groups of
    their language, then with all small ones; if those are few, too, nothing is
    rejected (``distance`` is null). Nulls of lang and source are groups of their
    own. Repeated rows are judged alike; an empty table gives an empty result.
    """
    counts = stored(text_counts(docs, "doc_id", "lang", "source").withColumn("base_failed", base_failed()), "quality-counts")
    rows = counts.filter(~F.col("base_failed")).withColumn("fine", _group(2)).withColumn("mid", _group(1))
    sizes = rows.groupBy("fine", "mid").agg(F.count("*").alias("n"))
    pool = Window.partitionBy("mid")
    small = F.col("n") < MIN_GROUP
    sizes = sizes.withColumn("pooled", F.sum(F.when(small, F.col("n"))).over(pool))
    name = F.when(~small, F.col("fine")).when(F.col("pooled") >= MIN_GROUP, F.col("mid")).otherwise(F.lit('{"level":0}'))
    sizes = sizes.withColumn("group", name)
    last = F.sum(F.when(F.col("group") == '{"level":0}', F.col("n"))).over(Window.partitionBy())
    sizes = sizes.withColumn("judged", (F.col("group") != '{"level":0}') | (last >= MIN_GROUP)).select("fine", "group", "judged")
    sizes = stored(sizes, "quality-groups")
    vector = {f"x_{i}": F.round(x, 6) for i, x in enumerate(_vector())}
    rows = rows.join(sizes, "fine").filter("judged").select(*counts.columns, "group").withColumns(vector)
    judged = robust_distances(rows).select(*counts.columns, "distance")
    never = counts.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    lone = counts.filter(~F.col("base_failed")).withColumn("fine", _group(2)).join(sizes.filter(~F.col("judged")), "fine")
    lone = lone.select(*counts.columns, F.lit(None).cast("double").alias("distance"))
    everything = judged.unionByName(never).unionByName(lone)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return everything.withColumn("kept", kept)


__all__ = ["COUNTS", "base_failed", "n_words", "quality_outliers", "robust_distances", "text_counts"]
