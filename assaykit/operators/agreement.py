"""Agreement of raters, resampling intervals and tests. Everything is an aggregation over counts or integer sums."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from ..sources.scratch import ship

MASK = 0xFFFFFFFF


def cohens_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """kappa, po, pe, n of two raters. Without rows all are 0; where chance agreement is 1, kappa is 1."""
    table = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    margins = table.select(F.col(a).alias("c"), F.col("n").alias("na"), F.lit(0).alias("nb")).union(table.select(F.col(b), F.lit(0), F.col("n")))
    per = margins.groupBy("c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    chance = per.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("cross"))
    seen = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("agree"))
    po, pe = F.col("agree").cast("double") / F.col("n"), F.col("cross").cast("double") / (F.col("n").cast("double") * F.col("n"))
    out = seen.crossJoin(chance).select("n", F.when(F.col("n") == 0, 0.0).otherwise(po).alias("_po"), F.when(F.col("n") == 0, 0.0).otherwise(pe).alias("_pe"))
    kappa = F.when(F.col("n") == 0, 0.0).when(F.col("_pe") == 1, 1.0).otherwise((F.col("_po") - F.col("_pe")) / (1 - F.col("_pe")))
    return out.select(to_fixed(kappa, 6).alias("kappa"), to_fixed(F.col("_po"), 6).alias("po"), to_fixed(F.col("_pe"), 6).alias("pe"), "n")


def fleiss_kappa(ratings: DataFrame, raters: int) -> DataFrame:
    """kappa of `raters` ratings for each item. ratings: item, category; items with another number of ratings are left out."""
    counts = ratings.groupBy("item", "category").agg(F.count("*").alias("c"))
    whole = counts.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")).where(F.col("m") == raters)
    items = whole.agg(F.count("*").alias("n"), F.coalesce(F.sum("agree"), F.lit(0)).alias("agree"))
    margins = counts.join(whole.select("item"), "item", "left_semi").groupBy("category").agg(F.sum("c").alias("c")).agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0)).alias("squares"))
    n = F.col("n").cast("double")
    rows = items.crossJoin(margins).select("n", (F.col("agree") / (n * raters * (raters - 1))).alias("_p"), (F.col("squares") / (n * raters * n * raters)).alias("_e"))
    kappa = F.when(F.col("n") == 0, 0.0).when(F.col("_e") == 1, 1.0).otherwise((F.col("_p") - F.col("_e")) / (1 - F.col("_e")))
    zero = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(F.col(c))
    return rows.select(to_fixed(kappa, 6).alias("kappa"), to_fixed(zero("_p"), 6).alias("p_bar"), to_fixed(zero("_e"), 6).alias("pe_bar"), "n", F.lit(raters).alias("raters"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """Interval alpha. ratings: unit, value (null: missing). The sum over pairs of squared differences is n * sum of squares - square of the sum.

    Values are taken in tenths as decimals, so all sums are exact.
    """
    x = F.round(F.col("value") * 10).cast("decimal(20,0)")
    units = ratings.where(F.col("value").isNotNull()).groupBy("unit").agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    by_size = units.groupBy("m").agg(F.count("*").alias("units"), F.sum(F.col("m") * F.col("q") - F.col("s") * F.col("s")).alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    multi = F.col("m") >= 2
    got = by_size.agg(
        F.sum("units").alias("n"), F.sum(F.col("m") * F.col("units")).alias("values"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.when(multi, F.lit(2.0) * F.col("d").cast("double") / (F.col("m") - 1))).alias("num"), F.sum(F.when(multi, F.col("m") * F.col("units"))).alias("den"),
        F.sum(F.when(multi, F.col("units") * F.col("m") * (F.col("m") - 1) / 2)).cast("long").alias("pairs"),
    )
    v = F.col("values").cast("double")
    expected = F.lit(2.0) * (v * F.col("q").cast("double") - F.col("s").cast("double") * F.col("s").cast("double")) / (v * (v - 1))
    alpha = F.when(F.coalesce("values", F.lit(0)) < 2, 0.0).when(expected == 0, 1.0).otherwise(1 - F.coalesce(F.col("num") / F.col("den"), F.lit(0.0)) / expected)
    return got.select(to_fixed(alpha, 6).alias("alpha"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def average_ranks(df: DataFrame, value: str, into: str) -> DataFrame:
    """df with twice the average rank (an integer) of each value. Ties share it. Ranks come from counts of distinct values, not from one sorted task over all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_up", F.sum("_n").over(Window.orderBy(value)))
    ranks = ranked.select(F.col(value).alias("_v"), (F.lit(2) * F.col("_up") - F.col("_n") + 1).alias(into))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def spearman(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """rho and n. Zero variance gives 0. Sums of doubled ranks are exact decimals."""
    ranked = average_ranks(average_ranks(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), x, "_rx"), y, "_ry")
    a, b = F.col("_rx").cast("decimal(18,0)"), F.col("_ry").cast("decimal(18,0)")
    s = ranked.agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
    d = {c: F.col(c).cast("double") for c in ("n", "a", "b", "aa", "bb", "ab")}
    va, vb = d["n"] * d["aa"] - d["a"] * d["a"], d["n"] * d["bb"] - d["b"] * d["b"]
    rho = F.when((d["n"] == 0) | (va <= 0) | (vb <= 0), 0.0).otherwise((d["n"] * d["ab"] - d["a"] * d["b"]) / F.sqrt(va * vb))
    return s.select(to_fixed(rho, 6).alias("rho"), "n")


def kappa_label(k: Column) -> Column:
    # Bands and names.
    return F.when(k < 0, "poor").when(k < 0.21, "slight").when(k < 0.41, "fair").when(k < 0.61, "moderate").when(k < 0.81, "substantial").otherwise("almost perfect")


def alpha_label(a: Column) -> Column:
    # Bands and names.
    return F.when(a < 0, "no agreement").when(a < 0.667, "tentative").when(a < 0.8, "acceptable").otherwise("high")


def judge_to_hundred(v: Column) -> Column:
    """A judge's value on the 0-100 scale, value by value: up to 5 it is read as one of the 0-5 scale."""
    return F.when((v < 0) | (v > 100) | F.isnan(v), None).when(v <= 5, v * 20.0).otherwise(v)


def draw(seed: int, index: Column) -> Column:
    """Number `index` (from 1) of a 32-bit mixing generator with additive state, between 0 and 1: each draw on its own, in any task."""
    return draw_seeded(F.lit(seed), index)


def draw_seeded(seed: Column, index: Column) -> Column:
    """The same with a seed from a column."""
    wrap = lambda x: x.bitwiseAND(F.lit(MASK))
    x = wrap(seed + wrap(index) * F.lit(-1640531527))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = wrap(x * F.lit(0x21F0AAAD))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = wrap(x * F.lit(0x735A2D97))
    return x.bitwiseXOR(F.shiftright(x, 15)).cast("double") / 4294967296.0


#: Scores of 16 bytes each that are broadcast at most.
SCORES = 1_000_000
#: The generator's draws repeat after so many: the index counts modulo 2^32, and each step maps the 32-bit numbers one to one.
PERIOD = 1 << 32
#: Tasks that walk the period, and draws that one of them holds at once.
WALKS, WALK = 256, 1 << 20


def resampled_sums(scores: DataFrame, n: int, resamples: int, seed: int) -> DataFrame:
    """(r, total): sums of tenths of n draws with replacement. scores: pos from 0, tenths.

    Up to a period of the generator draws are made where they are needed, joined with the broadcast scores (SCORES at most) on their
    place, and summed before they are shuffled. Beyond, see period_sums: the same totals with the work of one period.
    """
    if n > SCORES or n * resamples > PERIOD:
        return period_sums(scores, n, resamples, seed)
    draws = scores.sparkSession.range(resamples * n)
    at = F.floor(draw(seed, F.col("id") + 1) * F.lit(float(n))).cast("long")
    hits = draws.select(F.expr(f"id div {n}").alias("r"), at.alias("pos")).join(F.broadcast(scores.select("pos", "tenths")), "pos")
    return hits.groupBy("r").agg(F.sum("tenths").alias("total"))


def drawn_by(x: np.ndarray, seed: int) -> np.ndarray:
    """Ids (from 0) of the draws that give the 32-bit numbers x: the steps of draw() backwards."""
    inverse = lambda k: np.uint32(pow(k, -1, PERIOD))
    x = x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))
    x = x * inverse(0x735A2D97)
    x = x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))
    x = x * inverse(0x21F0AAAD)
    x = x ^ (x >> np.uint32(16))
    return (x - np.uint32(seed % PERIOD)) * inverse(-1640531527 % PERIOD) - np.uint32(1)


def first_number(pos: np.ndarray, n: int) -> np.ndarray:
    """The least 32-bit number that draw() turns into the place pos of n (pos < n), in doubles as it does. pos from 0 to n, long."""
    x = -((-pos * PERIOD) // n)
    before = np.floor((x - 1).astype(np.float64) / float(PERIOD) * float(n))
    return np.where((x > 0) & (pos < n) & (before >= pos), x - 1, x)


def period_sums(scores: DataFrame, n: int, resamples: int, seed: int) -> DataFrame:
    """resampled_sums by way of one period of draws, without a join or a broadcast of scores.

    A place is drawn by one range of 32-bit numbers, and the generator runs backwards, so each row finds its own draws in the
    period. They are summed between the borders of resamples (modulo the period) before they are shuffled; running sums at the
    borders, and the sum of the period as often as it is passed, give each resample's total. Sums are whole numbers.
    """
    if n > PERIOD // 2:
        raise ValueError("more scores than the generator can tell apart")
    spark = scores.sparkSession
    ship(spark)
    borders = np.unique(np.fromiter((r * n % PERIOD for r in range(resamples + 1)), np.int64, resamples + 1))
    cell = 12
    # The segment where each cell of 2^12 ids begins; later borders inside a cell are looked for one by one.
    begins = (np.searchsorted(borders, np.arange(0, PERIOD, 1 << cell), side="right") - 1).astype(np.int32)
    ends = np.append(borders[1:], PERIOD)

    def run(batches):
        sums = np.zeros(len(borders), dtype=np.int64)
        for b in batches:
            pos, tenths = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "tenths"))
            start, size = first_number(pos, n), first_number(pos + 1, n) - first_number(pos, n)
            upto = np.append(0, np.cumsum(size))
            for low in range(0, int(upto[-1]), WALK):
                high = min(low + WALK, int(upto[-1]))
                i, j = int(np.searchsorted(upto, low, side="right")) - 1, int(np.searchsorted(upto, high, side="left"))
                own = np.minimum(upto[i + 1 : j + 1], high) - np.maximum(upto[i:j], low)
                x = np.repeat(start[i:j] - upto[i:j], own) + np.arange(low, high)
                ids = drawn_by(x.astype(np.uint32), seed)
                at = begins[ids >> np.uint32(cell)]
                later = np.flatnonzero(ids >= ends[at])
                at[later] = np.searchsorted(borders, ids[later], side="right") - 1
                sums += np.bincount(at, np.repeat(tenths[i:j], own), len(borders)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(borders), pa.array(sums)], ["border", "sum"])

    dealt = scores.select(F.col("pos").cast("long"), F.coalesce(F.col("tenths").cast("long"), F.lit(0)).alias("tenths")).repartition(WALKS, "pos")
    parts = dealt.mapInArrow(run, "border long, sum long").groupBy("border").agg(F.sum("sum").alias("sum"))
    # One row for each border, resamples + 1 at most.
    running = parts.select("border", (F.sum("sum").over(Window.orderBy("border")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("whole"))
    cuts = spark.range(resamples + 1).select(F.col("id").alias("r"), (F.col("id") * n).alias("_k"))
    at = cuts.join(running, F.col("_k") % PERIOD == F.col("border")).select("r", (F.expr(f"_k div {PERIOD}") * F.col("whole") + F.col("before")).alias("_upto"))
    return at.select("r", (F.lead("_upto").over(Window.orderBy("r")) - F.col("_upto")).alias("total")).where(F.col("total").isNotNull())


def bootstrap_interval(scores: DataFrame, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Mean of the scores and the percentile interval of resampled means (rows at floor(alpha / 2 * R) and floor((1 - alpha / 2) * R) - 1)."""
    n = scores.count()
    if n == 0:
        return scores.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0)], "mean double, lower double, upper double, n long")
    sums = resampled_sums(scores, n, resamples, seed)
    ordered = sums.withColumn("k", F.row_number().over(Window.orderBy("total")) - 1)  # one row for each resample
    low, high = math.floor(alpha / 2 * resamples), math.floor((1 - alpha / 2) * resamples) - 1
    as_mean = lambda c: to_fixed(c.cast("double") / 10.0 / float(n), 6)
    ends = ordered.agg(as_mean(F.max(F.when(F.col("k") == low, F.col("total")))).alias("lower"), as_mean(F.max(F.when(F.col("k") == high, F.col("total")))).alias("upper"))
    return scores.agg(as_mean(F.sum("tenths")).alias("mean")).crossJoin(ends).select("mean", "lower", "upper", F.lit(n).cast("long").alias("n"))


def paired_bootstrap(diffs: DataFrame, resamples: int = 10_000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """Mean difference, interval, and the add-one share of centred resamples at least as far from 0 as the mean. diffs: pos, tenths."""
    n = diffs.count()
    if n == 0:
        return diffs.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0)], "mean_diff double, lower double, upper double, p_value double, n long")
    seen = diffs.agg(F.sum("tenths").alias("observed"))
    ordered = resampled_sums(diffs, n, resamples, seed).withColumn("k", F.row_number().over(Window.orderBy("total")) - 1).crossJoin(F.broadcast(seen))
    low, high = math.floor(alpha / 2 * resamples), math.floor((1 - alpha / 2) * resamples) - 1
    as_mean = lambda c: to_fixed(c.cast("double") / 10.0 / float(n), 6)
    return ordered.agg(
        as_mean(F.max("observed")).alias("mean_diff"), as_mean(F.max(F.when(F.col("k") == low, F.col("total")))).alias("lower"), as_mean(F.max(F.when(F.col("k") == high, F.col("total")))).alias("upper"),
        to_fixed((F.count_if(F.abs(F.col("total") - F.col("observed")) >= F.abs("observed")) + 1).cast("double") / float(resamples + 1), 6).alias("p_value"), F.lit(n).cast("long").alias("n"),
    )


def erf(x: Column) -> Column:
    """The five-term rational approximation (Abramowitz and Stegun 7.1.26), for x >= 0."""
    t = F.lit(1.0) / (x * 0.3275911 + 1.0)
    # Coefficients of the approximation.
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.lit(1.0) - poly * F.exp(-(x * x))


def mcnemar(pairs: DataFrame, a: str = "a", b: str = "b", exact_up_to: int = 25) -> DataFrame:
    """chi2 with continuity correction and p: exact binomial up to 25 discordant pairs, else by the chi-square of one degree."""
    got = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    n, gap = F.col("only_a") + F.col("only_b"), F.abs(F.col("only_a") - F.col("only_b")).cast("double")
    chi2 = F.when(n == 0, 0.0).otherwise((gap - 1) * (gap - 1) / n)
    k = F.least("only_a", "only_b").cast("int")
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))
    step = lambda s, i: F.struct(F.when(i == 0, F.lit(1.0)).otherwise(s["c"] * (n - i + 1) / i).alias("c"), (s["sum"] + F.when(i == 0, F.lit(1.0)).otherwise(s["c"] * (n - i + 1) / i)).alias("sum"), i.cast("int").alias("i"))
    tail = F.aggregate(F.sequence(F.lit(0), k), start, step)["sum"] * F.pow(F.lit(0.5), n)
    p = F.when(n == 0, 1.0).when(n <= exact_up_to, F.least(F.lit(1.0), tail * 2)).otherwise(F.lit(1.0) - erf(F.sqrt(chi2 / 2)))
    return got.select("only_a", "only_b", to_fixed(chi2, 6).alias("chi2"), to_fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 6).alias("p_value"))


def cohens_h(p1: Column, p2: Column) -> Column:
    """Effect size of two shares."""
    return to_fixed(F.asin(F.sqrt(p1)) * 2 - F.asin(F.sqrt(p2)) * 2, 6)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: the series below a + 1, the continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    # Wallis' recurrence for the fraction, rescaled so that nothing overflows.
    p0, q0, p1, q1 = 0.0, 1.0, 1.0, x + 1 - a
    before, i = 0.0, 0
    while abs(p1 / q1 - before) > 1e-15 * abs(p1 / q1) and i < 500:
        before, i = p1 / q1, i + 1
        num, den = -i * (i - a), x + 2 * i + 1 - a
        p0, q0, p1, q1 = p1, q1, den * p1 + num * p0, den * q1 + num * q0
        scale = max(abs(p1), abs(q1))
        p0, q0, p1, q1 = p0 / scale, q0 / scale, p1 / scale, q1 / scale
    return 1 - front * p1 / q1


def chi2_cdf(x: float, df: int) -> float:
    return gamma_p(df / 2, x / 2)


def reference_probe(overalls: DataFrame, at: float = 84.0) -> DataFrame:
    """Count, mean, median, failures under the mark and share that reach it."""
    return overalls.agg(
        F.count("*").alias("total"), (F.floor(F.sum(F.round(F.col("overall") * 10).cast("long")).cast("double") / F.count("*") + 0.5) / 10.0).alias("mean"),
        (F.floor(F.median("overall") * 10 + 0.5) / 10.0).alias("median"), F.count_if(F.col("overall") < at).alias("failures"),
        (F.floor(F.count_if(F.col("overall") >= at).cast("double") / F.count("*") * 100.0 * 10 + 0.5) / 10.0).alias("pass_rate"),
    )


def unanimity(labels: DataFrame, item: list[str], value: str) -> DataFrame:
    """Items, those whose labels are all the same, and their share in percent (one decimal, half up)."""
    per = labels.groupBy(*item).agg((F.min(value) == F.max(value)).alias("same"), F.count("*").alias("n")).where("n >= 2")
    return per.agg(F.count("*").alias("items"), F.count_if("same").alias("unanimous"), (F.floor(F.count_if("same").cast("double") / F.count("*") * 1000.0 + 0.5) / 10.0).alias("agreement"))
