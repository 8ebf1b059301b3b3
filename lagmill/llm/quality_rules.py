"""Quality rules: word and repetition statistics with fixed limits, then robust multivariate outliers per language and source."""

from __future__ import annotations

import logging
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.common import SPACE, discard, let, materialize, sent, split_words

#: Share of a group's rows on which the minimum-covariance-determinant estimate rests.
CORE = 0.75
#: Rows that an estimate of an own group needs (statistics + 2), and rows that weigh as much as what the wider group says.
LEAST_GROUP, SHRINK = 7, 100
#: Concentration goes on until no group's log-determinant falls by more than STILL; that takes finitely many steps, and MOST_STEPS guards against rounding.
STILL, MOST_STEPS = 1e-3, 50
#: Quantiles of a chi-squared variable with five degrees of freedom: the median, to which each group's distances are scaled, the lower quartile, from
#: which a group's fence is measured, the upper one, and that of 0.9999, the least cut. Tukey's outer limit of its logarithm, 1.5 quartile
#: ranges above the upper quartile, is 25.8, the same; a group whose upper quartile is larger has heavier tails and a wider cut.
CHI2_MEDIAN, CHI2_QUARTILE, CHI2_HIGH, CHI2_CUT = 4.351, 2.675, 6.626, 25.745
#: The transformed statistics with the least standard deviation that an estimate may give each: what counting alone gives the root of a share
#: (1 / (2 sqrt(n))) over n = 100 lines or words, or over some 600 characters.
VECTOR = {"x_length": 0.02, "x_symbols": 0.02, "x_lines": 0.05, "x_repeats": 0.05, "x_upper": 0.02}
BIN = 1 / 512
#: The group of all rows; groups whose few numbers are sent to all tasks, at most.
TABLE, MOST_SENT = "table", 20_000
#: Repeated windows of a text that are looked up one by one.
FEW = 16
_log = logging.getLogger(__name__)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more. Hashes of the windows tell whether any repeats; only then are positions looked for:
    among few repeated windows one by one, else by sorting."""
    n = F.size(words)
    grams = F.transform(F.slice(words, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(g: Column) -> Column:
        order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        inside = F.flatten(F.transform(let(order, again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(inside))

    def looked_up(g: Column, again: Column) -> Column:
        inside = F.flatten(F.transform(F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))
        return F.size(F.array_distinct(inside))

    def repeated(g: Column) -> Column:
        again = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        return let(again, lambda a: F.when(F.size(a) <= FEW, looked_up(g, a)).otherwise(covered(g)))

    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated(g)))
    return F.when(n < 3, F.lit(0)).otherwise(found)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.select(
        "doc_id", "lang", "source",
        F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        let(split_words(text, f"{SPACE}+"), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep"))).alias("words"),
    )
    return counted.select(
        "doc_id", "lang", "source", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.rep").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"), "n_upper",
    )


def _vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics: logarithm of the mean word length, square roots of shares."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return stats.withColumns({
        "x_length": F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
        "x_symbols": share("n_symbols", "word_chars"),
        "x_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
        "x_upper": share("n_upper", "word_chars"),
    })


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source -> own, whole and grp; tree). own is the group of a language and source, whole that of the language, each null
    with fewer than LEAST_GROUP rows; grp, whose estimate judges the rows, is the narrowest, else the table. tree: grp, parent, depth and n of all
    groups that get an estimate. Windows run over one row per language and source."""
    per = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    enough = lambda n, label: F.when(n >= LEAST_GROUP, label)
    own = enough(F.col("n"), F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))))
    whole = enough(F.sum("n").over(Window.partitionBy("lang")), F.concat(F.lit("lang "), F.to_json(F.struct("lang"))))
    per = per.withColumn("own", own).withColumn("whole", whole).withColumn("grp", F.coalesce("own", "whole", F.lit(TABLE)))
    node = lambda grp, parent, depth: F.struct(grp.alias("grp"), parent.cast("string").alias("parent"), F.lit(depth).alias("depth"))
    nodes = F.array(node(F.col("own"), F.col("whole"), 2), node(F.col("whole"), F.lit(TABLE), 1), node(F.lit(TABLE), F.lit(None), 0))
    tree = per.select(F.explode(nodes).alias("g"), "n").where("g.grp is not null").groupBy("g.grp", "g.parent", "g.depth").agg(F.sum("n").alias("n"))
    return per.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "own", "whole", "grp"), tree


def _group_quantile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """Per group the upper edge of the bin (width BIN) in which the share of its values is reached. Counts per bin merge before the
    shuffle, and a group's window runs over its bins, not its rows."""
    bins = rows.groupBy(*keys, F.floor(value / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    reached = bins.withColumn("up_to", up_to).withColumn("total", total).where(F.col("up_to") >= share * F.col("total"))
    return reached.groupBy(*keys).agg(((F.min("bin") + 1) * BIN).alias(name))


def _whitened(estimate: DataFrame) -> DataFrame:
    """The estimate (grp, start, n, parent, depth, numbers: means, then covariances by row) with m_i, w_i_j, the inverse of its covariance's Cholesky
    factor, and logdet, the covariance's log-determinant, instead of numbers. Folds over the cells of the factor, on one row a group: written
    out, its hundred terms would be planned and compiled in every step, in the driver's memory."""
    d = len(VECTOR)
    cells = [(i, j) for i in range(d) for j in range(i + 1)]
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells))
    upto = F.array(*map(F.lit, range(d)))
    at = lambda m, i, j: F.get(m, (i * (i + 1) / 2).cast("int") + j)
    none = F.array().cast("array<double>")

    def factor(l, x):
        i, j = x["i"], x["j"]
        rest = F.aggregate(F.slice(upto, F.lit(1), j), at(F.slice("numbers", d + 1, len(cells)), i, j), lambda r, k: r - at(l, i, k) * at(l, j, k))
        return F.concat(l, F.array(F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-12)))).otherwise(rest / at(l, j, j))))

    def inverse(w, x):
        i, j = x["i"], x["j"]
        dot = F.aggregate(F.slice(upto, j + 1, i - j), F.lit(0.0), lambda r, k: r + at(F.col("l"), i, k) * at(w, k, j))
        return F.concat(w, F.array(F.when(i == j, 1 / at(F.col("l"), i, i)).otherwise(-dot / at(F.col("l"), i, i))))

    keys = ["grp", "start", "n", "parent", "depth"]
    rows = estimate.select(*keys, "numbers", F.aggregate(grid, none, factor).alias("l"))
    logdet = F.aggregate(upto, F.lit(0.0), lambda r, i: r + 2 * F.log(at(F.col("l"), i, i)))
    rows = rows.select(*keys, "numbers", logdet.alias("logdet"), F.aggregate(grid, none, inverse).alias("w"))
    return rows.select(*keys, "logdet", *(F.get("numbers", F.lit(i)).alias(f"m_{i}") for i in range(d)), *(F.get("w", F.lit(k)).alias(f"w_{i}_{j}") for k, (i, j) in enumerate(cells)))


def _numbers() -> list[str]:
    d = len(VECTOR)
    return [*(f"m_{i}" for i in range(d)), *(f"c_{i}_{j}" for i in range(d) for j in range(i + 1))]


def _blended(raw: DataFrame, base: DataFrame) -> DataFrame:
    """Every group's numbers (an array) moved towards those of its parent, from the table down; the table's towards those of base: n**2 / (n**2 + SHRINK**2)
    of its own. The squares let large groups go: the wider estimate holds the spread between groups, which would widen theirs for ever.
    The tables have one row per group and start; a group's parent and the table are looked up beside it, as the tree has three levels."""

    def shrunk(n: Column, own: Column, wider: Column) -> Column:
        n = n.cast("double")
        w = n * n / (n * n + SHRINK**2)
        return F.zip_with(own, wider, lambda a, b: w * a + (1 - w) * b)

    named = lambda df, p: df.select("start", F.col("grp").alias("parent"), F.col("n").alias(f"{p}_n"), F.col("numbers").alias(f"{p}_numbers"))
    rows = raw.join(base.select("start", F.col("numbers").alias("b_numbers")), "start")
    rows = rows.join(named(raw.where("depth = 0"), "t").drop("parent"), "start").join(named(raw.where("depth = 1"), "p"), ["parent", "start"], "left")
    rows = rows.withColumn("top", shrunk(F.col("t_n"), F.col("t_numbers"), F.col("b_numbers")))
    wider = F.when(F.col("depth") == 1, F.col("top")).otherwise(shrunk(F.col("p_n"), F.col("p_numbers"), F.col("top")))
    numbers = F.when(F.col("depth") == 0, F.col("top")).otherwise(shrunk(F.col("n"), F.col("numbers"), wider))
    return rows.select("grp", "start", "n", "parent", "depth", numbers.alias("numbers"))


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of the vector columns: the squared length of the whitened difference from the mean."""
    total = F.lit(0.0)
    for i in range(len(names)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}"))
        total = total + F.pow(z, F.lit(2.0))
    return total


def _log_distance(names: list[str]) -> Column:
    """Logarithm of the distance, so that bins of equal width hold it to a fixed relative precision."""
    return F.log(F.greatest(_distance(names), F.lit(1e-9)))


def _starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Starting estimates of every grp: 0, medians and squared scales from the interquartile ranges, without correlation; 1, means and
    covariances of all rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(c).alias("x")) for i, c in enumerate(names))))
    long = rows.select("grp", pairs.alias("v")).select("grp", "v.dim", "v.x")
    bins = long.groupBy("grp", "dim", F.floor(F.col("x") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("grp", "dim")
    bins = bins.withColumn("up_to", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
    edge = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("total"), (F.col("bin") + 0.5) * BIN))
    q = bins.groupBy("grp", "dim").agg(edge(0.25).alias("lo"), edge(0.5).alias("mid"), edge(0.75).alias("hi"))
    least = F.get(F.array(*map(F.lit, VECTOR.values())), "dim")
    q = q.withColumn("var", F.pow((F.col("hi") - F.col("lo")) / 1.349, 2) + F.pow(least, 2))
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, F.col(c)))
    zero = [F.lit(0.0).alias(f"c_{i}_{j}") for i in range(len(names)) for j in range(i)]
    robust = q.groupBy("grp").agg(*(pick(i, "mid").alias(f"m_{i}") for i in range(len(names))), *(pick(i, "var").alias(f"c_{i}_{i}") for i in range(len(names))))
    robust = robust.select("grp", F.lit(0).alias("start"), "*", *zero)
    robust = robust.select("grp", "start", F.array(*_numbers()).alias("numbers"))
    return robust.unionByName(_moments(rows.withColumn("start", F.lit(1)), names))


def _moments(rows: DataFrame, names: list[str]) -> DataFrame:
    """Means and covariances of each grp and start; the least standard deviations are added to the variances."""
    covar = lambda i, a, j, b: (F.covar_pop(a, b) + (VECTOR[a] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}")
    cells = [covar(i, a, j, b) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])]
    found = rows.groupBy("grp", "start").agg(*(F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)), *cells)
    return found.select("grp", "start", F.array(*_numbers()).alias("numbers"))


def robust_estimates(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate of every group of tree (grp, parent, depth, n) from rows (own, whole and the vector columns):
    grp, m_i, w_i_j (inverse Cholesky factor), scale and cut.

    Concentration steps from two starts: the CORE share of a group's rows nearest to the current estimate gives the next mean and covariance,
    until no determinant falls; of the two the smaller determinant stands. Means and covariances are those of the group by n**2 / (n**2 + SHRINK**2),
    else those of the language, which lean on the table's alike, and these on its medians and quartiles: so a group of any size has an
    estimate, and large ones have their own. The least standard deviations are added to the variances, so that statistics that hardly
    vary keep a finite distance. scale brings the median distance to its normal value; cut is the scaled distance beyond which a row
    is an outlier, from the group's upper quartile and at least CHI2_CUT.
    """
    names, key = list(VECTOR), ["grp", "start"]
    known = sent(tree, MOST_SENT)
    small = F.broadcast if known is not tree else lambda df: df  # tables of one row per group, or two
    rows = rows.select(F.explode(F.array_compact(F.array("own", "whole", F.lit(TABLE)))).alias("grp"), *names)
    raw = materialize(_starts(rows, names).join(known, "grp"), "mcd")
    base = raw.where("depth = 0 and start = 0").drop("start").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).select("start", "numbers")
    base = materialize(base, "mcd-base", 1)  # two rows
    current = materialize(_whitened(_blended(raw, base)), "mcd")
    for step in range(MOST_STEPS):
        placed = rows.join(small(current), "grp").withColumn("logd", _log_distance(names)).select(*key, *names, "logd")
        edge = _group_quantile(placed, key, F.col("logd"), CORE, "edge")
        raw = materialize(_moments(placed.join(small(edge), key).where("logd <= edge"), names).join(known, "grp"), "mcd")
        new = materialize(_whitened(_blended(raw, base)), "mcd")
        fall = current.select(*key, F.col("logdet").alias("before")).join(new, key).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        discard(current, raw)
        current = new
        _log.info("concentration step %d: log-determinants fell by %s at most", step + 1, fall)
        if fall is None or fall <= STILL:
            break
    best = current.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    best = materialize(current.join(best, key).drop("start"), "mcd")
    placed = rows.join(small(best), "grp").withColumn("logd", _log_distance(names)).select("grp", "logd")
    spread = _group_quantile(placed, ["grp"], F.col("logd"), 0.5, "mid").join(_group_quantile(placed, ["grp"], F.col("logd"), 0.75, "high"), "grp")
    spread = materialize(spread.join(known, "grp").select(*known.columns, F.lit(1).alias("start"), F.array("mid", "high").alias("numbers")), "mcd-spread")
    normal = spread.where("depth = 0").select("start", F.array(F.lit(log(CHI2_MEDIAN)), F.lit(log(CHI2_HIGH))).alias("numbers"))
    spread = _blended(spread, normal).select("grp", F.get("numbers", F.lit(0)).alias("mid"), F.get("numbers", F.lit(1)).alias("high"))
    # A scale under 1 would widen the cut of groups that the least deviations already keep tight.
    scale = F.greatest(F.exp("mid") / CHI2_MEDIAN, F.lit(1.0))
    cuts = spread.withColumn("scale", scale).withColumn("q", F.exp("high") / F.col("scale"))
    cut = F.greatest(F.lit(CHI2_CUT), F.col("q") * F.pow(F.col("q") / CHI2_QUARTILE, 1.5))
    out = materialize(best.drop("n", "parent", "depth", "logdet").join(cuts.select("grp", "scale", cut.alias("cut")), "grp"), "mcd")
    discard(best, current, base)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang, source): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (fewer than 50 words, or more than half of them in repeated three-word windows), distance (squared, robust) and kept.

    A row that passes the base rules is rejected if its distance exceeds its group's cut; the group is its language and source, or where
    these have fewer than LEAST_GROUP rows its language, else the table. Estimates use all rows of the group that pass the base rules, so
    every such row is judged. Null languages and sources are groups of their own. Null and empty texts fail the base rules
    and have no distance. Repeated rows count each. An empty table gives no rows. Other columns are ignored.
    """
    stats = text_statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = materialize(_vectors(stats), "rules-stats")
    groups, tree = _groups(stats.where("not base_failed"))
    groups, tree = materialize(groups, "rules-groups"), materialize(tree, "rules-tree")
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    grouped = stats.join(groups, on, "left").drop("g_lang", "g_source")
    passed = materialize(grouped.where("not base_failed").select("own", "whole", *VECTOR), "rules-vectors")
    estimates = robust_estimates(passed, tree)
    discard(passed, tree)
    judged = grouped.join(estimates, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(list(VECTOR)) / F.col("scale")))
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cut"), F.lit(False))).alias("kept"),
    )
