"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

``statistics`` gives each text its counts; ``fit`` estimates location and scatter of the transformed counts in
every (lang, source) group; ``verdicts`` rejects what lies too far out. The estimator is the concentration-step
MCD: start at the coordinatewise median and MAD, keep the half of the group that lies nearest, estimate from that
half, and repeat. Medians and halves are exact: vectors and distances are whole numbers of thousandths, so that a
group's percentile needs a count for each distinct value, of which there are a bounded number, and sums don't
depend on the order of rows. A hot group is summed in every task before its few rows are shuffled.

Groups under ``min_group`` rows, five for each coordinate, are pooled with the other small groups of their language, and those pools that stay
small with one another. A pool that is still small takes the floors as its scatter.

Defined cases: a null or empty text has no words and fails the base rules; null lang or source form groups of
their own; repeated rows count as often as they occur; all rows whose distance equals the half's greatest are in
the half, and a distance equal to the limit is within it; an empty table gives an empty result; other columns pass
through or are ignored; a text of any length is read whole, in memory in proportion to it.
"""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import quality_stats
from weftgraph.llm.cluster import cut, map_arrow, places, take
from weftgraph.llm.words import slices

STATS = quality_stats.NAMES
#: Standard deviations below which no coordinate's scatter goes: ln word length; asin-root rates of symbols, of
#: repeated lines and of repeated words. A clean text of 50 words moves about this far by chance.
FLOORS = (0.06, 0.04, 0.20, 0.25)
P = len(FLOORS)
UNIT = 1000
#: Tables with a row for a group are written in a sixty-fourth of the shuffle partitions.
SMALL = 64
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Columns of a model: whether it has the floors as its scatter, the location, and the inverse of the scatter.
MODEL = ["floor_only", *(f"m{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS)]


def with_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the statistics of ``column``, as longs named in STATS (they replace columns so named)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in STATS])

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch, column):
            found = quality_stats.statistics(texts)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(found[k], pa.int64()) for k in STATS)], names=[*rows.schema.names, *STATS])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} long" for k in STATS)])
    return map_arrow(docs, run, fields)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def coordinates() -> list[Column]:
    """The transformed vector in thousandths."""
    rate = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    length = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    return [F.round(c * UNIT).cast("long").alias(x) for c, x in zip([length, rate("n_symbols", "word_chars"), rate("n_dup_lines", "n_lines"), rate("n_repeat_words", "n_words")], X, strict=True)]


def chi2_cdf(x: float, k: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def distance2() -> Column:
    """Squared Mahalanobis distance of the row's vector from the model beside it."""
    return F.expr(" + ".join(f"{1 if i == j else 2} * p{i}{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in PAIRS))


def _keys(df: DataFrame) -> DataFrame:
    """lang and source as text in which null is a value of its own."""
    text = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    return df.withColumn("lang_key", text("lang")).withColumn("source_key", text("source"))


def _groups(vectors: DataFrame, min_group: int) -> DataFrame:
    """lang_key, source_key, grp of every group: its own, its language's pool or the pool of pools."""
    counts = vectors.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n"))
    small = counts.where(F.col("n") < min_group).groupBy("lang_key").agg(F.sum("n").alias("pool"))
    own, pooled = F.concat_ws("\x1f", "lang_key", "source_key"), F.col("lang_key")
    return counts.join(small, "lang_key", "left").select("lang_key", "source_key", F.when(F.col("n") >= min_group, own).when(F.col("pool") >= min_group, pooled).otherwise(F.lit("")).alias("grp"))


def _minor(i: int, j: int) -> str:
    """SQL of the determinant of the scatter c without row i and column j."""
    rows, columns = ([k for k in range(P) if k != x] for x in (i, j))
    c = lambda a, b: f"c{min(a, b)}{max(a, b)}"
    parity = lambda order: 1 - 2 * (sum(a > b for a, b in itertools.combinations(order, 2)) % 2)
    return " + ".join(f"{parity(order)} * " + " * ".join(c(rows[k], columns[o]) for k, o in enumerate(order)) for order in itertools.permutations(range(P - 1)))


def _with_precision(sums: DataFrame, min_group: int, share: float) -> DataFrame:
    """Models (grp, MODEL) from the counts and sums of the chosen rows of each group; share: of a group's rows chosen.

    The scatter, scaled as for a normal group, is inverted by its minors.
    """
    scale = chi2_cdf(chi2_quantile(share, P), P + 2) / share
    floor = [(f * UNIT) ** 2 for f in FLOORS]
    out = sums.selectExpr("grp", f"n < {min_group * share * 0.5} AS floor_only", *(f"s{i} / n AS m{i}" for i in range(P)), *(f"(s{i}{j} / n - s{i} / n * s{j} / n) / {scale!r}D AS c{i}{j}" for i, j in PAIRS))
    # Floors: each coordinate's scatter is raised to its floor, so that the matrix stays positive definite.
    raised = lambda i, j: f"c{i}{j} + greatest({floor[i]!r}D - c{i}{j}, {0.05 * floor[i]!r}D)" if i == j else f"c{i}{j}"
    out = out.selectExpr("grp", "floor_only", *(f"m{i}" for i in range(P)), *(f"CASE WHEN floor_only THEN {floor[i] if i == j else 0.0!r}D ELSE {raised(i, j)} END AS c{i}{j}" for i, j in PAIRS))
    out = out.selectExpr("*", *(f"{(-1) ** (i + j)} * ({_minor(i, j)}) AS k{i}{j}" for i, j in PAIRS))
    determinant = " + ".join(f"c0{j} * k0{j}" for j in range(P))
    return out.selectExpr("grp", "floor_only", *(f"m{i}" for i in range(P)), *(f"k{i}{j} / ({determinant}) AS p{i}{j}" for i, j in PAIRS))


def fit(statistics: DataFrame, min_group: int = 5 * P, steps: int = 4, share: float = 0.5) -> DataFrame:
    """A model for each (lang_key, source_key) of the written table ``statistics`` (lang, source, STATS), from rows that
    pass the base rules.

    The result is a written table with a row for each group. ``share``: of a group's rows the half that each
    concentration step keeps. Vectors are taken from the statistics anew in each step, whose only written table is
    that of the groups' models; no step runs Python.
    """
    vectors = _keys(statistics.where(~base_failed())).select("lang_key", "source_key", *coordinates())
    groups = cut(_groups(vectors, min_group), SMALL)
    placed = lambda models: vectors.join(groups.join(models, "grp"), ["lang_key", "source_key"])
    half = lambda c: F.percentile(c, F.lit(0.5))
    start = cut(vectors.join(groups, ["lang_key", "source_key"]).groupBy("grp").agg(*(half(x).alias(f"m{i}") for i, x in enumerate(X))), SMALL)
    spread = placed(start).groupBy("grp").agg(*(half(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"d{i}") for i, x in enumerate(X)))
    precision = lambda i, j: 1 / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i] * UNIT)) ** 2 if i == j else F.lit(0.0)
    models = cut(start.join(spread, "grp").select("grp", *(f"m{i}" for i in range(P)), *(precision(i, j).alias(f"p{i}{j}") for i, j in PAIRS)), SMALL)
    sums = [F.expr(f"sum({x}) AS s{i}") for i, x in enumerate(X)] + [F.expr(f"sum({X[i]} * {X[j]}) AS s{i}{j}") for i, j in PAIRS]
    for _ in range(steps):
        near = F.round(F.log1p(F.greatest(distance2(), F.lit(0.0))) * UNIT).cast("long")
        reach = placed(models).groupBy("grp").agg(F.percentile(near, F.lit(share)).alias("reach"))
        chosen = placed(models.join(reach, "grp")).where(near <= F.col("reach")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums)
        models = cut(_with_precision(chosen, min_group, share), SMALL)
    return cut(groups.join(models, "grp"), SMALL)


def verdicts(rows: DataFrame, models: DataFrame, confidence: float = 0.9999) -> DataFrame:
    """``rows`` (lang, source, STATS) with base_failed, distance2 and kept.

    A row is kept if it passes the base rules and its squared distance is within the chi-square quantile
    ``confidence``. A group without a model (none of its rows passes the base rules) has no distance.
    """
    limit = chi2_quantile(confidence, P)
    models = models.drop("grp", "floor_only")
    names = [c for c in rows.columns if c.lower() not in ("base_failed", "distance2", "kept")]
    joined = _keys(rows.select(*[F.col(f"`{n}`") for n in names])).select("*", *coordinates()).join(models, ["lang_key", "source_key"], "left")
    distance = F.when(~base_failed(), distance2())
    return joined.select(*[F.col(f"`{n}`") for n in names], base_failed().alias("base_failed"), distance.alias("distance2"), (~base_failed() & F.coalesce(distance <= limit, F.lit(False))).alias("kept"))


def rules(docs: DataFrame, **how) -> DataFrame:
    """doc_id, lang, source, STATS, base_failed, distance2 and kept of every row of ``docs`` (doc_id, text, lang, source)."""
    rows = cut(with_statistics(take(docs, "doc_id", "lang", "source", "text")).drop("text"))
    return verdicts(rows, fit(rows, **how))


def keep(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The texts are read twice, once for the models and once for the verdicts, and never shuffled.
    """
    plain, place, inner = places(docs)
    named = lambda *names: [F.col(place[n]).alias(n) for n in names]
    models = fit(cut(with_statistics(plain.select(*named("lang", "source", "text"))).drop("text")), **how)
    rest = [c for c in inner if c not in (place["lang"], place["source"], place["text"])]
    kept = verdicts(with_statistics(plain.select(*named("lang", "source", "text"), *rest)), models).where("kept")
    back = {place[n]: n for n in ("lang", "source", "text")}
    return kept.select(*[F.col(back.get(c, c)).alias(o) for c, o in zip(inner, docs.columns, strict=True)])
