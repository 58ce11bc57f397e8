"""Alpha diversity from cluster counts, per sample and over all, in grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The indices of a diversity table, in the order reported.
INDICES = ("Richness", "Chao1", "ACE", "Shannon", "Simpson", "InverseSimpson", "Pielou_J", "Heip_E", "Berger_Parker", "Margalef", "Menhinick", "Brillouin", "Fisher_alpha", "Hill_q0", "Hill_q1", "Hill_q2")
#: Counts above this don't count as rare in ACE.
RARE = 10
FISHER_STEPS = 100
FISHER_TOLERANCE = 1e-6


def abundance(rows: DataFrame, cluster: str = "cluster", sample: str | None = "sample") -> DataFrame:
    """(sample, cluster, n): counts over all rows (sample null) and, given ``sample``, within each sample too.

    Null clusters are left out, and null samples from the per-sample part. One pass by GROUPING SETS; counts combine map-side.
    """
    known = rows.where(F.col(cluster).isNotNull())
    if sample is None:
        return known.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("sample"), "cluster", "n")
    view = known.select(F.col(cluster).alias("cluster"), F.col(sample).alias("sample"))
    sets = view.groupingSets([[F.col("cluster")], [F.col("sample"), F.col("cluster")]], F.col("sample"), F.col("cluster")).agg(F.grouping("sample").alias("g"), F.count(F.lit(1)).alias("n"))
    return sets.where((F.col("g") == 1) | F.col("sample").isNotNull()).select("sample", "cluster", "n")


def at_thresholds(counts: DataFrame, thresholds: list[int]) -> DataFrame:
    """(min_abundance, sample, cluster, n): counts of at least each threshold, within each sample; 0 and less keeps all."""
    return counts.select(F.explode(F.array(*(F.lit(int(m)) for m in sorted(set(thresholds))))).alias("min_abundance"), "*").where((F.col("min_abundance") <= 0) | (F.col("n") >= F.col("min_abundance")))


def log_factorial(n: Column) -> Column:
    """ln n!: summed up to 256, by Stirling's series above (accurate to 1e-15 there)."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), n.cast("long"))), F.lit(0.0), lambda s, k: s + F.log(k))
    return F.when(n <= 256, small).otherwise(series)


def fisher_alpha(s: Column, n: Column) -> Column:
    """Root of S = a ln(1 + N / a) by Newton steps from S / ln(1 + N), halved when it would leave the positive side."""
    start = F.struct((s / F.log(1 + n)).alias("a"), F.lit(False).alias("done"))

    def step(x: Column, _: Column) -> Column:
        a = x["a"]
        f, df = a * F.log(1 + n / a) - s, F.log(1 + n / a) - n / (a + n)
        new = F.when(a - f / df > 0, a - f / df).otherwise(a / 2)
        return F.when(x["done"], x).otherwise(F.transform(F.array(new), lambda b: F.struct(b.alias("a"), (F.abs(b - a) < FISHER_TOLERANCE).alias("done")))[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(FISHER_STEPS)), start, step, lambda x: x["a"])


def alpha_diversity(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by`` + the INDICES of the counts (cluster, n) of each group. Groups without counts have no row.

    Everything comes from sums of functions of the counts, so one partial aggregation per group is shuffled.
    """
    n = F.col("n").cast("double")
    rare = F.when(F.col("n") <= RARE, F.col("n"))
    g = counts.where(F.col("n") > 0).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("S"), F.sum(n).alias("N"), F.sum(n * F.log(n)).alias("nlogn"), F.sum(n * n).alias("nn"), F.max(n).alias("top"), F.sum(log_factorial(F.col("n"))).alias("lf"),
        F.count_if(F.col("n") == 1).cast("double").alias("f1"), F.count_if(F.col("n") == 2).cast("double").alias("f2"),
        F.count(rare).cast("double").alias("Sr"), F.coalesce(F.sum(rare), F.lit(0)).cast("double").alias("Nr"), F.coalesce(F.sum(rare * (rare - 1)), F.lit(0)).cast("double").alias("kk"),
    )
    S, N = F.col("S"), F.col("N")
    g = g.withColumn("H", F.log(N) - F.col("nlogn") / N).withColumn("D", F.col("nn") / (N * N)).withColumn("C", F.when(F.col("Nr") > 0, 1 - F.col("f1") / F.col("Nr")))
    gamma = F.greatest(F.lit(0.0), F.col("Sr") / F.col("C") * F.col("kk") / (F.col("Nr") * (F.col("Nr") - 1)) - 1)
    ace = F.when((F.col("Sr") == 0) | (F.col("C") <= 0) | (F.col("Nr") <= 1), S).otherwise(S - F.col("Sr") + F.col("Sr") / F.col("C") + F.col("f1") / F.col("C") * gamma)
    f1, f2, H, D = F.col("f1"), F.col("f2"), F.col("H"), F.col("D")
    several = lambda c: F.when(S > 1, c).otherwise(0.0)
    values = {
        "Richness": S, "Chao1": S + f1 * (f1 - 1) / (2 * (f2 + 1)), "ACE": ace, "Shannon": H, "Simpson": 1 - D, "InverseSimpson": 1 / D,
        "Pielou_J": several(H / F.log(S)), "Heip_E": several((F.exp(H) - 1) / (S - 1)), "Berger_Parker": F.col("top") / N, "Margalef": F.when(N > 1, (S - 1) / F.log(N)).otherwise(0.0),
        "Menhinick": S / F.sqrt(N), "Brillouin": (log_factorial(N) - F.col("lf")) / N, "Fisher_alpha": fisher_alpha(S, N), "Hill_q0": S, "Hill_q1": F.exp(H), "Hill_q2": 1 / D,
    }
    return g.select(*by, *(values[k].alias(k) for k in INDICES))


def diversity_table(counts: DataFrame, thresholds: list[int], sample: bool = True) -> DataFrame:
    """(min_abundance, sample, indices): for each threshold over all rows (sample null) and per sample.

    A threshold that no count of a sample reaches gives that sample a row of zeros.
    """
    kept = alpha_diversity(at_thresholds(counts, thresholds), ["min_abundance", "sample"])
    groups = counts.select("sample").distinct().select(F.explode(F.array(*(F.lit(int(m)) for m in sorted(set(thresholds))))).alias("min_abundance"), "sample")
    joined = groups.alias("g").join(kept.alias("k"), (F.col("g.min_abundance") == F.col("k.min_abundance")) & F.col("g.sample").eqNullSafe(F.col("k.sample")), "left")
    out = joined.select("g.min_abundance", "g.sample", *(F.coalesce(F.col(f"k.{c}"), F.lit(0.0)).alias(c) for c in INDICES))
    return out if sample else out.where(F.col("sample").isNull())


def metric_by_threshold(table: DataFrame) -> DataFrame:
    """(sample, metric, m_<threshold>...): the diversity table with metrics as rows."""
    long = table.unpivot(["min_abundance", "sample"], list(INDICES), "metric", "value")
    marks = sorted(r[0] for r in table.select("min_abundance").distinct().collect())  # the thresholds asked for
    return long.groupBy("sample", "metric").pivot("min_abundance", marks).agg(F.first("value")).select("sample", "metric", *(F.col(str(m)).alias(f"m_{m}") for m in marks))


def otu_table(rows: DataFrame, cluster: str = "cluster", sample: str | None = "sample", most_columns: int = 10_000) -> DataFrame:
    """Samples x clusters counts, clusters as columns in order; without ``sample`` one row ``all_samples``."""
    rows = rows.select((F.col(sample) if sample else F.lit("all_samples")).alias("sample"), F.col(cluster).alias("cluster")).where("cluster IS NOT NULL")
    names = sorted(r[0] for r in rows.select("cluster").distinct().limit(most_columns + 1).collect())
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} clusters; use abundance() for the long form")
    return rows.groupBy("sample").pivot("cluster", names).count().na.fill(0)


def counts_of_otu_table(table: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, cluster, n) per sample and over all (sample null) from a wide table; what is no number counts 0."""
    clusters = [c for c in table.columns if c != sample]
    text = table.select(F.col(sample).cast("string").alias("sample"), *(F.col(c).cast("string").alias(c) for c in clusters))
    long = text.unpivot(["sample"], clusters, "cluster", "raw").select("sample", "cluster", F.coalesce(F.trim("raw").try_cast("double"), F.lit(0.0)).cast("long").alias("n"))
    whole = long.groupBy("cluster").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("sample"), "cluster", "n")
    return long.unionByName(whole).where(F.col("n") > 0)


def individuals(counts: DataFrame) -> DataFrame:
    """One row per counted individual, (sample, cluster)."""
    return counts.where(F.col("n") > 0).select("sample", "cluster", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_")).drop("_")
