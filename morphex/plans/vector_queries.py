"""Distances, cluster quality, retrieval and pseudo-labels over the table embeddings (vec_id, embedding, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distances as D
from ..operators import pseudo_labels as P
from ..operators import quality as Q
from ..operators import retrieval as R
from ..runtime import read_table

PLACES = 6
KS = [1, 5, 10]
RULES = P.Rules(floor=0.2, gap=0.01, neighbours=15, cap_per_seed=3, cap=10)


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Every double to ``places``, without negative zero."""
    one = lambda c: (F.round(F.col(c), places) + 0.0).alias(c)
    return df.select(*(one(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """(id, v, label, cluster); cluster is a stand-in partition that SQL can state."""
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", (F.col("vec_id") % 12).cast("int").alias("cluster"))


def _pairs(spark: SparkSession, d: str, metric: str = "cosine") -> DataFrame:
    return D.pair_distances(embedded(spark, d).select("id", "v"), metric)


def ds_summary(spark, d):
    return rounded(D.cohort_summary(embedded(spark, d).select("id", "v")))


def ds_euclidean(spark, d):
    return rounded(D.cohort_summary(embedded(spark, d).select("id", "v"), "euclidean"))


def ds_within_label(spark, d):
    return rounded(D.within_class_summary(_pairs(spark, d), embedded(spark, d).select("id", "label")))


def ds_within_cluster(spark, d):
    return rounded(D.within_class_summary(_pairs(spark, d), embedded(spark, d).select("id", F.col("cluster").alias("label"))))


def ds_local_scaling(spark, d):
    return rounded(D.cohort_summary(D.local_scales(embedded(spark, d).select("id", "v"), 7), scale="scale"))


def ds_pairs_scaled(spark, d):
    """The same from the pair table."""
    return rounded(D.distance_summary(D.local_scaling(_pairs(spark, d), 7)))


def ds_histogram(spark, d):
    return rounded(D.histogram(_pairs(spark, d), 60, 0.0, 2.0))


def ds_log_histogram(spark, d):
    return rounded(D.histogram(_pairs(spark, d), 40, -2.0, 1.0, logarithmic=True))


def ds_cumulative(spark, d):
    return rounded(D.cumulative(_pairs(spark, d), 20))


def ds_paired(spark, d):
    e = embedded(spark, d).select("id", "v")
    return rounded(D.paired_similarity(e, e.select("id", F.reverse("v").alias("v"))))


def ds_different(spark, d):
    return rounded(D.different_similarity(_pairs(spark, d), most=1_000_000_000))


def ds_whitened(spark, d):
    return rounded(D.distance_summary(D.pair_distances(D.whitened(embedded(spark, d).select("id", F.col("v").cast("array<double>").alias("v")), 32), unit=False, metric="euclidean")))


def q_external(spark, d):
    return rounded(Q.external_metrics(Q.contingency(embedded(spark, d))))


def q_external_large(spark, d):
    """Clusters of the assignments against the labels of their images, all rows."""
    from ..runtime import term

    labels = read_table(spark, d, "figs").select(F.col("image").alias("id"), term("label").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").distinct()
    rows = read_table(spark, d, "assignments").select("id", term("cluster").alias("cluster")).where("id IS NOT NULL AND cluster IS NOT NULL").distinct()
    return rounded(Q.external_metrics(Q.contingency(rows.join(labels, "id"))))


def q_ami(spark, d):
    value = Q.adjusted_mutual_information(Q.contingency(read_table(spark, d, "part"), "p_type", "p_brand"))
    return spark.createDataFrame([(value,)], "AMI double").select(F.round("AMI", PLACES).alias("AMI"))


def q_wss(spark, d):
    return rounded(Q.within_sum_of_squares(embedded(spark, d), "cluster"))


def q_silhouette_cluster(spark, d):
    return rounded(Q.silhouette(embedded(spark, d), "cluster"))


def q_silhouette_label(spark, d):
    return rounded(Q.silhouette(embedded(spark, d), "label"))


def q_diagnostics(spark, d):
    return rounded(Q.label_diagnostics(embedded(spark, d)))


def q_spread(spark, d):
    return rounded(Q.dimension_spread(embedded(spark, d)))


def q_centroids(spark, d):
    return rounded(Q.centroids(embedded(spark, d), "label").select("label", "n", F.posexplode("centroid").alias("pos", "x")))


def q_kmeans(spark, d):
    e = embedded(spark, d)
    found = R.kmeans_clusters(e, 10)
    return rounded(Q.external_metrics(Q.contingency(e.select("id", "label").join(found, "id"))))


def _ranked(spark, d):
    return R.ranked_neighbours(_pairs(spark, d), embedded(spark, d).select("id", "label"))


def r_recall(spark, d):
    return rounded(R.recall_of(R.query_ranks(embedded(spark, d).select("id", "v", "label")), KS, read_table(spark, d, "embeddings").count()))


def r_map(spark, d):
    return rounded(R.query_ranks(embedded(spark, d).select("id", "v", "label")).agg(F.avg("ap").alias("mAP")))


def _folds(spark, d):
    return R.with_folds(embedded(spark, d).select("id", "label"))


def r_folds(spark, d):
    return _folds(spark, d)


def r_knn_accuracy(spark, d):
    return rounded(R.knn_accuracy(_pairs(spark, d), _folds(spark, d), [1, 5, 20]))


def r_knn_fixed_folds(spark, d):
    """The same with folds that SQL can state."""
    return rounded(R.knn_accuracy(_pairs(spark, d), embedded(spark, d).select("id", "label", (F.col("id") % 5).cast("int").alias("fold")), [1, 5, 20]))


def r_linear_probe(spark, d):
    return R.linear_probe(embedded(spark, d).select("id", "v"), _folds(spark, d))


def _is_seed(c: Column | str = "id") -> Column:
    return (F.col(c) if isinstance(c, str) else c) % 5 == 0


def _seeds(spark, d):
    return embedded(spark, d).where(_is_seed()).select(F.col("id").alias("ref"), F.col("label").cast("string").alias("label"), "v")


def _decisions(spark, d):
    return P.decide(embedded(spark, d).where(~_is_seed()).select(F.col("id").alias("ref"), "v"), _seeds(spark, d), RULES)


def pl_decisions(spark, d):
    x = _decisions(spark, d)
    return rounded(x.withColumn("reasons", F.array_join("reasons", ";")).drop("near_duplicate"))


def pl_reasons(spark, d):
    return P.rejection_counts(_decisions(spark, d))


def pl_bins(spark, d):
    return rounded(P.bin_summary(_decisions(spark, d)))


def pl_counterfactuals(spark, d):
    return P.counterfactuals(_decisions(spark, d))


def pl_summary(spark, d):
    s = P.summary(_decisions(spark, d))
    return rounded(s.select("candidates", "accepted", "rate", *(F.col(f"{c}_quantiles")[i].alias(f"{c}_{q}") for c in ("score", "gap") for i, q in enumerate(("p50", "p90", "p99")))))


def pl_leave_one_out(spark, d):
    return rounded(P.leave_one_out(_seeds(spark, d)))


def pl_copies(spark, d):
    """Candidates with the content and the features of an expert's image, among all embeddings under new names."""
    sha = F.concat(F.lit("x"), F.col("id"))
    e = embedded(spark, d)
    seeds = e.where(_is_seed()).select(F.col("id").alias("ref"), F.col("label").cast("string").alias("label"), "v", sha.alias("sha"))
    found = P.decide(e.select((F.col("id") + 1_000_000).alias("ref"), "v", sha.alias("sha")), seeds, RULES)
    return found.where(F.array_contains("reasons", "expert_content_duplicate")).select("ref", "near_duplicate", "accepted")


def pl_accepted_copies(spark, d):
    """What becomes of accepted candidates of equal content."""
    e = embedded(spark, d).where(~_is_seed()).select(F.col("id").alias("ref"), "v", F.concat(F.lit("y"), F.col("id") % 7).alias("sha"))
    found = P.decide(e, _seeds(spark, d).withColumn("sha", F.lit("none")), RULES)
    return found.where("pre_cap").select("ref", "label", "accepted", F.array_join("reasons", ";").alias("reasons"))


def pl_round(spark, d):
    return P.pseudo_round(_decisions(spark, d), _seeds(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("ds", "q", "r", "pl") and callable(v)}

_E = """
WITH e AS (
  SELECT vec_id AS id, label, vec_id % 12 AS cluster, embedding::DOUBLE[] AS x,
         list_transform(embedding::DOUBLE[], lambda y: y / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u
  FROM embeddings
)"""
_P = _E + ", p AS (SELECT a.id AS i, b.id AS j, greatest(0, least(2, 1 - list_dot_product(a.u, b.u))) AS d FROM e a JOIN e b ON a.id < b.id)"
_S = _P + ", s AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p)"
_STATS = """count(d) AS n_pairs, round(min(d), 6) AS min, round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(quantile_cont(d, 0.5), 6) AS median,
  round(quantile_cont(d, 0.01), 6) AS p01, round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99"""


def _within(key: str) -> str:
    return _P + f"""
, st AS (SELECT a.{key} AS label, count(d) AS n_pairs, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_pop(d) AS std, min(d) AS min, max(d) AS max, quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.75) AS q75
  FROM p JOIN e a ON p.i = a.id JOIN e b ON p.j = b.id WHERE a.{key} = b.{key} GROUP BY 1)
SELECT n.label, n_samples, coalesce(n_pairs, 0) AS n_pairs, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(q25, 6) AS q25, round(q75, 6) AS q75
FROM (SELECT {key}::INT AS label, count(*) AS n_samples FROM e GROUP BY 1) n LEFT JOIN st ON n.label = st.label"""


def _histogram(bins: int, low: float, high: float, value: str, where: str) -> str:
    width = (high - low) / bins
    return _P + f""", h AS (SELECT least(floor(({value} - ({low})) / {width}), {bins - 1})::INT AS bin, count(*) AS n FROM p WHERE {where} AND {value} BETWEEN {low} AND {high} GROUP BY 1)
SELECT b::INT AS bin, round(({low} + b * {width})::DOUBLE, 6) + 0.0 AS low, round(({low} + (b + 1) * {width})::DOUBLE, 6) + 0.0 AS high, coalesce(n, 0) AS n FROM range({bins}) r(b) LEFT JOIN h ON bin = b"""


_TABLE = """
, a AS (SELECT true_, sum(n) AS a, count(*) AS k FROM c GROUP BY 1), b AS (SELECT pred, sum(n) AS b, count(*) AS k, max(n) AS top FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS tot FROM c),
i AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n / tot * ln(tot * n / (a * b))) AS mi, sum(n * n / b) / any_value(tot) AS bp, sum(n * n / a) / any_value(tot) AS br FROM c JOIN a USING (true_) JOIN b USING (pred), t),
r AS (SELECT sum(a * (a - 1) / 2.0) AS sa, -sum(a / tot * ln(a / tot)) AS ht, count(*) AS n_true, avg(k) AS splitting FROM a, t),
q AS (SELECT sum(b * (b - 1) / 2.0) AS sb, -sum(b / tot * ln(b / tot)) AS hp, count(*) AS n_pred, avg(k) AS lumping, sum(top) / any_value(tot) AS purity FROM b, t),
m AS (SELECT *, sa * sb / (tot * (tot - 1) / 2) AS ex, mi / ht AS hom, mi / hp AS com FROM i, r, q, t)
SELECT round(mi / ((ht + hp) / 2), 6) AS NMI, round((s - ex) / ((sa + sb) / 2 - ex), 6) AS ARI, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS V_measure,
  round(bp, 6) AS BCubed_precision, round(br, 6) AS BCubed_recall, round(2 * bp * br / (bp + br), 6) AS BCubed_F, round(2 * bp * br / (bp + br), 6) AS BCubed_fscore,
  round(purity, 6) AS purity, round(splitting, 6) AS splitting, round(lumping, 6) AS lumping, n_pred AS n_OTUs, n_true AS n_true_species, round(n_pred / greatest(1, n_true), 6) AS OTU_species_ratio FROM m"""

_SILHOUETTE = _E + """, sums AS (SELECT {k} AS g, list(y ORDER BY pos) AS t, any_value(n) AS n FROM (SELECT {k}, pos, sum(u[pos]) AS y, count(*) AS n FROM e, range(1, 65) r(pos) GROUP BY 1, 2) GROUP BY 1)
, ds AS (SELECT id, {k} AS own, g, n, list_dot_product(u, t) AS dp, list_dot_product(u, u) AS uu FROM e, sums)
, ab AS (SELECT id, max(CASE WHEN own = g THEN n END) AS n, max(CASE WHEN own = g AND n > 1 THEN 1 - (dp - uu) / (n - 1) END) AS a, min(CASE WHEN own <> g THEN 1 - dp / n END) AS b FROM ds GROUP BY 1)
SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM ab"""

_RANKED = _S + """, ranked AS (SELECT s.i, s.j, row_number() OVER (PARTITION BY s.i ORDER BY d, s.j) AS rank, a.label = b.label AS same, a.label AS li, b.label AS lj, d FROM s JOIN e a ON s.i = a.id JOIN e b ON s.j = b.id)"""

_DECIDE = _E + """
, seed AS (SELECT id, label::VARCHAR AS label, u FROM e WHERE id % 5 = 0), cand AS (SELECT id, u FROM e WHERE id % 5 <> 0)
, cls AS (SELECT label, count(*) AS n, count(*) >= 3 AS ok FROM seed GROUP BY 1)
, sim AS (SELECT c.id AS ref, s.id AS seed, s.label, list_dot_product(c.u, s.u) AS sm FROM cand c, seed s)
, rk AS (SELECT *, row_number() OVER (PARTITION BY ref, label ORDER BY sm DESC, seed) AS rc, row_number() OVER (PARTITION BY ref ORDER BY sm DESC, seed) AS ra, row_number() OVER (PARTITION BY seed ORDER BY sm DESC, ref) AS rs FROM sim)
, score AS (SELECT ref, label, any_value(ok) AS ok, any_value(n) AS n, CASE WHEN any_value(ok) THEN avg(sm) FILTER (rc <= 3) ELSE max(sm) END AS sc FROM rk JOIN cls USING (label) GROUP BY ref, label)
, win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sc DESC, label) AS r FROM score WHERE ok) WHERE r = 1)
, run AS (SELECT * FROM (SELECT s.ref, s.label, s.sc, s.ok, row_number() OVER (PARTITION BY s.ref ORDER BY s.sc DESC, s.label) AS r FROM score s JOIN win w ON s.ref = w.ref AND s.label <> w.label) WHERE r = 1)
, pool AS (SELECT seed, ref, sm, false AS rival FROM sim UNION ALL SELECT a.id, b.id, list_dot_product(a.u, b.u), true FROM seed a JOIN seed b ON a.label <> b.label)
, back AS (SELECT seed, ref, rival FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sm DESC, ref) AS r FROM pool) WHERE r <= 15)
, mut AS (SELECT k.ref, count(*)::INT AS m FROM rk k JOIN win w ON k.ref = w.ref AND k.label = w.label JOIN back b ON b.seed = k.seed AND b.ref = k.ref AND NOT b.rival WHERE k.ra <= 15 GROUP BY 1)
, base AS (SELECT w.ref, w.label, w.sc AS score, r.label AS runner_up, r.sc AS runner_score, w.sc - r.sc AS gap, w.n::INT AS seed_count, coalesce(m, 0)::INT AS mutual_seeds,
    list_filter([CASE WHEN NOT w.sc > 0.2 THEN 'floor' END, CASE WHEN NOT w.sc - r.sc > 0.01 THEN CASE WHEN r.ok THEN 'gap_eligible' ELSE 'gap_undersupported' END END, CASE WHEN coalesce(m, 0) = 0 THEN 'not_mutual' END], lambda x: x IS NOT NULL) AS reasons
  FROM win w LEFT JOIN run r ON w.ref = r.ref LEFT JOIN mut ON mut.ref = w.ref)
, ranked AS (SELECT *, len(reasons) = 0 AS pre_cap, CASE WHEN len(reasons) = 0 THEN (row_number() OVER (PARTITION BY label, len(reasons) = 0 ORDER BY score DESC, ref) - 1)::INT END AS rank FROM base)
, done AS (SELECT * REPLACE (CASE WHEN pre_cap AND rank >= least(3 * seed_count, 10) THEN ['class_cap'] ELSE reasons END AS reasons) FROM ranked)
"""

SQL = {
    "ds_summary": _P + f" SELECT {_STATS} FROM p",
    "ds_euclidean": _E + f", p AS (SELECT sqrt(greatest(0, list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS d FROM e a JOIN e b ON a.id < b.id) SELECT {_STATS} FROM p",
    "ds_within_label": _within("label"),
    "ds_within_cluster": _within("cluster"),
    "ds_local_scaling": _S + f", k AS (SELECT i, d AS sc FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM s) WHERE r = 7), l AS (SELECT p.d / greatest(sqrt(a.sc * b.sc), 1e-10) AS d FROM p JOIN k a ON p.i = a.i JOIN k b ON p.j = b.i) SELECT {_STATS} FROM l",
    "ds_pairs_scaled": _S + f", k AS (SELECT i, d AS sc FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM s) WHERE r = 7), l AS (SELECT p.d / greatest(sqrt(a.sc * b.sc), 1e-10) AS d FROM p JOIN k a ON p.i = a.i JOIN k b ON p.j = b.i) SELECT {_STATS} FROM l",
    "ds_histogram": _histogram(60, 0.0, 2.0, "d", "true"),
    "ds_log_histogram": _histogram(40, -2.0, 1.0, "log10(d)", "d > 0"),
    "ds_cumulative": _P + " SELECT q / 20 AS share, round((SELECT quantile_cont(d, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95, 1]) FROM p)[q + 1], 6) AS d FROM range(21) r(q)",
    "ds_paired": _E + ", c AS (SELECT list_dot_product(u, list_reverse(u)) AS c FROM e) SELECT count(*) AS n, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.1), 6) AS p10, round(min(c), 6) AS min FROM c",
    "ds_different": _P + " SELECT count(*) AS pair_count, round(quantile_cont(1 - d, 0.5), 6) AS median, round(quantile_cont(1 - d, 0.9), 6) AS p90 FROM p",
    "q_external": _E + ", c AS (SELECT label AS true_, cluster AS pred, count(*) AS n FROM e GROUP BY 1, 2)" + _TABLE,
    "q_external_large": r"""WITH l AS (SELECT DISTINCT image AS id, regexp_replace(label, '^[ \t]+|[ \t]+$', '', 'g') AS label FROM figs WHERE regexp_matches(label, '\S') AND image IS NOT NULL),
x AS (SELECT DISTINCT id, regexp_replace(cluster, '^[ \t]+|[ \t]+$', '', 'g') AS cluster FROM assignments WHERE regexp_matches(cluster, '\S') AND id IS NOT NULL),
c AS (SELECT label AS true_, cluster AS pred, count(*) AS n FROM l JOIN x USING (id) GROUP BY 1, 2)""" + _TABLE,
    "q_ami": """WITH c AS (SELECT p_type AS t, p_brand AS p, count(*) AS n FROM part GROUP BY 1, 2), a AS (SELECT t, sum(n)::BIGINT AS a FROM c GROUP BY 1), b AS (SELECT p, sum(n)::BIGINT AS b FROM c GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS tot FROM c),
mi AS (SELECT sum(n / tot * ln(tot::DOUBLE * n / (a * b))) AS mi FROM c JOIN a USING (t) JOIN b USING (p), t), h AS (SELECT (SELECT -sum(a / tot * ln(a / tot)) FROM a, t) AS ht, (SELECT -sum(b / tot * ln(b / tot)) FROM b, t) AS hp),
ab AS (SELECT a, b, tot, unnest(generate_series(greatest(1, a + b - tot), least(a, b))) AS k FROM a, b, t),
ex AS (SELECT sum(k / tot * ln(tot::DOUBLE * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(tot - a + 1) + lgamma(tot - b + 1) - lgamma(tot + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(tot - a - b + k + 1))) AS e FROM ab)
SELECT round((mi - e) / ((ht + hp) / 2 - e), 6) + 0.0 AS AMI FROM mi, h, ex""",
    "q_wss": _E + ", m AS (SELECT cluster, pos, avg(x[pos]) AS y FROM e, range(1, 65) r(pos) GROUP BY 1, 2) SELECT round(sum((x[pos] - y) * (x[pos] - y)), 6) AS WSS FROM e JOIN m USING (cluster)",
    "q_silhouette_cluster": _SILHOUETTE.format(k="cluster"),
    "q_silhouette_label": _SILHOUETTE.format(k="label"),
    "q_diagnostics": _P + """, intra AS (SELECT avg(m) AS v FROM (SELECT a.label, avg(1 - list_dot_product(a.u, b.u)) AS m FROM e a JOIN e b ON a.label = b.label AND a.id < b.id GROUP BY 1))
, c AS (SELECT label, list(y ORDER BY pos) AS m FROM (SELECT label, pos, avg(u[pos]) AS y FROM e, range(1, 65) r(pos) GROUP BY 1, 2) GROUP BY 1)
, inter AS (SELECT avg(1 - list_dot_product(a.m, b.m)) AS v FROM c a JOIN c b ON a.label < b.label)
SELECT round(intra.v, 6) AS intra_class_distance, round(inter.v, 6) AS inter_class_distance, round((SELECT avg(sqrt(list_dot_product(x, x))) FROM e), 6) AS norm_mean, round((SELECT stddev_pop(sqrt(list_dot_product(x, x))) FROM e), 6) AS norm_std FROM intra, inter""",
    "q_spread": _E + " SELECT round(avg(s), 6) AS feature_std FROM (SELECT pos, stddev_samp(x[pos]) AS s FROM e, range(1, 65) r(pos) GROUP BY 1)",
    "q_centroids": _E + ", m AS (SELECT label, pos, avg(x[pos]) AS y, count(*) AS n FROM e, range(1, 65) r(pos) GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(y * y)) AS z FROM m GROUP BY 1) SELECT label, n, (pos - 1)::INT AS pos, round(y / CASE WHEN z < 1e-12 THEN 1 ELSE z END, 6) + 0.0 AS x FROM m JOIN s USING (label)",
    "r_recall": _RANKED + ", f AS (SELECT i, min(rank) FILTER (same) AS f FROM ranked GROUP BY 1) SELECT k::INT AS k, round(avg(coalesce((f <= k)::INT, 0)), 6) AS recall FROM f, (VALUES (1), (5), (10)) v(k) GROUP BY k",
    "r_map": _RANKED + ", h AS (SELECT i, rank, same, sum(same::INT) OVER (PARTITION BY i ORDER BY rank) AS hits FROM ranked) SELECT round(avg(ap), 6) AS mAP FROM (SELECT i, avg(hits / rank) AS ap FROM h WHERE same GROUP BY 1)",
    "r_knn_fixed_folds": _S + """, near AS (SELECT s.i, a.label AS lt, b.label AS lj, s.i % 5 AS f, row_number() OVER (PARTITION BY s.i ORDER BY d, s.j) AS r FROM s JOIN e a ON s.i = a.id JOIN e b ON s.j = b.id WHERE s.i % 5 <> s.j % 5)
, votes AS (SELECT k, f, i, lt, lj, count(*) AS n FROM near, (VALUES (1), (5), (20)) v(k) WHERE r <= k GROUP BY ALL)
, win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY n DESC, lj) AS r FROM votes) WHERE r = 1)
SELECT k::INT AS k, round(avg(a), 6) AS accuracy FROM (SELECT k, f, avg((lj = lt)::INT) AS a FROM win GROUP BY 1, 2) GROUP BY 1""",
    "pl_decisions": _DECIDE + "SELECT ref, label, round(score, 6) AS score, runner_up, round(runner_score, 6) AS runner_score, round(gap, 6) + 0.0 AS gap, seed_count, mutual_seeds, array_to_string(reasons, ';') AS reasons, pre_cap, len(reasons) = 0 AS accepted, rank FROM done",
    "pl_reasons": _DECIDE + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM done) GROUP BY 1",
    "pl_bins": _DECIDE + ", g AS (SELECT CASE WHEN seed_count IS NULL OR seed_count < 1 THEN 'none' WHEN seed_count <= 3 THEN '3' WHEN seed_count <= 5 THEN '4-5' WHEN seed_count <= 10 THEN '6-10' ELSE '>10' END AS bin, count(*) AS c, count(*) FILTER (len(reasons) = 0) AS a FROM done GROUP BY 1) SELECT v.bin, coalesce(c, 0) AS candidates, coalesce(a, 0) AS accepted, round(a / c, 6) AS rate FROM (VALUES ('none'), ('3'), ('4-5'), ('6-10'), ('>10')) v(bin) LEFT JOIN g ON g.bin = v.bin",
    "pl_counterfactuals": _DECIDE + "SELECT count(*) FILTER (reasons = ['floor']) AS without_floor, count(*) FILTER (reasons = ['gap_eligible'] OR reasons = ['gap_undersupported']) AS without_gap, count(*) FILTER (reasons = ['not_mutual']) AS without_mutual FROM done",
    "pl_leave_one_out": _E + """, seed AS (SELECT id, label::VARCHAR AS label, u FROM e WHERE id % 5 = 0), cls AS (SELECT label, count(*) AS n FROM seed GROUP BY 1)
, sim AS (SELECT a.id AS ref, a.label AS own, b.label, list_dot_product(a.u, b.u) AS sm, row_number() OVER (PARTITION BY a.id, b.label ORDER BY list_dot_product(a.u, b.u) DESC, b.id) AS r FROM seed a JOIN seed b ON a.id <> b.id JOIN cls c ON a.label = c.label WHERE c.n >= 4)
, sc AS (SELECT ref, own, label, CASE WHEN any_value(n) >= 3 THEN avg(sm) FILTER (r <= 3) ELSE max(sm) END AS sc FROM sim JOIN cls USING (label) GROUP BY 1, 2, 3)
SELECT ref, own AS label, round(max(sc) FILTER (label = own), 6) AS within, round(max(sc) FILTER (label <> own), 6) AS other, round(max(sc) FILTER (label = own) - max(sc) FILTER (label <> own), 6) + 0.0 AS gap FROM sc GROUP BY 1, 2""",
    "pl_summary": _DECIDE + "SELECT count(*) AS candidates, count(*) FILTER (len(reasons) = 0) AS accepted, round(count(*) FILTER (len(reasons) = 0) / count(*), 6) AS rate, " + ", ".join(f"round(quantile_cont({c}, {q / 100}) FILTER (len(reasons) = 0), 6) AS {c}_p{q}" for c in ("score", "gap") for q in (50, 90, 99)) + " FROM done",
    "pl_copies": "SELECT vec_id + 1000000 AS ref, true AS near_duplicate, false AS accepted FROM embeddings WHERE vec_id % 5 = 0",
    "pl_accepted_copies": _DECIDE + ", w AS (SELECT ref, label, len(reasons) = 0 AS ok, reasons, min(ref) FILTER (len(reasons) = 0) OVER (PARTITION BY ref % 7) AS first FROM done WHERE pre_cap) SELECT ref, label, ok AND ref = first AS accepted, CASE WHEN ok AND ref <> first THEN 'accepted_content_duplicate' ELSE array_to_string(reasons, ';') END AS reasons FROM w",
    "pl_round": _DECIDE + "SELECT id AS ref, label, 'expert' AS source FROM seed UNION ALL SELECT ref, label, 'pseudo' FROM done WHERE len(reasons) = 0",
}
