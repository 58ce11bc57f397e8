"""Diversity, corrections, labels, training data and trees over the specimen and star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import annotate as A
from ..operators import distances as D
from ..operators import diversity as V
from ..operators import quality as Q
from ..operators import training_data as TD
from ..operators import trees as T
from ..runtime import is_blank, materialise, read_table, term
from .vector_queries import embedded, rounded

THRESHOLDS = [0, 2, 5]
CUTOFFS = [0.6, 0.7, 0.8, 0.9, 1.0]


# ---- diversity -------------------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("sample"), F.col("l_partkey").alias("cluster"))


def _table(spark, d):
    return V.diversity_table(V.abundance(_items(spark, d)), THRESHOLDS)


def div_table(spark, d):
    return rounded(_table(spark, d))


def div_by_threshold(spark, d):
    return rounded(V.metric_by_threshold(_table(spark, d)))


def div_assignments(spark, d):
    """Diversity of all assignments and of each sample."""
    rows = read_table(spark, d, "assignments").select(F.when(~is_blank("sample"), F.col("sample")).alias("sample"), term("cluster").alias("cluster"))
    return rounded(V.diversity_table(V.abundance(rows), [0]))


def div_otu_table(spark, d):
    return V.otu_table(read_table(spark, d, "events"), "event_type", "user_id")


def div_otu_counts(spark, d):
    return V.counts_of_otu_table(div_otu_table(spark, d))


def div_from_otu_table(spark, d):
    return rounded(V.diversity_table(div_otu_counts(spark, d), [0, 2]))


def div_individuals(spark, d):
    counts = V.counts_of_otu_table(div_otu_table(spark, d)).where("sample IS NULL")
    return V.individuals(counts).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# ---- corrections and labels ------------------------------------------------------------------------------------


def _assigned(spark, d):
    return read_table(spark, d, "assignments").select("id", term("cluster").alias("cluster"), "sample")


def _corrections(spark, d):
    return A.canonical_corrections(read_table(spark, d, "corrections"))


def ann_corrected(spark, d):
    """Rows of each cluster after the corrections, per sample."""
    return A.apply_corrections(_assigned(spark, d), _corrections(spark, d)).groupBy("sample", "cluster").agg(F.count(F.lit(1)).alias("n"))


def ann_changed(spark, d):
    return A.changed_assignments(_assigned(spark, d), _corrections(spark, d))


def ann_summary(spark, d):
    return A.annotation_summary(_assigned(spark, d), _corrections(spark, d))


def ann_unknown(spark, d):
    return A.unknown_corrections(_corrections(spark, d), _assigned(spark, d))


def ann_invalid(spark, d):
    return A.invalid_corrections(_corrections(spark, d))


def part_names(spark, d):
    return A.rename_clusters(_assigned(spark, d)).where("name IS NOT NULL").select("cluster", "name").distinct()


def part_summary(spark, d):
    return A.cluster_summary(_assigned(spark, d))


def part_summary_by_sample(spark, d):
    return A.cluster_summary(_assigned(spark, d), by_sample=True)


def lab_conflicts(spark, d):
    return A.label_conflicts(read_table(spark, d, "figs"))


def lab_cohort(spark, d):
    ids = read_table(spark, d, "specimen_vectors").select("id").where(~is_blank("id")).distinct()
    return A.labelled_cohort(ids, read_table(spark, d, "figs").select(F.col("image").alias("id"), "label").where("image IS NOT NULL"))


def lab_sample_validity(spark, d):
    from ..sources.tables import samples_are_valid

    return samples_are_valid(read_table(spark, d, "figs"))


def f_scalars(spark, d):
    f = read_table(spark, d, "figs")
    return f.where("image IS NOT NULL").select("image", S.sample_of_reference("image").alias("sample_of"), S.sanitised_name("label").alias("name"), S.is_number("sample").alias("numeric"), S.boolean_literal("label").alias("flag")).distinct()


def f_unique_names(spark, d):
    rows = read_table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("name"), "n_nationkey")
    return S.with_unique_names(rows, "name", ["n_nationkey"]).select("n_nationkey", "unique_name")


def f_cutoffs(spark, d):
    return S.cutoff_list(spark, 0.05, 1.0, 0.05)


def f_neighbour_counts(spark, d):
    n = spark.range(2, 2000).select(F.col("id").alias("n"))
    return n.select("n", *(S.neighbour_count(F.col("n"), s).alias(s) for s in ("fixed", "sqrt", "log", "adaptive")))


def f_seed_bins(spark, d):
    return spark.range(0, 20).select(F.col("id").alias("n"), S.seed_bin(F.col("id")).alias("bin"))


def f_manifest(spark, d):
    return S.small_manifest_hash(read_table(spark, d, "corrections").where("id IS NOT NULL AND corrected_cluster IS NOT NULL"), "id", "corrected_cluster")


def f_manifest_tree(spark, d):
    return S.manifest_hash(read_table(spark, d, "assignments"), "id", "cluster")


def f_pool(spark, d):
    return S.pool_hash(read_table(spark, d, "corrections"), "id")


def f_scaled_features(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.posexplode(S.min_max_scaled(S.doubles("embedding"))).alias("pos", "x"))
    return rounded(e.groupBy("pos").agg(F.avg("x").alias("mean"), F.max("x").alias("max")))


def f_quantiles(spark, d):
    return rounded(read_table(spark, d, "part").groupBy("p_brand").agg(S.quantile_triple(F.col("p_retailprice")).alias("q")).select("p_brand", *(F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99")))))


def f_feature_hash(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", S.feature_hash(F.col("vec_id").cast("string"), F.col("embedding")).alias("sha256"))


def f_references(spark, d):
    rows = read_table(spark, d, "figs").where("image IS NOT NULL").select("image").distinct()
    return rows.select("image", S.canonical_reference(F.col("image")).alias("ref"))


def w_runs(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "event_type")
    return T.contiguous_runs(e, "o", "event_type", ["user_id"]).select("user_id", "event_type", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "n")


# ---- training data ---------------------------------------------------------------------------------------------


def _labels(spark, d):
    return read_table(spark, d, "figs").select(term("label").alias("label"))


def tr_class_weights(spark, d):
    return rounded(TD.class_weights(_labels(spark, d)))


def tr_deferred(spark, d):
    w = TD.class_weights(read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")))
    return rounded(TD.deferred_weights(w, spark, 20))


def tr_cosine(spark, d):
    return rounded(TD.cosine_schedule(spark, 500, 5e-4, 1e-6, 50), 9)


def tr_ramp(spark, d):
    return rounded(TD.linear_ramp(spark, 200, 0.04, 0.07, 30), 9)


def tr_rectangles(spark, d):
    return TD.mask_rectangles(spark, 14, 14, 4, 40)


def tr_masks(spark, d):
    return TD.random_masks(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), 196, 60)


def tr_usage(spark, d):
    rows = _assigned(spark, d).where("cluster IS NOT NULL").select(F.col("cluster").alias("prototype"), F.lit(1.0).alias("p"))
    return rounded(TD.prototype_usage(rows, 8192))


def tr_winners(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_shipmode" if "l_shipmode" in read_table(spark, d, "lineitem").columns else "l_returnflag").alias("label"), F.col("l_linenumber").alias("sub_centre"), F.col("l_quantity").cast("double").alias("similarity"))
    return rounded(TD.centre_winners(rows))


def tr_contrastive(spark, d):
    e = embedded(spark, d)
    return rounded(TD.supervised_contrastive(D.pair_distances(e.select("id", "v")), e.select("id", "label")))


# ---- trees -----------------------------------------------------------------------------------------------------

#: A small fixed tree: (node, parent, length, name), tips named; the same rows are in the SQL.
TREE = [(0, None, 0.0, None), (1, 0, 0.5, None), (2, 0, 0.9, "deposit"), (3, 1, 0.25, "click"), (4, 1, 0.4, None), (5, 4, 0.3, "view"), (6, 4, 0.2, "purchase"), (7, 0, 0.7, None), (8, 7, 0.6, "login"), (9, 7, 0.8, "signup"), (10, 7, 0.1, "logout")]


def _tree(spark):
    nodes = spark.createDataFrame([(*r, r[3] is not None) for r in TREE], "node long, parent long, length double, name string, is_tip boolean")
    parent, pairs = {r[0]: r[1] for r in TREE}, []
    for r in TREE:
        k = r[0] if r[3] else None
        while k is not None:
            pairs.append((k, r[3]))
            k = parent[k]
    return nodes, spark.createDataFrame(pairs, "node long, tip string")


def _event_counts(spark, d):
    return read_table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("sample"), F.col("event_type").alias("tip")).agg(F.count(F.lit(1)).alias("n"))


def t_phylogenetic(spark, d):
    return rounded(T.phylogenetic_diversity(*_tree(spark), _event_counts(spark, d)))


def t_monophyly(spark, d):
    _, closure = _tree(spark)
    kinds = read_table(spark, d, "events").select("event_type").distinct().select(F.col("event_type").alias("tip"), F.when(F.col("event_type").isin("view", "purchase"), "shop").otherwise("other").alias("label"))
    return rounded(T.monophyly(closure, kinds))


def _linked(spark, d):
    e = embedded(spark, d).select("id", "v")
    D.check_pair_budget(e.count())
    ids = sorted(r.id for r in e.select("id").collect())  # the pair budget, checked before, bounds the cohort
    return T.merge_table(D.pair_distances(e), ids), ids


def t_merges(spark, d):
    return rounded(_linked(spark, d)[0])


def t_scan(spark, d):
    merges, ids = _linked(spark, d)
    return T.partition_scan(merges, S.cutoff_list(spark, 0, 0, 1, CUTOFFS), len(ids))


def t_partitions(spark, d):
    merges, ids = _linked(spark, d)
    return T.partitions(spark, T.merges_array(merges), ids, CUTOFFS)


def t_partition_metrics(spark, d):
    """Label metrics of every cut of the tree, wide by cutoff."""
    from functools import reduce

    merges, ids = _linked(spark, d)
    cuts = materialise(T.partitions(spark, T.merges_array(merges), ids, CUTOFFS).join(embedded(spark, d).select("id", "label"), "id"))
    each = [Q.external_metrics(Q.contingency(cuts.where(F.col("cutoff") == c))).select(F.lit(c).alias("cutoff"), "*") for c in CUTOFFS]
    return rounded(reduce(DataFrame.unionByName, each))


def t_optima(spark, d):
    return Q.splitting_optima(t_partition_metrics(spark, d), ["NMI", "ARI", "BCubed_F", "V_measure"])


def _class_matrix(spark, d):
    rows = Q.centroids(embedded(spark, d), "label").orderBy("label").collect()  # one row a class
    return np.array([r.centroid for r in rows]), [str(r.label) for r in rows]


def t_support(spark, d):
    x, _ = _class_matrix(spark, d)
    return rounded(T.upgma_support(spark, x, replicates=50))


def t_joining_support(spark, d):
    return rounded(T.neighbour_joining_support(spark, *_class_matrix(spark, d), replicates=50))


def t_newick(spark, d):
    x, names = _class_matrix(spark, d)
    m = T.cosine_matrix(x)
    rooted = T.midpoint_rooted(T.neighbour_joining(m, names))
    return spark.createDataFrame([("upgma", T.to_newick(T.from_merges(T.average_linkage(m), names))), ("neighbour_joining", T.to_newick(rooted))], "method string, newick string")


def t_diversity(spark, d):
    e = embedded(spark, d)
    counts = e.groupBy((F.col("id") % 7).cast("string").alias("sample"), F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(T.diversity_from_vectors(counts, Q.centroids(e, "label").withColumnRenamed("label", "cluster")))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("div", "ann", "part", "lab", "f", "w", "tr", "t") and callable(v)}

_R = "round({0}, 6) + 0.0 AS {1}"


def _diversity(counts: str, thresholds: str) -> str:
    cols = {
        "Richness": "S", "Chao1": "S + f1 * (f1 - 1) / (2 * (f2 + 1))",
        "ACE": "CASE WHEN Sr = 0 OR C <= 0 OR Nr <= 1 THEN S ELSE S - Sr + Sr / C + f1 / C * greatest(0, Sr / C * kk / (Nr * (Nr - 1)) - 1) END",
        "Shannon": "H", "Simpson": "1 - DD", "InverseSimpson": "1 / DD", "Pielou_J": "CASE WHEN S > 1 THEN H / ln(S) ELSE 0 END", "Heip_E": "CASE WHEN S > 1 THEN (exp(H) - 1) / (S - 1) ELSE 0 END",
        "Berger_Parker": "top / tot", "Margalef": "CASE WHEN tot > 1 THEN (S - 1) / ln(tot) ELSE 0 END", "Menhinick": "S / sqrt(tot)", "Brillouin": "(lgamma(tot + 1) - lf) / tot", "Fisher_alpha": "alpha",
        "Hill_q0": "S", "Hill_q1": "exp(H)", "Hill_q2": "1 / DD",
    }
    return f"""
WITH RECURSIVE c AS ({counts}), m AS (SELECT * FROM (VALUES {thresholds}) v(min_abundance)),
k AS (SELECT min_abundance, sample, n FROM c, m WHERE n > 0 AND (min_abundance <= 0 OR n >= min_abundance)),
g AS (SELECT min_abundance, sample, count(*)::DOUBLE AS S, sum(n)::DOUBLE AS tot, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS H, sum(n * n) / (sum(n)::DOUBLE * sum(n)) AS DD, max(n) AS top, sum(lgamma(n + 1)) AS lf,
  count(*) FILTER (n = 1)::DOUBLE AS f1, count(*) FILTER (n = 2)::DOUBLE AS f2, count(*) FILTER (n <= 10)::DOUBLE AS Sr, coalesce(sum(n) FILTER (n <= 10), 0)::DOUBLE AS Nr, coalesce(sum(n * (n - 1)) FILTER (n <= 10), 0)::DOUBLE AS kk FROM k GROUP BY 1, 2),
f AS (SELECT min_abundance, sample, S, tot, 0 AS step, S / ln(1 + tot) AS alpha, false AS done FROM g UNION ALL
  SELECT min_abundance, sample, S, tot, step + 1, nx, abs(nx - alpha) < 1e-6 FROM (SELECT *, CASE WHEN alpha - fx / dx > 0 THEN alpha - fx / dx ELSE alpha / 2 END AS nx FROM (SELECT *, alpha * ln(1 + tot / alpha) - S AS fx, ln(1 + tot / alpha) - tot / (alpha + tot) AS dx FROM f WHERE NOT done AND step < 100))),
l AS (SELECT min_abundance, sample, arg_max(alpha, step) AS alpha FROM f GROUP BY 1, 2),
h AS (SELECT g.*, l.alpha, CASE WHEN Nr > 0 THEN 1 - f1 / Nr END AS C FROM g JOIN l ON g.min_abundance = l.min_abundance AND g.sample IS NOT DISTINCT FROM l.sample),
s AS (SELECT DISTINCT min_abundance, sample FROM c, m)
SELECT s.min_abundance, s.sample, {', '.join(f'round(coalesce({v}, 0), 6) + 0.0 AS {k}' for k, v in cols.items())} FROM s LEFT JOIN h ON s.min_abundance = h.min_abundance AND s.sample IS NOT DISTINCT FROM h.sample"""


_TRIM = r"regexp_replace({0}, '^[ \t]+|[ \t]+$', '', 'g')"
_TERM = r"CASE WHEN regexp_matches({0}, '\S') THEN regexp_replace({0}, '^[ \t]+|[ \t]+$', '', 'g') END"
_ITEMS = "SELECT l_suppkey::VARCHAR AS sample, l_partkey AS cluster, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT NULL, l_partkey, count(*) FROM lineitem GROUP BY 2"
_OTU = "SELECT user_id::VARCHAR AS sample, event_type AS cluster, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT NULL, event_type, count(*) FROM events GROUP BY 2"
_ASSIGNED = f"a AS (SELECT id, {_TERM.format('cluster')} AS cluster, sample FROM assignments), k AS (SELECT id, {_TERM.format('corrected_cluster')} AS cluster, reviewed_at FROM corrections)"
_NEW = "n AS (SELECT id, arg_max(cluster, (reviewed_at, cluster)) AS new FROM k WHERE id IS NOT NULL AND cluster IS NOT NULL GROUP BY 1), x AS (SELECT a.*, coalesce(new, cluster) AS now FROM a LEFT JOIN n USING (id))"
_TREE_SQL = "nodes AS (SELECT * FROM (VALUES (1, 0.5, 'click'), (1, 0.5, 'view'), (1, 0.5, 'purchase'), (2, 0.9, 'deposit'), (3, 0.25, 'click'), (4, 0.4, 'view'), (4, 0.4, 'purchase'), (5, 0.3, 'view'), (6, 0.2, 'purchase'), (7, 0.7, 'login'), (7, 0.7, 'signup'), (7, 0.7, 'logout'), (8, 0.6, 'login'), (9, 0.8, 'signup'), (10, 0.1, 'logout')) v(node, length, tip))"


#: The kinds of events in the test tables.
EVENT_TYPES = ['click', 'error', 'purchase', 'signup', 'view']


def _members(by: str) -> str:
    """Whole member lists, a thousand members a row."""
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM m.{c}" for c in by.split(", "))
    return f"""WITH {_ASSIGNED}, n AS (SELECT {by}, count(*) AS n FROM a WHERE cluster IS NOT NULL GROUP BY ALL), u AS (SELECT DISTINCT {by}, id FROM a WHERE cluster IS NOT NULL AND id IS NOT NULL),
r AS (SELECT *, ((row_number() OVER (PARTITION BY {by} ORDER BY id) - 1) // 1000)::INT AS part FROM u), m AS (SELECT {by}, part, string_agg(id, ';' ORDER BY id) AS members FROM r GROUP BY ALL)
SELECT {", ".join("n." + c for c in by.split(", "))}, n.n, coalesce(part, 0) AS part, members FROM n LEFT JOIN m ON {same}"""


SQL = {
    "div_table": _diversity(_ITEMS, "(0), (2), (5)"),
    "div_by_threshold": f"SELECT sample, metric, max(value) FILTER (min_abundance = 0) AS m_0, max(value) FILTER (min_abundance = 2) AS m_2, max(value) FILTER (min_abundance = 5) AS m_5 FROM (UNPIVOT ({_diversity(_ITEMS, '(0), (2), (5)')}) ON {', '.join(V.INDICES)} INTO NAME metric VALUE value) GROUP BY 1, 2",
    "div_otu_table": "SELECT user_id AS sample, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES) + " FROM events GROUP BY 1",
    "div_assignments": _diversity(rf"SELECT sample, cluster, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(sample, '\S') THEN sample END AS sample, {_TERM.format('cluster')} AS cluster FROM assignments) WHERE cluster IS NOT NULL AND sample IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT NULL, {_TERM.format('cluster')}, count(*) FROM assignments WHERE {_TERM.format('cluster')} IS NOT NULL GROUP BY 2", "(0)"),
    "div_from_otu_table": _diversity(_OTU, "(0), (2)"),
    "div_otu_counts": _OTU,
    "div_individuals": "SELECT event_type AS cluster, count(*) AS n FROM events GROUP BY 1",
    "ann_corrected": f"WITH {_ASSIGNED}, {_NEW} SELECT sample, now AS cluster, count(*) AS n FROM x GROUP BY 1, 2",
    "ann_changed": f"WITH {_ASSIGNED}, {_NEW} SELECT id, sample, cluster AS old_cluster, now AS new_cluster FROM x WHERE cluster IS DISTINCT FROM now",
    "ann_summary": f"WITH {_ASSIGNED}, {_NEW}, y AS (SELECT cluster, 1 AS b, 0 AS f, (cluster IS DISTINCT FROM now)::INT AS l, 0 AS e FROM x UNION ALL SELECT now, 0, 1, 0, (cluster IS DISTINCT FROM now)::INT FROM x) SELECT cluster, sum(b)::BIGINT AS n_before, sum(f)::BIGINT AS n_after, sum(l)::BIGINT AS n_left, sum(e)::BIGINT AS n_entered FROM y WHERE cluster IS NOT NULL GROUP BY 1",
    "ann_unknown": f"WITH {_ASSIGNED} SELECT DISTINCT id FROM k WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM a WHERE id IS NOT NULL)",
    "ann_invalid": f"WITH {_ASSIGNED} SELECT DISTINCT id, 'missing_id' AS reason FROM k WHERE id IS NULL OR trim(id) = '' UNION ALL SELECT DISTINCT id, 'blank_cluster' FROM k WHERE id IS NOT NULL AND cluster IS NULL UNION ALL SELECT id, 'conflict' FROM k WHERE id IS NOT NULL AND cluster IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cluster) > 1",
    "part_names": f"WITH {_ASSIGNED}, z AS (SELECT cluster, count(*) AS c, min(id) AS f FROM a WHERE cluster IS NOT NULL GROUP BY 1) SELECT cluster, 'OTU_' || row_number() OVER (ORDER BY c DESC, f ASC NULLS LAST, cluster) AS name FROM z",
    "part_summary": _members("cluster"),
    "part_summary_by_sample": _members("cluster, sample"),
    "lab_conflicts": f"SELECT image, count(DISTINCT {_TERM.format('label')}) AS n_labels FROM figs WHERE image IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_TERM.format('label')}) > 1",
    "lab_cohort": rf"SELECT image AS id, min({_TERM.format('label')}) AS label FROM figs WHERE image IN (SELECT id FROM specimen_vectors WHERE regexp_matches(id, '\S')) GROUP BY 1 HAVING count(DISTINCT {_TERM.format('label')}) = 1",
    "lab_sample_validity": r"SELECT bool_and(coalesce(regexp_matches(sample, '\S'), false)) AS valid FROM figs",
    "f_references": r"SELECT DISTINCT image, CASE WHEN image = '' OR image LIKE '/%' OR image LIKE '../%' OR regexp_matches(image, '^[A-Za-z]:') THEN NULL ELSE regexp_replace(regexp_replace(image, '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g') END AS ref FROM figs WHERE image IS NOT NULL",
    "f_scalars": r"SELECT DISTINCT image, CASE WHEN contains(image, '/') THEN split_part(image, '/', 1) ELSE '' END AS sample_of, translate(regexp_replace(trim(label), '\s+', '_', 'g'), '/\', '__') AS name, try_cast(trim(sample) AS DOUBLE) IS NOT NULL AS numeric, CASE WHEN lower(trim(label)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(label)) IN ('false', '0', 'no', 'n') THEN false END AS flag FROM figs WHERE image IS NOT NULL",
    "f_unique_names": "SELECT n_nationkey, CASE WHEN r = 1 THEN n_regionkey::VARCHAR ELSE n_regionkey || '_' || r END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)",
    "f_cutoffs": "SELECT round((0.05 + i * 0.05)::DOUBLE, 6) AS cutoff FROM range(20) r(i)",
    "f_neighbour_counts": "SELECT n, least(7, n - 1) AS fixed, least(floor(sqrt(n))::BIGINT, n - 1) AS sqrt, least(greatest(5, floor(5 * log2(n)))::BIGINT, n - 1) AS log, least(greatest(5, least(100, CASE WHEN n < 100 THEN 7 WHEN n < 500 THEN floor(sqrt(n)) ELSE greatest(5, floor(5 * log2(n))) END))::BIGINT, n - 1) AS adaptive FROM range(2, 2000) r(n)",
    "f_seed_bins": "SELECT n, CASE WHEN n < 1 THEN 'none' WHEN n <= 3 THEN '3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS bin FROM range(20) r(n)",
    "f_manifest": "SELECT count(*) AS n, sha256(to_json(list([id, corrected_cluster] ORDER BY id, corrected_cluster))::VARCHAR) AS sha256 FROM corrections WHERE id IS NOT NULL AND corrected_cluster IS NOT NULL",
    "f_pool": "SELECT count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS sha256 FROM (SELECT DISTINCT id FROM corrections WHERE id IS NOT NULL)",
    "f_scaled_features": "WITH e AS (SELECT embedding::DOUBLE[] AS x, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings) SELECT (p - 1)::INT AS pos, round(avg((x[p] - lo) / (hi - lo)), 6) AS mean, round(max((x[p] - lo) / (hi - lo)), 6) AS max FROM e, range(1, 65) r(p) GROUP BY 1",
    "f_quantiles": "SELECT p_brand, round(quantile_cont(p_retailprice::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(p_retailprice::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(p_retailprice::DOUBLE, 0.99), 6) AS p99 FROM part GROUP BY 1",
    "w_runs": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM r GROUP BY user_id, event_type, g",
    "tr_class_weights": f"WITH c AS (SELECT {_TERM.format('label')} AS label, count(*) AS n FROM figs GROUP BY 1), r AS (SELECT *, (1 - 0.99::DOUBLE) / (1 - pow(0.99::DOUBLE, n)) AS raw FROM c WHERE label IS NOT NULL) SELECT label, n, round(least(raw / (SELECT sum(raw * n) / sum(n) FROM r), 3), 6) AS weight FROM r",
    "tr_deferred": "WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, (1 - 0.99::DOUBLE) / (1 - pow(0.99::DOUBLE, n)) AS raw FROM c), w AS (SELECT label, n, least(raw / (SELECT sum(raw * n) / sum(n) FROM r), 3) AS w FROM r), e AS (SELECT epoch::INT AS epoch, label, n, 1 + greatest(0, least(1, (epoch - 10) / 2.0::DOUBLE)) * (w - 1) AS w FROM w, range(20) g(epoch)) SELECT epoch, label, round(w / (sum(w * n) OVER (PARTITION BY epoch) / sum(n) OVER (PARTITION BY epoch)), 6) AS weight FROM e",
    "tr_cosine": "SELECT s AS step, round(CASE WHEN s < 50 THEN 5e-4::DOUBLE * s / 49 ELSE 1e-6::DOUBLE + (5e-4::DOUBLE - 1e-6::DOUBLE) / 2 * (1 + cos(pi() * (s - 50) / 450)) END, 9) AS value FROM range(500) r(s)",
    "tr_ramp": "SELECT s AS step, round(0.04::DOUBLE + least(1, s / 29) * 0.03::DOUBLE, 9) AS value FROM range(200) r(s)",
    "tr_rectangles": 'SELECT t::INT AS top, l::INT AS "left", h::INT AS h, w::INT AS w FROM range(1, 15) a(h), range(1, 15) b(w), range(14) c(t), range(14) d(l) WHERE h * w BETWEEN 4 AND 40 AND h / w BETWEEN 0.3::DOUBLE AND 1 / 0.3::DOUBLE AND t + h <= 14 AND l + w <= 14',
    "tr_usage": f"WITH c AS (SELECT {_TERM.format('cluster')} AS k, count(*) AS n FROM assignments GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c WHERE k IS NOT NULL) SELECT round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS perplexity, round(count(*) / 8192, 6) AS active_ratio, round(max(p), 6) AS max_occupancy FROM p",
    "tr_winners": "WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_returnflag) AS r FROM lineitem) WHERE r = 1), c AS (SELECT l_returnflag AS label, l_linenumber AS sub_centre, count(*) AS n FROM b GROUP BY 1, 2) SELECT label, sub_centre, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c",
    "tr_contrastive": """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda y: y / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings),
s AS (SELECT a.id, list_dot_product(a.u, b.u) / 0.07::DOUBLE AS s, a.label = b.label AS same FROM e a JOIN e b ON a.id <> b.id), g AS (SELECT id, ln(sum(exp(s))) AS lse, avg(s) FILTER (same) AS pos FROM s GROUP BY 1) SELECT round(avg(lse - pos), 6) AS loss FROM g WHERE pos IS NOT NULL""",
    "t_phylogenetic": f"WITH {_TREE_SQL}, c AS (SELECT user_id::VARCHAR AS sample, event_type AS tip, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT * FROM c WHERE tip IN (SELECT tip FROM nodes)), t AS (SELECT sample, sum(n) AS tot, count(*) AS richness FROM s GROUP BY 1), b AS (SELECT sample, node, any_value(length)::DOUBLE AS length, sum(n) AS k FROM s JOIN nodes USING (tip) GROUP BY 1, 2) SELECT sample, richness, round(sum(length), 6) AS faith_pd, round(sum(length * k / tot), 6) AS weighted_rooted, round(sum(length * 2 * least(k / tot, 1 - k / tot)), 6) + 0.0 AS weighted_unrooted, round(sum(length) / richness, 6) AS pd_richness_norm FROM b JOIN t USING (sample) GROUP BY sample, richness",
    "t_monophyly": f"WITH {_TREE_SQL}, cl AS (SELECT node, tip FROM nodes UNION ALL SELECT DISTINCT 0, tip FROM nodes), k AS (SELECT DISTINCT event_type AS tip, CASE WHEN event_type IN ('view', 'purchase') THEN 'shop' ELSE 'other' END AS label FROM events), tot AS (SELECT label, count(*) AS n FROM k WHERE tip IN (SELECT tip FROM cl) GROUP BY 1), u AS (SELECT node, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY node) AS a FROM cl JOIN k USING (tip) GROUP BY 1, 2) SELECT round((SELECT count(DISTINCT u.label) FROM u JOIN tot ON u.label = tot.label WHERE u.c = tot.n AND u.a = tot.n) / nullif((SELECT count(*) FROM tot), 0), 6) AS proportion",
}
