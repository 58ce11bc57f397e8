"""Readers, writers and small functions as queries: files are written to the shared folder and read back; SQL states what must come out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import annotate as A
from ..operators import distances as D
from ..operators import retrieval as R
from ..operators import training_data as TD
from ..operators import trees as T
from ..runtime import read_table, shared_path
from ..sources import sinks as K
from ..sources import tables as I
from .vector_queries import embedded, rounded

# ---- readers ---------------------------------------------------------------------------------------------------


def _figs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "figs").select("image", "label", "sample")


def s_csv(spark, d):
    out = shared_path(spark, "csv")
    K.write_table(_figs(spark, d), out, "csv")
    return I.read_csv(spark, out)


def s_csv_compressed(spark, d):
    out = shared_path(spark, "gzip")
    read_table(spark, d, "customer").select("c_custkey", "c_nationkey").write.option("header", True).option("compression", "gzip").csv(out)
    return I.read_csv(spark, out, "c_custkey long, c_nationkey long")


def _sheet(spark: SparkSession, d: str) -> str:
    """Orders as delimited text; every 97th has a field too many. Every file begins with the header."""
    import pyarrow as pa

    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "more"))

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["o_orderkey,o_custkey,o_orderstatus"])], names=["value"])
        yield from (pa.RecordBatch.from_arrays(b.columns, names=["value"]) for b in batches)

    out = shared_path(spark, "sheet")
    read_table(spark, d, "orders").select(line.alias("value")).mapInArrow(headed, "value string").write.text(out)
    return out


def s_rectangular(spark, d):
    return I.read_rectangular(spark, _sheet(spark, d))[0]


def s_ragged(spark, d):
    return I.read_rectangular(spark, _sheet(spark, d))[1]


def s_invalid_embeddings(spark, d):
    return I.invalid_embeddings(I.vectors_from_wide(read_table(spark, d, "specimen_vectors")))


def s_labels(spark, d):
    return I.label_table(_figs(spark, d))


def s_literal_ids(spark, d):
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.concat(F.lit("00"), k)).when(kind == 1, k).when(kind == 2, F.concat(F.lit("+"), k)).otherwise(F.concat(k, F.lit(".50")))
    return I.rewritten_ids(read_table(spark, d, "orders").select(written.alias("id")))


def s_assignments(spark, d):
    return I.assignment_table(read_table(spark, d, "assignments").select(F.col("id").alias("Image"), F.col("cluster").alias("CLUSTER"), F.col("sample").alias("Sample"), "assigned_at"))


def s_otu_table(spark, d):
    from ..operators.diversity import otu_table

    out = shared_path(spark, "otu")
    K.write_table(otu_table(read_table(spark, d, "events"), "event_type", "user_id"), out, "csv")
    return I.read_otu_table(spark, out)


def _cut_customers(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.explode(F.array(F.lit(0.25), F.lit(0.5))).alias("cutoff"), "c_custkey")
    return rows.select("cutoff", "id", F.concat(F.lit("OTU_"), F.col("c_custkey") % F.when(F.col("cutoff") < 0.4, 40).otherwise(12)).alias("cluster"))


def s_partitions(spark, d):
    out = shared_path(spark, "partitions")
    for cutoff in (0.25, 0.5):
        K.write_table(_cut_customers(spark, d).where(F.col("cutoff") == cutoff).select("id", "cluster"), f"{out}/partition_{K.cutoff_tag(cutoff)}_assignments.csv", "csv")
    return I.read_partitions(spark, out)


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    return n.select(F.col("n_name").alias("id"), F.array(F.col("n_nationkey") + 1.0, F.col("n_regionkey") + 1.0, F.lit(1.0)).alias("v"))


def s_distance_matrix(spark, d):
    """All nations, as a square file."""
    rows = _nations(spark, d)
    out = shared_path(spark, "matrix")
    K.write_table(K.square_matrix(D.pair_distances(rows), sorted(r.id for r in rows.select("id").collect())), out, "csv")  # 25 names
    return rounded(I.read_distance_matrix(spark, out))


NEWICK = "((a:1,b:2)90:0.5,((c:1.5,d:1)70:0.25,e:3)40:2);"


def s_newick(spark, d):
    """Clades and their support in a tree file."""
    out = shared_path(spark, "trees")
    K.write_newick(spark.createDataFrame([(NEWICK,)], "newick string"), out)
    root = T.parse_newick(spark.read.text(out).first().value)
    found = T.clade_supports(root, set(root.tips()))
    return spark.createDataFrame([(";".join(sorted(c)), float(s)) for c, s in found.items()], "clade string, support double")


def s_log(spark, d):
    text = '[2026-01-02 03:04:05] start\n[2026-01-02 03:04:05] Parameters: {\n[2026-01-02 03:04:05]   "cutoff": 0.5, "metric": "cosine",\n[2026-01-02 03:04:05]   "more": {"k": 7}\n[2026-01-02 03:04:05] }\n[2026-01-02 03:04:06] done {'
    out = shared_path(spark, "log")
    spark.createDataFrame([(text,)], "value string").write.text(out)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in I.parameters_of_log(spark, out).items()], "name string, value string")


def s_references(spark, d):
    """References that name the whole path or only the file, against all images."""
    images = _figs(spark, d).where("image IS NOT NULL").select(F.col("image").alias("ref")).distinct()
    wanted = images.select(F.when(F.length("ref") % 2 == 0, F.col("ref")).otherwise(F.element_at(F.split("ref", "/"), -1)).alias("ref"))
    return I.resolve_references(wanted.unionByName(images.select(F.concat(F.lit("lost/"), "ref", F.lit(".x")).alias("ref"))), images)


def s_batch(spark, d):
    return I.is_batch(_figs(spark, d).where("image IS NOT NULL").select(S.sample_of_reference("image").alias("sample")))


def s_hashes(spark, d):
    return I.content_hashes(_figs(spark, d).select(F.col("image").alias("ref"), F.col("label").cast("binary").alias("content")).where("ref IS NOT NULL").distinct())


def s_candidates(spark, d):
    """A scan in which some files have two names, some lie outside the root, and labelled ones are the experts'."""
    images = _figs(spark, d).where("image IS NOT NULL").select("image").distinct()
    n = F.length("image")
    identity = F.when(n % 29 == 0, F.concat(F.lit("/elsewhere/"), "image")).when(n % 7 == 0, F.concat(F.lit("/root/same/"), F.substring("image", 1, 12))).otherwise(F.concat(F.lit("/root/"), "image"))
    entries = images.select(F.when(n % 13 == 0, F.concat(F.lit("out/"), "image")).otherwise(F.col("image")).alias("ref"), identity.alias("identity"))
    experts = I.label_table(_figs(spark, d)).select(F.col("id").alias("ref"), F.concat(F.lit("/root/"), "id").alias("identity"))
    return I.discover_candidates(entries, experts, "/root", skip=["out"])


PATHS = ["r1/UPGMA/partitions/tables/partition_0.25_assignments.csv", "r1/logs/cluster.log", "r2/UPGMA/partitions/tables/partition_0.5_assignments.csv", "r1/UPGMA/tables/partition_0.3_assignments.csv", "r1/UPGMA/partitions/tables/mine_assignments.csv"]


def x_context(spark, d):
    return I.run_context(spark.createDataFrame([(p,) for p in PATHS], "path string"))


def x_functions(spark, d):
    S.register(spark)
    read_table(spark, d, "embeddings").createOrReplaceTempView("mx_embeddings")
    return spark.sql("SELECT mx_seed_bin(vec_id) AS bin, count(*) AS n, round(sum(mx_dot(cast(embedding AS array<double>), cast(embedding AS array<double>))), 4) AS total FROM mx_embeddings GROUP BY 1")


def x_last_rows(spark, d):
    return I.last_rows(read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


def x_unique_in_order(spark, d):
    return I.unique_in_order(read_table(spark, d, "orders"), "o_custkey", "o_orderkey")


def x_first_rows(spark, d):
    return I.first_rows(read_table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), [F.desc("price"), "o_orderkey"], 10)


# ---- writers ---------------------------------------------------------------------------------------------------


def _round_trip(spark: SparkSession, df: DataFrame, form: str) -> DataFrame:
    out = shared_path(spark, form)
    K.write_table(df, out, form)
    return spark.read.schema(df.schema).format(form).load(out)


def k_json(spark, d):
    return _round_trip(spark, _figs(spark, d), "json")


def k_orc(spark, d):
    return _round_trip(spark, _figs(spark, d), "orc")


def k_wide(spark, d):
    """Vectors as one column per dimension."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(K.wide_vectors(e, 64))


def k_by_sample(spark, d):
    out = shared_path(spark, "samples")
    K.write_by_sample(_figs(spark, d), out)
    back = spark.read.schema("image string, label string, sample string, sample_dir string").option("header", True).option("escape", '"').csv(out)
    return back.groupBy("sample_dir").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("n_samples"))


def k_partitions(spark, d):
    out = shared_path(spark, "cutoffs")
    K.write_partitions(_cut_customers(spark, d), out)
    return spark.read.parquet(out).select(F.col("cutoff").cast("double").alias("cutoff"), "id", "cluster")


def k_scan(spark, d):
    return K.scan_of(_cut_customers(spark, d))


def k_metrics(spark, d):
    """Two appends, the second with a column more."""
    out = shared_path(spark, "metrics")
    K.append_metrics(spark.createDataFrame([(1, 0.5), (2, 0.25)], "epoch int, loss double"), out)
    K.append_metrics(spark.createDataFrame([(3, 0.125, 0.75)], "epoch int, loss double, recall double"), out)
    return spark.read.option("mergeSchema", True).parquet(out).select("epoch", "loss", "recall")


def k_trace(spark, d):
    out = shared_path(spark, "trace")
    for status in ("O", "F"):
        K.append_json(read_table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"), out)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(out)


# ---- functions -------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")


def f_near_duplicate(spark, d):
    p = _parts(spark, d)
    return p.select("p_partkey", S.near_duplicate(F.lit(0.99) + F.col("p_size") / 4000.0, F.substring("p_brand", 1, 7), F.substring("p_brand", 1, 7)).alias("same"), S.near_duplicate(F.lit(1.0), F.col("p_brand"), F.col("p_type")).alias("other"))


def f_luma(spark, d):
    return rounded(_parts(spark, d).select("p_partkey", S.luma(F.col("p_size") * 1.0, F.col("p_partkey") % 256, F.lit(7.0), 0.5).alias("grey")))


def f_edge_median(spark, d):
    """The border colour of a 3 x 4 image made from every part."""
    at = lambda y, x: F.array(*(((F.col("p_partkey") * (y * 4 + x + 1) + c) % 251).cast("double") for c in (0, 5, 9)))
    image = F.array(*(F.array(*(at(y, x) for x in range(4))) for y in range(3)))
    colour = S.edge_median(image)
    return _parts(spark, d).select("p_partkey", colour.alias("c")).select("p_partkey", *(F.col("c")[i].alias(n) for i, n in enumerate("rgb")))


def ds_for_ids(spark, d):
    """Distances among the embeddings that another table names."""
    ids = read_table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("id"))
    e = embedded(spark, d).select(F.col("id").cast("long").alias("id"), "v")
    return rounded(D.distances_for_ids(e, ids))


def ds_budget(spark, d):
    n = read_table(spark, d, "embeddings").count()
    return spark.createDataFrame([(n, D.check_pair_budget(n))], "n long, pairs long")


def lab_sources(spark, d):
    source = F.when(F.col("o_orderstatus") == "O", "expert").when(F.col("o_orderstatus") == "F", "pseudo").otherwise("none")
    return A.source_counts(read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), source.alias("source")))


def r_finite_mean(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_discount").cast("double").alias("x"))
    spoilt = rows.select(F.when(F.col("x") > 0.09, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"))
    one = lambda name, df: R.finite_mean(df, "x").select(F.lit(name).alias("scores"), "mean")
    return rounded(one("finite", rows).unionByName(one("spoilt", spoilt)).unionByName(one("none", rows.limit(0))))


# ---- trees on four tips ----------------------------------------------------------------------------------------

TIPS = ["a", "b", "c", "d"]
FOUR = {("a", "b"): 0.2, ("c", "d"): 0.4, ("a", "c"): 0.7, ("a", "d"): 0.8, ("b", "c"): 0.9, ("b", "d"): 0.8}


def _four(spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame([(*k, v) for k, v in FOUR.items()], "i string, j string, d double")
    return T.merge_table(pairs, TIPS)


def t_four_merges(spark, d):
    return rounded(_four(spark))


def t_four_scan(spark, d):
    return T.partition_scan(_four(spark), spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.5, 0.9)], "cutoff double"), 4)


def t_four_partitions(spark, d):
    return T.partitions(spark, T.merges_array(_four(spark)), TIPS, [0.1, 0.2, 0.5, 0.9])


def t_four_clades(spark, d):
    rows = T.clade_positions(T.merges_array(_four(spark)), TIPS)
    return rounded(spark.createDataFrame(rows, "node long, height double, y double, size long"))


def t_four_closure(spark, d):
    return spark.createDataFrame(T.node_tips(T.merges_array(_four(spark)), TIPS), "node long, tip string")


def t_four_sheared(spark, d):
    root = T.sheared(T.parse_newick(NEWICK), {"a", "c", "e"})
    return spark.createDataFrame([(T.to_newick(T.parse_newick(NEWICK)),), (T.to_newick(root),)], "newick string")


def t_fine_cutoffs(spark, d):
    """The fine grid around given optima of a coarse scan."""
    from ..operators.quality import fine_cutoffs

    return fine_cutoffs(spark.createDataFrame([("NMI", 0.3), ("AMI", 0.9), ("ARI", 0.35)], "metric string, cutoff double"))


# ---- training data ---------------------------------------------------------------------------------------------


def tr_extended(spark, d):
    return rounded(TD.extended_schedule(spark, 200, 500, 3e-4, 5e-6), 9)


def tr_warm_cosine(spark, d):
    return rounded(TD.cosine_schedule(spark, 500, 5e-4, 5e-6, 50, 5e-5), 9)


def tr_block_counts(spark, d):
    """How many patches blockwise and hybrid masks hide, over all embeddings."""
    ids = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    one = lambda s: TD.block_masks(ids, 14, 14, 0.3, s).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(F.array_distinct("masked"))).alias("least"), F.max(F.size("masked")).alias("most")).select(F.lit(s).alias("strategy"), "*")
    return one("blockwise").unionByName(one("hybrid"))


def tr_block_shapes(spark, d):
    return spark.createDataFrame([tuple(map(int, x)) for x in TD.block_shapes(14, 11)], "h int, w int")


def tr_relational(spark, d):
    """Student and teacher rows of two views made from every embedding."""
    e = embedded(spark, d).select("id", S.unit_vector("v").alias("u"))
    back = F.reverse("u")
    views = e.select("id", F.lit(0).alias("view"), F.col("u").alias("student"), back.alias("teacher")).unionByName(e.select("id", F.lit(1).alias("view"), back.alias("student"), F.col("u").alias("teacher")))
    one = lambda p: TD.relational_loss(views, 0.2, 0.1, p).select(F.lit(p).alias("pairing"), "loss")
    return rounded(one("cross").unionByName(one("same")).unionByName(one("full")))


def _centres(spark: SparkSession, d: str, back: bool = False) -> DataFrame:
    """Two centres a label: the means of its even and odd rows."""
    from ..operators.quality import group_sums

    e = embedded(spark, d).select("id", "label", (F.reverse("v") if back else F.col("v")).alias("v"))
    sums = group_sums(e.select((F.col("label") * 2 + F.col("id") % 2).alias("g"), "v"), "g")
    return sums.select(F.expr("g div 2").cast("int").alias("label"), (F.col("g") % 2).cast("long").alias("sub_centre"), F.col("total").alias("w"))


def tr_margin(spark, d):
    rows = embedded(spark, d).select("id", F.col("label").cast("int").alias("label"), "v")
    return rounded(TD.margin_logits(rows, _centres(spark, d), 16.0, 0.3))


def tr_compact(spark, d):
    return rounded(TD.compact_penalty(_centres(spark, d), 0.5, 2.0))


def tr_drift(spark, d):
    return rounded(TD.centre_drift(_centres(spark, d), _centres(spark, d, back=True)))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("s", "x", "k", "f", "ds", "lab", "r", "t", "tr") and callable(v)}

_SAMPLE_DIR = r"nullif(translate(regexp_replace(trim(sample), '\s+', '_', 'g'), '/\', '__'), '')"
_DIMS = " AND ".join(f"coalesce(isfinite(dim_{i}), false)" for i in range(64))
_CUT = "SELECT cutoff::DOUBLE AS cutoff, c_custkey::VARCHAR AS id, 'OTU_' || c_custkey % CASE WHEN cutoff < 0.4 THEN 40 ELSE 12 END AS cluster FROM customer, (VALUES (0.25), (0.5)) v(cutoff)"
_U = "e AS (SELECT vec_id AS id, label::INT AS label, list_transform(embedding::DOUBLE[], lambda y: y / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings)"
_C = _U + """, cs AS (SELECT label, id % 2 AS sub_centre, list(y ORDER BY pos) AS t FROM (SELECT label, id % 2 AS id, pos, sum(u[pos]) AS y FROM e, range(1, 65) r(pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT label, sub_centre, list_transform(t, lambda y: y / sqrt(list_dot_product(t, t))) AS w FROM cs)"""
_PIXEL = "(p_partkey * ({} * 4 + {} + 1) + {}) % 251"


def _border(c: int) -> str:
    at = [(0, x) for x in range(4)] + [(2, x) for x in range(4)] + [(y, 0) for y in range(3)] + [(y, 3) for y in range(3)]
    return "list_median([" + ", ".join(_PIXEL.format(y, x, c) for y, x in at) + "])::DOUBLE"


def _relational(pairs: str) -> str:
    return f"""WITH {_U}, v AS (SELECT id, 0 AS view, u AS s, list_reverse(u) AS t FROM e UNION ALL SELECT id, 1, list_reverse(u), u FROM e), p AS (SELECT * FROM (VALUES {pairs}) p(pairing, a, b)),
x AS (SELECT pairing, s.id, a, b, list_dot_product(s.s, t.t) / 0.2 AS q, list_dot_product(o.t, t.t) / 0.1 AS z FROM p JOIN v s ON s.view = a JOIN v o ON o.view = b AND o.id = s.id JOIN v t ON t.view = b),
m AS (SELECT pairing, id, a, b, max(q) AS mq, max(z) AS mz FROM x GROUP BY ALL), l AS (SELECT pairing, id, a, b, ln(sum(exp(q - mq))) + any_value(mq) AS lq, sum(exp(z - mz)) AS sz, any_value(mz) AS mz FROM x JOIN m USING (pairing, id, a, b) GROUP BY ALL)
SELECT pairing, round(avg(y), 6) AS loss FROM (SELECT pairing, id, a, b, -sum(exp(z - mz) / sz * (q - lq)) AS y FROM x JOIN l USING (pairing, id, a, b) GROUP BY ALL) GROUP BY 1"""


SQL = {
    "s_csv": "SELECT nullif(image, '') AS image, nullif(label, '') AS label, nullif(sample, '') AS sample FROM figs",
    "s_csv_compressed": "SELECT c_custkey, c_nationkey FROM customer",
    "s_rectangular": "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0",
    "s_ragged": "SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, 'more') AS raw FROM orders WHERE o_orderkey % 97 = 0",
    "s_invalid_embeddings": rf"SELECT id, 'blank_id' AS reason FROM specimen_vectors WHERE NOT coalesce(regexp_matches(id, '\S'), false) UNION ALL SELECT id, 'repeated_id' FROM specimen_vectors WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'invalid_dimension' FROM specimen_vectors WHERE NOT ({_DIMS})",
    "s_labels": r"SELECT DISTINCT image AS id, regexp_replace(label, '^[ \t]+|[ \t]+$', '', 'g') AS label FROM figs WHERE regexp_matches(image, '\S') AND regexp_matches(label, '\S')",
    "s_literal_ids": "SELECT CASE o_orderkey % 4 WHEN 0 THEN '00' || o_orderkey WHEN 2 THEN '+' || o_orderkey ELSE o_orderkey || '.50' END AS id FROM orders WHERE o_orderkey % 4 <> 1",
    "s_assignments": "SELECT id, cluster, sample FROM assignments",
    "s_otu_table": "SELECT u.user_id::VARCHAR AS sample, t.event_type AS cluster, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2",
    "s_partitions": _CUT,
    "s_distance_matrix": "WITH v AS (SELECT n_name AS id, [n_nationkey + 1.0, n_regionkey + 1.0, 1.0]::DOUBLE[] AS v FROM nation) SELECT a.id AS i, b.id AS j, round(greatest(0, 1 - list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS d FROM v a JOIN v b ON a.id < b.id",
    "s_newick": "SELECT * FROM (VALUES ('a;b', 90.0::DOUBLE), ('c;d', 70.0), ('c;d;e', 40.0)) v(clade, support)",
    "s_log": """SELECT * FROM (VALUES ('cutoff', '0.5'), ('metric', '"cosine"'), ('more', '{"k": 7}')) v(name, value)""",
    "s_references": """WITH i AS (SELECT DISTINCT image AS ref, string_split(image, '/')[-1] AS name FROM figs WHERE image IS NOT NULL), n AS (SELECT name, count(*) AS k, min(ref) AS one FROM i GROUP BY 1),
w AS (SELECT DISTINCT CASE WHEN length(ref) % 2 = 0 THEN ref ELSE name END AS ref FROM i UNION SELECT 'lost/' || ref || '.x' FROM i)
SELECT w.ref, CASE WHEN i.ref IS NOT NULL THEN i.ref WHEN k = 1 THEN one END AS resolved, CASE WHEN i.ref IS NOT NULL THEN 'path' WHEN k = 1 THEN 'name' WHEN k > 1 THEN 'ambiguous' ELSE 'missing' END AS how
FROM w LEFT JOIN i ON i.ref = w.ref LEFT JOIN n ON n.name = string_split(w.ref, '/')[-1]""",
    "s_batch": "SELECT coalesce(bool_or(image LIKE '%/%' AND image NOT LIKE '/%'), false) AS batch FROM figs WHERE image IS NOT NULL",
    "s_hashes": "SELECT ref, sha256(label) AS sha256 FROM (SELECT DISTINCT image AS ref, label FROM figs WHERE image IS NOT NULL)",
    "s_candidates": r"""WITH i AS (SELECT DISTINCT image FROM figs WHERE image IS NOT NULL), e AS (SELECT image AS ref, CASE WHEN length(image) % 29 = 0 THEN '/elsewhere/' || image WHEN length(image) % 7 = 0 THEN '/root/same/' || substring(image, 1, 12) ELSE '/root/' || image END AS identity FROM i WHERE length(image) % 13 <> 0),
x AS (SELECT DISTINCT '/root/' || image AS identity FROM figs WHERE regexp_matches(image, '\S') AND regexp_matches(label, '\S'))
SELECT ref, identity, CASE WHEN identity LIKE '/elsewhere/%' THEN 'escapes_image_root' WHEN ref <> min(ref) OVER (PARTITION BY identity) THEN 'duplicate_file_identity' END AS reason FROM e WHERE identity NOT IN (SELECT identity FROM x)""",
    "x_context": "SELECT * FROM (VALUES ('r1/UPGMA/partitions/tables/partition_0.25_assignments.csv', 'r1', '0.25', NULL), ('r2/UPGMA/partitions/tables/partition_0.5_assignments.csv', NULL, NULL, 'no_log'), ('r1/UPGMA/tables/partition_0.3_assignments.csv', NULL, NULL, 'layout'), ('r1/UPGMA/partitions/tables/mine_assignments.csv', NULL, NULL, 'name')) v(path, run, cutoff, reason)",
    "x_functions": "SELECT CASE WHEN vec_id < 1 THEN 'none' WHEN vec_id <= 3 THEN '3' WHEN vec_id <= 5 THEN '4-5' WHEN vec_id <= 10 THEN '6-10' ELSE '>10' END AS bin, count(*) AS n, round(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY 1",
    "x_last_rows": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "x_unique_in_order": "SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) - 1 AS position FROM orders GROUP BY 1",
    "x_first_rows": "SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 10",
    "k_json": "SELECT image, label, sample FROM figs",
    "k_orc": "SELECT image, label, sample FROM figs",
    "k_wide": "SELECT vec_id AS id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0 AS dim_{i}" for i in range(64)) + " FROM embeddings",
    "k_by_sample": f"SELECT CASE WHEN sample IS NULL THEN 'all_samples' ELSE {_SAMPLE_DIR} END AS sample_dir, count(*) AS n, count(DISTINCT sample) AS n_samples FROM figs GROUP BY 1",
    "k_partitions": _CUT,
    "k_scan": f"SELECT cutoff, count(DISTINCT cluster) AS clusters FROM ({_CUT}) GROUP BY 1",
    "k_metrics": "SELECT * FROM (VALUES (1, 0.5::DOUBLE, NULL::DOUBLE), (2, 0.25, NULL), (3, 0.125, 0.75)) v(epoch, loss, recall)",
    "k_trace": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F')",
    "f_near_duplicate": "SELECT p_partkey, 0.99::DOUBLE + p_size / 4000.0::DOUBLE > 0.999::DOUBLE AS same, p_brand = p_type AS other FROM part",
    "f_luma": "SELECT p_partkey, round((0.299::DOUBLE * p_size + 0.587::DOUBLE * (p_partkey % 256) + 0.114::DOUBLE * 7) * 0.5, 6) AS grey FROM part",
    "f_edge_median": f"SELECT p_partkey, {_border(0)} AS r, {_border(5)} AS g, {_border(9)} AS b FROM part",
    "ds_for_ids": f"WITH {_U}, k AS (SELECT * FROM e WHERE id IN (SELECT n_nationkey * 3 FROM nation)) SELECT a.id AS i, b.id AS j, round(greatest(0, least(2, 1 - list_dot_product(a.u, b.u))), 6) + 0.0 AS d FROM k a JOIN k b ON a.id < b.id",
    "ds_budget": "SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM embeddings",
    "lab_sources": "SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_expert, count(*) FILTER (o_orderstatus = 'F') AS n_pseudo FROM orders GROUP BY 1",
    "r_finite_mean": "SELECT 'finite' AS scores, round(avg(l_discount::DOUBLE), 6) AS mean FROM lineitem UNION ALL SELECT 'spoilt', CASE WHEN bool_or(l_discount::DOUBLE > 0.09) THEN NULL ELSE round(avg(l_discount::DOUBLE), 6) END FROM lineitem UNION ALL SELECT 'none', NULL",
    "t_four_merges": "SELECT * FROM (VALUES (0, 0, 1, 0.2::DOUBLE, 2), (1, 2, 3, 0.4, 2), (2, 4, 5, 0.8, 4)) v(step, a, b, height, size)",
    "t_four_scan": "SELECT * FROM (VALUES (0.1::DOUBLE, 4), (0.2, 3), (0.5, 2), (0.9, 1)) v(cutoff, clusters)",
    "t_four_partitions": "SELECT cutoff::DOUBLE AS cutoff, unnest(['a', 'b', 'c', 'd']) AS id, unnest(list_transform(k, lambda x: 'OTU_' || x)) AS cluster FROM (VALUES (0.1, [1, 2, 3, 4]), (0.2, [1, 1, 2, 3]), (0.5, [1, 1, 2, 2]), (0.9, [1, 1, 1, 1])) v(cutoff, k)",
    "t_four_clades": "SELECT * FROM (VALUES (4, 0.2::DOUBLE, 0.5::DOUBLE, 2), (5, 0.4, 2.5, 2)) v(node, height, y, size)",
    "t_four_closure": "SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'a'), (4, 'b'), (5, 'c'), (5, 'd'), (6, 'a'), (6, 'b'), (6, 'c'), (6, 'd')) v(node, tip)",
    "t_fine_cutoffs": "SELECT round(0.15 + i * 0.01, 6)::DOUBLE AS cutoff FROM range(86) r(i)",
    "tr_extended": "SELECT s AS step, round(CASE WHEN s < 200 THEN 3e-4::DOUBLE ELSE 5e-6::DOUBLE + (3e-4::DOUBLE - 5e-6::DOUBLE) / 2 * (1 + cos(pi() * (s - 200) / 300)) END, 9) AS value FROM range(500) r(s)",
    "tr_warm_cosine": "SELECT s AS step, round(CASE WHEN s < 50 THEN 5e-5::DOUBLE + s * (5e-4::DOUBLE - 5e-5::DOUBLE) / 49 ELSE 5e-6::DOUBLE + (5e-4::DOUBLE - 5e-6::DOUBLE) / 2 * (1 + cos(pi() * (s - 50) / 450)) END, 9) AS value FROM range(500) r(s)",
    "tr_block_counts": "SELECT s AS strategy, count(*) AS n, 59 AS least, 59 AS most FROM embeddings, (VALUES ('blockwise'), ('hybrid')) v(s) GROUP BY 1",
    "tr_block_shapes": "SELECT h::INT AS h, w::INT AS w FROM range(2, 15) a(h), range(2, 12) b(w) WHERE h * w <= floor(0.2::DOUBLE * 14 * 11) AND h / w BETWEEN 0.5 AND 2",
    "tr_relational": _relational("('cross', 0, 1), ('cross', 1, 0), ('same', 0, 0), ('same', 1, 1), ('full', 0, 0), ('full', 0, 1), ('full', 1, 0), ('full', 1, 1)"),
    "tr_margin": f"""WITH {_C}, x AS (SELECT e.id, e.label, c.label AS cl, sub_centre, list_dot_product(u, w) AS cs FROM e, c), k AS (SELECT id, label, cl, max(cs) AS cs, arg_max(sub_centre, cs) AS sub FROM x GROUP BY ALL),
g AS (SELECT id, label, cl, sub, CASE WHEN cl <> label THEN cs WHEN cs > cos(pi() - 0.3) THEN cs * cos(0.3) - sqrt(1 - least(1, cs * cs)) * sin(0.3) ELSE cs - sin(pi() - 0.3) * 0.3 END * 16 AS z, cs FROM k)
SELECT id, label, round(ln(sum(exp(z))) - max(z) FILTER (cl = label), 6) AS loss, max(z) FILTER (cl = label) > max(z) FILTER (cl <> label) AS hit, max(sub) FILTER (cl = label) AS local_centre, arg_max(cl, cs) AS global_label, arg_max(sub, cs) AS global_centre FROM g GROUP BY id, label""",
    "tr_compact": f"WITH {_C} SELECT avg((x > 0)::INT)::DOUBLE AS active, round(avg(x) * 2, 6) AS penalty FROM (SELECT greatest(0, 1 - list_dot_product(a.w, b.w) - 0.5) AS x FROM c a JOIN c b ON a.label = b.label AND a.sub_centre < b.sub_centre)",
    "tr_drift": f"WITH {_C} SELECT label, sub_centre, round(greatest(-1, least(1, list_dot_product(w, list_reverse(w)))), 6) AS cosine FROM c",
}
