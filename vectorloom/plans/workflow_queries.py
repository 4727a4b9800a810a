"""Queries over files, streams, configurations and fitted models, with oracles on what must come out.

Files go to a folder of their own below the cluster's shared one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vectorloom.functions import sql
from vectorloom.operators import cloud, distances, explore, graph, matching, moments, probing, reduce, regression
from vectorloom.plans import config
from vectorloom.plans.register import query, rounded
from vectorloom.plans.relational_queries import METRICS_SQL, PAIR_LONG, _weighted, metrics_table
from vectorloom.plans.vector_queries import ALL_STATS, CLUSTER_B, HASH, LONG, STATS, clusters, embeddings
from vectorloom.session import shared_folder, table
from vectorloom.sources import tables
from vectorloom.streaming import incremental


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/vectorloom-{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def _written(spark, sf_dir) -> str:
    """Embeddings as <root>/<split>/<model>: two models, the second without a test split."""
    root, base = _folder(spark), embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    for split, model, rows in (("train", "m0", "id % 5 <> 0"), ("test", "m0", "id % 5 = 0"), ("train", "m1", "id % 2 = 0")):
        tables.write_sharded(base.where(rows), f"{root}/{split}/{model}", rows_per_file=100)
    return root


# -- sources and sinks ---------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('test', ['m0']), ('train', ['m0', 'm1'])) t(split, models)")
def layout_of_files(spark, sf_dir):
    return tables.layout(spark, _written(spark, sf_dir))


@query(f"WITH {LONG} SELECT vec_id AS id, label, round(sum(x), 5) + 0.0 AS total FROM v WHERE vec_id % 5 = 0 GROUP BY ALL")
def embeddings_with_label(spark, sf_dir):
    """One model and split of files that were written in shards, with its label column."""
    found = tables.read_embeddings(spark, _written(spark, sf_dir), "m0", "test", tables.label_column(["label", "source"]))
    return rounded(found.select("id", "label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")), 5)


@query("SELECT 'train' split, 'm1' model UNION ALL SELECT 'test', 'm0'")
def models_not_uploaded(spark, sf_dir):
    remote = spark.createDataFrame([("train", ["m0"])], "split string, models array<string>")
    return tables.not_uploaded(tables.layout(spark, _written(spark, sf_dir)), remote)


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 25")
def first_rows_scan(spark, sf_dir):
    """A lazy scan cut to its first rows, a limit that is the feature."""
    return tables.first_rows(spark, f"{sf_dir}/embeddings.parquet", 25, "vec_id").select(F.col("vec_id").alias("id"), "label")


@query("SELECT * FROM (VALUES ('absent', false), ('embeddings', true), ('known', true)) t(name, ok)")
def health_of_tables(spark, sf_dir):
    known = spark.createDataFrame([(f"{sf_dir}/known.parquet", True, None)], "path string, ok boolean, error string")
    found = tables.health(spark, [f"{sf_dir}/{n}.parquet" for n in ("embeddings", "absent", "known")], known)
    return found.select(F.regexp_extract("path", r"([a-z]+)\.parquet$", 1).alias("name"), "ok")


@query("SELECT 'absent' AS name")
def failure_list(spark, sf_dir):
    """Tables that cannot be read, written as JSON lines and read back."""
    path = _folder(spark)
    tables.write_failures(tables.health(spark, [f"{sf_dir}/{n}.parquet" for n in ("embeddings", "absent")]), path)
    return spark.read.schema("path string, ok boolean, error string").json(path).select(F.regexp_extract("path", r"([a-z]+)\.parquet$", 1).alias("name"))


@query(f"WITH {METRICS_SQL} SELECT model, round(isotropy, 6) isotropy, 'vit' name_a, 'swin' name_b, dataset FROM met")
def named_pair_files(spark, sf_dir):
    """Result files whose names carry the two models and the data set."""
    root = _folder(spark)
    for name in ("cifar10", "mnist"):
        tables.write_file(metrics_table(spark, sf_dir).where(F.col("dataset") == name).select("model", "isotropy"), f"{root}/vit__swin__{name}.parquet")
    return rounded(tables.named_pairs(spark, root))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_ingest(spark, sf_dir):
    return tables.from_arrow(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").toArrow())


@query("SELECT 'train' split, 2 n_models UNION ALL SELECT 'test', 1")
def models_per_split(spark, sf_dir):
    return tables.models_per_split(tables.layout(spark, _written(spark, sf_dir)).select("split", F.explode("models").alias("model")))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer")
def row_index(spark, sf_dir):
    return graph.row_ids(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "id")


# -- functions, configurations, streams ----------------------------------------------------------


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y), 6) + 0.0 AS dot, round(sqrt(list_dot_product(x, x)), 6) AS length, round(list_distance(x, y), 6) AS distance, round(list_cosine_similarity(x, y), 6) + 0.0 AS cosine, round(2 / 4, 6) AS jaccard, 0.0::DOUBLE AS nothing FROM p""")
def sql_functions(spark, sf_dir):
    """The functions for SQL text on each vector and the next."""
    sql.register(spark)
    base = embeddings(spark, sf_dir)
    pairs = base.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).join(base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y")), "vec_id")
    found = pairs.selectExpr("vec_id", "vl_dot(x, y) dot", "vl_norm(x) length", "vl_distance(x, y) distance", "vl_cosine(x, y) cosine", "vl_jaccard(array(1L, 2L, 3L), array(2L, 3L, 4L)) jaccard", "vl_jaccard(array(), array()) nothing")
    return rounded(found)


@query(f"""WITH {ALL_STATS}, e AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) d FROM embeddings a, embeddings b),
f AS (SELECT min(d) FILTER (b.vec_id % 2 = 1) d FROM e JOIN embeddings b ON j = b.vec_id WHERE i % 2 = 0 GROUP BY i), g AS (SELECT min(d) d FROM e WHERE i % 2 = 1 AND j % 2 = 0 GROUP BY i)
SELECT 0 AS run, 'cloud' task, 'total_spread' metric, 'all' AS "table", round((SELECT sum(v) FROM s), 5) AS "value"
UNION ALL SELECT 1, 'cloud', 'participation_ratio_fast', 'all', round((SELECT sum(v) * sum(v) / sum(v * v) FROM s), 5)
UNION ALL SELECT 2, 'distance', 'chamfer', 'even', round((SELECT avg(d) FROM f) + (SELECT avg(d) FROM g), 5)
UNION ALL SELECT 3, 'distance', 'hausdorff', 'even', round(greatest((SELECT max(d) FROM f), (SELECT max(d) FROM g)), 5)""")
def config_sweep(spark, sf_dir):
    """A composed configuration, overridden and swept over metrics, as one run each."""
    base = embeddings(spark, sf_dir)
    sides = {"all": base, "even": base.where("vec_id % 2 = 0"), "odd": base.where("vec_id % 2 = 1")}
    common = config.compose({"key": "id", "vector": "embedding"}, config.override("key=vec_id"))
    runs = list(config.sweep(config.compose(common, {"task": "cloud", "table": "all"}), {"metric": ["total_spread", "participation_ratio_fast"]}))
    runs += list(config.sweep(config.compose(common, {"task": "distance", "table": "even", "other": "odd"}), {"metric": ["chamfer", "hausdorff"]}))
    return rounded(config.run(sides, runs), 5)


@query(f"WITH {STATS} SELECT label, max(n) n, round(sum(v), 5) total_spread, round(sum(v) * sum(v) / sum(v * v), 5) participation_ratio_fast, round(min(v) / max(v), 5) isotropy, round(max(n) / sum(v), 5) density FROM s GROUP BY label")
def stream_metrics(spark, sf_dir):
    """Metrics of a stream of files that arrive in two parts."""
    root, base = _folder(spark), embeddings(spark, sf_dir).select("label", "embedding")
    for part in (0, 1):
        base.where(F.col("label") % 2 == part).write.mode("append").parquet(f"{root}/in")
        incremental.stream_metrics(spark, f"{root}/in", base.schema, f"{root}/state", f"{root}/checkpoint", "label", "embedding").awaitTermination()
    return rounded(incremental.read_metrics(spark, f"{root}/state", "label"), 5)


@query(f"SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings ORDER BY {HASH} LIMIT 100")
def preprocessed(spark, sf_dir):
    """A sample of 100 rows (the operator's own), scaled to length 1: its ids and lengths."""
    found = reduce.preprocess(embeddings(spark, sf_dir).select("vec_id", "embedding"), "vec_id", "embedding", 100, "l2")
    return rounded(found.select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("length")), 5)


@query("SELECT cluster, vec_id, dataset, vec_id - lo AS local_index FROM (SELECT label AS cluster, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) <= 4) JOIN (VALUES ('first', 0, 100), ('second', 100, 100000000)) b(dataset, lo, hi) ON vec_id >= lo AND vec_id < hi")
def cluster_grid(spark, sf_dir):
    """Four sampled members of each cluster with the data set and place that their pictures come from."""
    drawn = embeddings(spark, sf_dir).select(F.col("label").alias("cluster"), "vec_id", F.md5(F.concat(F.lit("42-"), F.col("vec_id").cast("string"))).alias("draw"))
    sampled = explore.first_rows(drawn, "cluster", 4, "draw", "vec_id").drop("draw")
    return explore.range_lookup(sampled, "vec_id", [("first", 100), ("second", 99999900)])


# -- fitted models -------------------------------------------------------------------------------

_COV = f"""{LONG}, m AS (SELECT pos, avg(x) m FROM v GROUP BY pos), c AS (SELECT a.pos i, b.pos j, covar_samp(a.x, b.x) c FROM v a JOIN v b USING (vec_id) GROUP BY ALL), t AS (SELECT p.i, q.j, sum(p.c * q.c) c FROM c p JOIN c q ON p.j = q.i GROUP BY ALL)"""


@query(f"WITH {_COV} SELECT 1 AS power, round((SELECT sum(c) FROM c WHERE i = j), 5) AS total UNION ALL SELECT 2, round((SELECT sum(c) FROM t WHERE i = j), 5) UNION ALL SELECT 3, round((SELECT sum(t.c * c.c) FROM t JOIN c ON t.j = c.i AND t.i = c.j), 5) UNION ALL SELECT 4, round((SELECT sum(p.c * q.c) FROM t p JOIN t q ON p.j = q.i AND p.i = q.j), 5)")
def spectrum_power_sums(spark, sf_dir):
    """Sums of the first four powers of the covariance's eigenvalues: the traces of its powers."""
    values = cloud.spectrum(moments.moments(embeddings(spark, sf_dir), "embedding"))
    return rounded(spark.createDataFrame([(k, float((values**k).sum())) for k in (1, 2, 3, 4)], "power int, total double"), 5)


_JACCARD = f"ca AS (SELECT vec_id, label::BIGINT c FROM embeddings), cb AS (SELECT vec_id, {CLUSTER_B}::BIGINT c FROM embeddings), na AS (SELECT c, count(*) n FROM ca GROUP BY c), nb AS (SELECT c, count(*) n FROM cb GROUP BY c), j AS (SELECT ca.c a, cb.c b, count(*) / (any_value(na.n) + any_value(nb.n) - count(*)) s FROM ca JOIN cb USING (vec_id) JOIN na ON na.c = ca.c JOIN nb ON nb.c = cb.c GROUP BY ALL), la AS (SELECT c, row_number() OVER (ORDER BY c) k FROM na), lb AS (SELECT c, row_number() OVER (ORDER BY c) k FROM nb)"


@query(f"""WITH RECURSIVE {_JACCARD}, m AS (SELECT la.k a, lb.k b, coalesce(s, 0) s FROM la CROSS JOIN lb LEFT JOIN j ON j.a = la.c AND j.b = lb.c),
r(k, used, total) AS (SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE UNION ALL SELECT n.k, n.used, max(n.total) FROM (SELECT r.k + 1 AS k, r.used | (1 << (m.b - 1)::INT)::BIGINT AS used, r.total + m.s AS total FROM r JOIN m ON m.a = r.k + 1 AND (r.used & (1 << (m.b - 1)::INT)::BIGINT) = 0) n GROUP BY n.k, n.used)
SELECT round(max(total) / (SELECT count(*) FROM la), 6) AS score FROM r WHERE k = (SELECT count(*) FROM la)""")
def hungarian_score(spark, sf_dir):
    """Mean overlap under the best assignment; the oracle goes through all sets of used partners."""
    return rounded(spark.createDataFrame([(float(matching.hungarian_score(matching.jaccard_matrix(*clusters(spark, sf_dir)))),)], "score double"))


_ARMS = f"""{PAIR_LONG}, o AS (SELECT analysis_type, dataset, is_treatment t, unnest(['isotropy', 'spread']) outcome, unnest([isotropy, spread]) y FROM l), y AS (SELECT * FROM o WHERE y IS NOT NULL)"""
#: An arm of one row is fitted as a whole and adds nothing to the robust variance.
_PLAIN = "(SELECT {k}, outcome, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) beta, CASE WHEN count(*) FILTER (t = 1) > 1 THEN var_pop(y) FILTER (t = 1) * count(*) FILTER (t = 1) / (count(*) FILTER (t = 1) - 1) ** 2 ELSE 0 END + CASE WHEN count(*) FILTER (t = 0) > 1 THEN var_pop(y) FILTER (t = 0) * count(*) FILTER (t = 0) / (count(*) FILTER (t = 0) - 1) ** 2 ELSE 0 END var, corr(y, t) ** 2 r2, count(*) n_obs, count(*) - 2 df_resid, stddev_samp(y) FILTER (t = 0) control_std FROM y GROUP BY {k}, outcome)"


@query(f"WITH {_ARMS} SELECT analysis_type, outcome, round(beta, 6) + 0.0 AS beta, round(sqrt(var), 6) se, round(beta / sqrt(var), 5) + 0.0 AS stat, round(beta - 1.959963984540054 * sqrt(var), 5) + 0.0 AS ci_low, round(beta + 1.959963984540054 * sqrt(var), 5) + 0.0 AS ci_high, round(r2, 6) r2, n_obs, df_resid, round(control_std, 6) control_std FROM {_PLAIN.format(k='analysis_type')} WHERE var > 1e-12")
def ols_hc3_plain(spark, sf_dir):
    """Treatment alone: with one dummy the robust error has a closed form per arm."""
    found = regression.regress(_weighted(spark, sf_dir), ["isotropy", "spread"], factors=()).where("term = 'is_treatment' and se > 1e-6")
    out = found.select("analysis_type", "outcome", "beta", "se", F.round("stat", 5).alias("stat"), F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"), "r2", "n_obs", "df_resid", "control_std")
    return rounded(out)


@query(f"WITH {_ARMS} SELECT analysis_type, outcome, dataset, round(beta, 6) + 0.0 AS beta, round(sqrt(var), 6) se, n_obs, df_resid FROM {_PLAIN.format(k='analysis_type, dataset')} WHERE var > 1e-12")
def ols_hc3_by_dataset(spark, sf_dir):
    """The same within each data set."""
    found = regression.regress(_weighted(spark, sf_dir), ["isotropy", "spread"], "within", factors=("dataset",)).where("term = 'is_treatment' and se > 1e-6")
    return rounded(found.select("analysis_type", "outcome", "dataset", "beta", "se", "n_obs", "df_resid"))


@query(f"WITH {_ARMS}, d AS {_PLAIN.format(k='analysis_type, dataset')} SELECT b.analysis_type, b.outcome, round(b.beta - a.beta, 6) + 0.0 AS beta, round(sqrt(a.var + b.var), 6) se FROM d a JOIN d b ON a.analysis_type = b.analysis_type AND a.outcome = b.outcome AND a.dataset = 'cifar10' AND b.dataset = 'mnist' WHERE a.var + b.var > 1e-12")
def ols_hc3_saturated(spark, sf_dir):
    """Treatment by data set: the interaction is the difference of the effects, their variances add up."""
    found = regression.regress(_weighted(spark, sf_dir), ["isotropy", "spread"], "interaction", factors=("dataset",)).where("term like 'is_treatment:%' and se > 1e-6")
    return rounded(found.select("analysis_type", "outcome", "beta", "se"))


@query("SELECT label AS truth, i::INT AS pos, 0.0::DOUBLE AS gap FROM (SELECT DISTINCT label::BIGINT label FROM embeddings), (SELECT unnest(range(64)) i)")
def lstsq_probe_normal_equations(spark, sf_dir):
    """X^T (Y - X W) of the least-squares probe, which is zero for the right weights."""
    base = embeddings(spark, sf_dir)
    probe = probing.fit_probe(base, "embedding", "label")
    target = F.array(*[(F.col("label") == c).cast("double") for c in probe.classes])
    rows = base.select(F.col("embedding").cast("array<double>").alias("x"), target.alias("y"))
    gap = moments.moments(rows, "x", "y").cross - moments.moments(rows, "x").cross @ probe.weights
    cells = [(c, i, float(v)) for c, column in zip(probe.classes, gap.T) for i, v in enumerate(column)]
    return rounded(spark.createDataFrame(cells, "truth long, pos int, gap double"), 5)


@query("SELECT label::BIGINT AS truth, count(*) n, true AS better FROM embeddings GROUP BY label")
def logistic_probe(spark, sf_dir):
    """Rows per class the fitted probe saw, and whether it beats the commonest class over all rows."""
    from pyspark.ml.functions import array_to_vector

    base = embeddings(spark, sf_dir)
    model = probing.fit_logistic(base, "embedding", "label", 30)
    said = model.transform(base.select(F.col("label").cast("long").alias("truth"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    per = said.groupBy("truth").agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("truth")).cast("long")).alias("hits"))
    total = per.agg((F.sum("hits") > F.max("n")).alias("better"))
    return per.crossJoin(F.broadcast(total)).select("truth", "n", "better")


@query(f"SELECT count(*) AS n, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y FROM embeddings")
def tsne(spark, sf_dir):
    """Number and centre of the embedded points."""
    found = reduce.reduce("tsne", embeddings(spark, sf_dir), "vec_id", "embedding", 2)
    return rounded(found.agg(F.count("*").alias("n"), F.avg(F.col("components")[0]).alias("mean_x"), F.avg(F.col("components")[1]).alias("mean_y")), 5)


@query()
def prototype_analysis(spark, sf_dir):
    return reduce.reduce("prototype_analysis", embeddings(spark, sf_dir), "vec_id", "embedding", 8)


@query(f"SELECT count(*) FILTER (vec_id % 2 = 0) AS rows_a, count(*) FILTER (vec_id % 2 = 1) AS rows_b, true AS between FROM embeddings")
def sinkhorn_bounds(spark, sf_dir):
    """The transport cost of all rows lies between the mean nearest distance and the mean distance of all pairs."""
    base = embeddings(spark, sf_dir)
    a, b = base.where("vec_id % 2 = 0"), base.where("vec_id % 2 = 1")
    cost = distances.sinkhorn_cost(a, b, "vec_id", "embedding", converge=True)
    nearest, pairs = distances.distance("chamfer", a, b, "vec_id", "embedding") / 2, distances.distance("euclidean", a, b, "vec_id", "embedding")
    return spark.createDataFrame([(a.count(), b.count(), nearest - 1e-9 <= cost <= pairs + 1e-9)], "rows_a long, rows_b long, between boolean")
