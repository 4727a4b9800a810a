"""Queries over the embeddings table: geometry, normalisation, moments, distances, prototypes, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.vectors import doubles
from vectorloom.operators import alignment, cloud, distances, matching, moments, probing, prototypes
from vectorloom.plans.register import query, r, rounded
from vectorloom.session import table

#: Long form of the embeddings in DuckDB.
LONG = "v AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
STATS = f"{LONG}, s AS (SELECT label, pos, count(*) n, var_pop(x) v FROM v GROUP BY ALL)"
ALL_STATS = f"{LONG}, s AS (SELECT pos, count(*) n, var_pop(x) v FROM v GROUP BY ALL)"
#: Two paired spaces and a second clustering.
SPACES = "a AS (SELECT vec_id, embedding[1:32]::DOUBLE[32] AS e FROM embeddings), b AS (SELECT vec_id, embedding[33:64]::DOUBLE[32] AS e FROM embeddings)"
CLUSTER_B = "list_position(embedding[1:10], list_max(embedding[1:10]))"
HASH = "md5(concat('42-', vec_id))"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def space_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "label", F.slice("embedding", 1, 32).alias("e"))


def space_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "label", F.slice("embedding", 33, 32).alias("e"))


def clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) by label and by the largest of the first ten components."""
    first = F.slice("embedding", 1, 10)
    base = embeddings(spark, sf_dir)
    return base.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster")), base.select(F.col("vec_id").alias("id"), F.array_position(first, F.array_max(first)).alias("cluster"))


@query(f"""WITH {STATS}, c AS (SELECT label, pos, avg(x) m FROM v GROUP BY ALL),
d AS (SELECT v.label, v.vec_id, sqrt(sum((x - m) * (x - m))) d FROM v JOIN c USING (label, pos) GROUP BY ALL),
f AS (SELECT label, max(n) n, sum(v) t, sum(v) * sum(v) / sum(v * v) p, min(v) lo, max(v) hi FROM s GROUP BY label)
SELECT label, n, round(t, 6) total_spread, round(avg(d), 6) mean_distance_to_centroid, round(p, 6) participation_ratio_fast, round(lo / hi, 6) isotropy, round(n / t, 6) density
FROM f JOIN d USING (label) GROUP BY label, n, t, p, lo, hi""")
def cloud_report_by_label(spark, sf_dir):
    out = cloud.report(embeddings(spark, sf_dir), "vec_id", "embedding", "label")
    return rounded(out.select("label", "n", "total_spread", "mean_distance_to_centroid", "participation_ratio_fast", "isotropy", "density"))


@query(f"WITH {LONG}, c AS (SELECT label, pos, avg(x) m FROM v GROUP BY ALL), d AS (SELECT v.label, v.vec_id, sqrt(sum((x - m) * (x - m))) d FROM v JOIN c USING (label, pos) GROUP BY ALL) SELECT label, round(stddev_pop(d), 6) std_distance_to_centroid FROM d GROUP BY label")
def dist_to_centroid_std(spark, sf_dir):
    return rounded(cloud.centroid_spread(embeddings(spark, sf_dir), "vec_id", "embedding", "label").select("label", "std_distance_to_centroid"))


@query(f"WITH {ALL_STATS} SELECT pos, round(v, 8) variance FROM s")
def per_dim_variance(spark, sf_dir):
    return moments.component_stats(embeddings(spark, sf_dir), "embedding").select("pos", r("var", 8).alias("variance"))


@query(f"WITH {STATS} SELECT label, round(avg(v), 8) mean_variance, round(max(v), 8) max_variance, round(min(v), 8) min_variance, round(avg(sqrt(v)), 8) mean_std FROM s GROUP BY label")
def variance_summary(spark, sf_dir):
    return rounded(cloud.fast_metrics(embeddings(spark, sf_dir), "embedding", "label").select("label", "mean_variance", "max_variance", "min_variance", "mean_std"), 8)


@query(f"WITH {STATS}, p AS (SELECT label, v / sum(v) OVER (PARTITION BY label) p FROM s) SELECT label, round(exp(-sum(CASE WHEN p > 0 THEN p * ln(p) END)), 5) effective_rank_fast FROM p GROUP BY label")
def effective_rank_fast(spark, sf_dir):
    return rounded(cloud.fast_metrics(embeddings(spark, sf_dir), "embedding", "label").select("label", "effective_rank_fast"), 5)


@query(f"WITH {STATS} SELECT label, round(CASE WHEN min(v) > 0 THEN max(v) / min(v) ELSE 'inf'::DOUBLE END, 5) anisotropy_ratio FROM s GROUP BY label")
def anisotropy(spark, sf_dir):
    return rounded(cloud.fast_metrics(embeddings(spark, sf_dir), "embedding", "label").select("label", "anisotropy_ratio"), 5)


@query(f"WITH {LONG}, c AS (SELECT p.pos i, q.pos j, covar_samp(p.x, q.x) c FROM v p JOIN v q USING (vec_id) GROUP BY ALL) SELECT round(pow(sum(CASE WHEN i = j THEN c END), 2) / sum(c * c), 5) participation_ratio FROM c")
def participation_ratio_trace(spark, sf_dir):
    return rounded(cloud.participation_ratio(embeddings(spark, sf_dir), "embedding"), 5)


@query(f"WITH {LONG} SELECT p.pos i, q.pos j, round(covar_samp(p.x, q.x), 8) cov FROM v p JOIN v q USING (vec_id) GROUP BY ALL")
def covariance_long(spark, sf_dir):
    return rounded(moments.covariance_long(embeddings(spark, sf_dir), "embedding"), 8)


def _normalised(spark, sf_dir, method):
    out = moments.normalise(embeddings(spark, sf_dir), "embedding", method)
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", r("v", 5).alias("v"))


@query(f"WITH {LONG}, s AS (SELECT pos, avg(x) m, stddev_pop(x) d FROM v GROUP BY pos) SELECT vec_id, pos, round((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) + 0.0 AS v FROM v JOIN s USING (pos)")
def normalize_standard(spark, sf_dir):
    return _normalised(spark, sf_dir, "standard")


@query(f"WITH {LONG}, s AS (SELECT pos, min(x) m, max(x) - min(x) d FROM v GROUP BY pos) SELECT vec_id, pos, round((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) + 0.0 AS v FROM v JOIN s USING (pos)")
def normalize_minmax(spark, sf_dir):
    return _normalised(spark, sf_dir, "minmax")


@query(f"WITH {LONG}, s AS (SELECT vec_id, sqrt(sum(x * x)) d FROM v GROUP BY vec_id) SELECT vec_id, pos, round(x / CASE WHEN d = 0 THEN 1 ELSE d END, 5) + 0.0 AS v FROM v JOIN s USING (vec_id)")
def normalize_l2(spark, sf_dir):
    return _normalised(spark, sf_dir, "l2")


@query(f"WITH {SPACES}, x AS (SELECT vec_id, unnest(range(32))::INT i, unnest(e) x FROM a), y AS (SELECT vec_id, unnest(range(32))::INT j, unnest(e) y FROM b) SELECT i, j, round(coalesce(corr(x, y), 0), 6) + 0.0 AS r FROM x JOIN y USING (vec_id) GROUP BY ALL")
def cross_corr_views(spark, sf_dir):
    both = space_a(spark, sf_dir).select("vec_id", F.col("e").alias("a")).join(space_b(spark, sf_dir).select("vec_id", F.col("e").alias("b")), "vec_id")
    return rounded(moments.correlation_long(both, "a", "b"))


@query(f"WITH {SPACES} SELECT round(avg(list_distance(a.e, b.e)), 6) distance FROM a CROSS JOIN b")
def mean_pairwise_euclid(spark, sf_dir):
    return rounded(distances.euclidean(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"))


@query(f"WITH {SPACES} SELECT round(avg(1 - list_cosine_similarity(a.e, b.e)), 6) distance FROM a CROSS JOIN b")
def mean_cosine(spark, sf_dir):
    return rounded(distances.cosine(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"))


@query(f"WITH {SPACES}, x AS (SELECT row_number() OVER (ORDER BY x) k, x FROM (SELECT unnest(e) x FROM a)), y AS (SELECT row_number() OVER (ORDER BY x) k, x y FROM (SELECT unnest(e) x FROM b)) SELECT round(avg(abs(x - y)), 6) distance FROM x JOIN y USING (k)")
def wasserstein_1d(spark, sf_dir):
    return rounded(distances.wasserstein_1d(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"))


NEAREST = f"{SPACES}, d AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.e, b.e) d FROM a CROSS JOIN b), p AS (SELECT i, min(d) d FROM d GROUP BY i), q AS (SELECT j, min(d) d FROM d GROUP BY j)"


@query(f"WITH {NEAREST} SELECT round((SELECT avg(d) FROM p) + (SELECT avg(d) FROM q), 6) distance")
def chamfer(spark, sf_dir):
    return rounded(distances.chamfer(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"))


@query(f"WITH {NEAREST} SELECT round(greatest((SELECT max(d) FROM p), (SELECT max(d) FROM q)), 6) distance")
def hausdorff(spark, sf_dir):
    return rounded(distances.hausdorff(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"))


@query(f"""WITH {SPACES}, d AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.e, b.e) d FROM a CROSS JOIN b), m AS (SELECT i, d m FROM d WHERE i = j), n AS (SELECT count(*) n FROM a),
p AS (SELECT count(*) FILTER (d < m) / (any_value(n) * (any_value(n) - 1.0)) v FROM d JOIN m USING (i), n), q AS (SELECT count(*) FILTER (d.d < m.m) / (any_value(n) * (any_value(n) - 1.0)) v FROM d JOIN m ON d.j = m.i, n)
SELECT round(p.v, 6) a_to_b, round(q.v, 6) b_to_a, round((p.v + q.v) / 2, 6) score FROM p, q""")
def foscttm(spark, sf_dir):
    return rounded(distances.foscttm(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"))


@query(f"WITH {SPACES}, x AS (SELECT vec_id, unnest(range(32)) i, unnest(e) x FROM a), y AS (SELECT vec_id, unnest(range(32)) i, unnest(e) y FROM b) SELECT round(avg((x - y) * (x - y)), 8) mse FROM x JOIN y USING (vec_id, i)")
def reconstruction_mse(spark, sf_dir):
    return rounded(distances.reconstruction_mse(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e"), 8)


@query(f"SELECT vec_id FROM embeddings ORDER BY {HASH} LIMIT 100")
def seeded_sample(spark, sf_dir):
    return distances.sample(embeddings(spark, sf_dir), "vec_id", 100).select("vec_id")


# -- prototypes ----------------------------------------------------------------------------------


@query(f"WITH {LONG} SELECT label AS cluster, pos, round(avg(x), 6) + 0.0 AS x FROM v GROUP BY ALL")
def label_prototypes(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return rounded(prototypes.centroids(base, "vec_id", "embedding", base.select("vec_id", F.col("label").alias("cluster"))))


@query(f"""WITH t AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(42 + label AS VARCHAR), '-', vec_id))) k FROM embeddings),
v AS (SELECT label, unnest(range(64))::INT pos, unnest(embedding)::DOUBLE x FROM t WHERE k <= 10) SELECT label AS cluster, pos, round(avg(x), 6) + 0.0 AS x FROM v GROUP BY ALL""")
def sampled_prototypes(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return rounded(prototypes.centroids(base, "vec_id", "embedding", base.select("vec_id", F.col("label").alias("cluster")), n_samples=10))


@query("WITH v AS (SELECT label, unnest(range(32))::INT pos, unnest(embedding[33:64])::DOUBLE x FROM embeddings) SELECT label AS cluster, pos, round(avg(x), 6) + 0.0 AS x FROM v GROUP BY ALL")
def injected_prototypes(spark, sf_dir):
    a = space_a(spark, sf_dir).select("vec_id", F.col("label").alias("cluster"))
    return rounded(prototypes.centroids(space_b(spark, sf_dir), "vec_id", "e", a))


PROTO = f"{LONG}, c AS (SELECT label c, pos, avg(x) m FROM v GROUP BY ALL), d AS (SELECT vec_id, c, sqrt(sum((x - m) * (x - m))) d FROM v JOIN c USING (pos) GROUP BY ALL), n AS (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) k FROM d)"


@query(f"WITH {PROTO} SELECT vec_id, c::BIGINT AS cluster, round(d, 6) d FROM n WHERE k = 1")
def nearest_prototype(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    labels, matrix = prototypes.as_matrix(prototypes.centroids(base, "vec_id", "embedding", base.select("vec_id", F.col("label").alias("cluster"))))
    return rounded(prototypes.assign_nearest(base, "vec_id", "embedding", matrix, labels))


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = [f"{LONG}, c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, embedding FROM (SELECT * FROM embeddings ORDER BY {HASH} LIMIT {k})), p0 AS (SELECT c, unnest(range(64))::INT pos, unnest(embedding)::DOUBLE m FROM c0)"]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT vec_id, c, sum((x - m) * (x - m)) d FROM v JOIN p{i} USING (pos) GROUP BY ALL), a{i} AS (SELECT vec_id, arg_min(c, (d, c)) c FROM d{i} GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"p{i + 1} AS (SELECT c, pos, avg(x) m FROM v JOIN a{i} USING (vec_id) GROUP BY ALL)")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::BIGINT AS cluster FROM a{rounds}"


@query(_lloyd_sql(8, 3))
def lloyd_3_iterations(spark, sf_dir):
    assigned, _ = prototypes.lloyd(embeddings(spark, sf_dir), "vec_id", "embedding", 8, 3)
    return assigned.select("vec_id", "cluster")


@query(f"""WITH {LONG}, c AS (SELECT vec_id c, embedding FROM embeddings ORDER BY {HASH} LIMIT 8), p AS (SELECT c, unnest(range(64))::INT pos, unnest(embedding)::DOUBLE m FROM c),
d AS (SELECT vec_id, c, sum((x - m) * (x - m)) d FROM v JOIN p USING (pos) GROUP BY ALL) SELECT vec_id, arg_min(c, (d, c)) AS cluster FROM d GROUP BY vec_id""")
def random_anchor_cells(spark, sf_dir):
    return prototypes.random_anchors(embeddings(spark, sf_dir), "vec_id", "embedding", 8)[2].select("vec_id", "cluster")


ANCHORS = f"k AS (SELECT vec_id k, embedding ke FROM embeddings ORDER BY {HASH} LIMIT 6)"


def _anchor_rows(spark, sf_dir):
    return distances.sample(embeddings(spark, sf_dir), "vec_id", 6).select("vec_id", doubles("embedding").alias("v")).orderBy("vec_id").collect()


def _relative(spark, sf_dir, express):
    import numpy as np

    rows = _anchor_rows(spark, sf_dir)
    names = F.array(*[F.lit(x["vec_id"]).cast("long") for x in rows])
    out = express(embeddings(spark, sf_dir), "embedding", np.array([x["v"] for x in rows]))
    return out.select("vec_id", F.posexplode("relative").alias("p", "value")).select("vec_id", F.element_at(names, F.col("p") + 1).alias("anchor"), r("value").alias("value"))


@query(f"WITH {ANCHORS} SELECT vec_id, k AS anchor, round(list_dot_product(embedding::DOUBLE[], ke::DOUBLE[]) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-10) * (sqrt(list_dot_product(ke::DOUBLE[], ke::DOUBLE[])) + 1e-10)), 6) + 0.0 AS value FROM embeddings, k")
def relative_cosine(spark, sf_dir):
    return _relative(spark, sf_dir, alignment.relative_cosine)


@query(f"WITH {ANCHORS}, d AS (SELECT vec_id, k, list_distance(embedding::DOUBLE[], ke::DOUBLE[]) d FROM embeddings, k) SELECT vec_id, k AS anchor, round(d / (SELECT max(d) FROM d), 6) + 0.0 AS value FROM d")
def relative_euclid(spark, sf_dir):
    return _relative(spark, sf_dir, alignment.relative_euclidean)


# -- overlap of clusterings ----------------------------------------------------------------------

JACCARD = f"""t AS (SELECT vec_id, label::BIGINT ca, {CLUSTER_B}::BIGINT cb FROM embeddings), na AS (SELECT ca, count(*) na FROM t GROUP BY ca), nb AS (SELECT cb, count(*) nb FROM t GROUP BY cb),
o AS (SELECT ca, cb, count(*) o FROM t GROUP BY ALL), j AS (SELECT ca, cb, coalesce(o, 0) / (na + nb - coalesce(o, 0))::DOUBLE j FROM na CROSS JOIN nb LEFT JOIN o USING (ca, cb))"""


@query(f"WITH {JACCARD} SELECT ca, cb, round(j, 6) j FROM j")
def jaccard_matrix(spark, sf_dir):
    return rounded(matching.jaccard_matrix(*clusters(spark, sf_dir)))


@query(f"""WITH {JACCARD}, rr AS (SELECT ca, max(j) b, sum(j) t FROM j GROUP BY ca), cc AS (SELECT cb, max(j) b FROM j GROUP BY cb),
e AS (SELECT avg(h) e FROM (SELECT ca, -sum(j / (t + 1e-10) * ln(j / (t + 1e-10) + 1e-10)) h FROM j JOIN rr USING (ca) GROUP BY ca)),
p AS (SELECT avg(b) m, avg((b >= 0.1)::INT) p FROM rr), q AS (SELECT avg((b >= 0.1)::INT) q FROM cc)
SELECT round(m, 6) jaccard_mean, round(p, 6) good_ratio, round(p, 6) AS precision, round(q, 6) recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) f1, round(e, 6) entropy FROM p, q, e""")
def jaccard_scores(spark, sf_dir):
    return rounded(matching.scores(matching.jaccard_matrix(*clusters(spark, sf_dir)), 0.1))


@query(f"""WITH RECURSIVE {JACCARD}, e AS (SELECT ca * 2 AS p, cb * 2 + 1 AS q FROM j WHERE j > 0.08), s AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
w(n, m) AS (SELECT p, p FROM s UNION SELECT s.q, w.m FROM w JOIN s ON s.p = w.n) SELECT min(m) component, CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS side, n // 2 AS "cluster" FROM w GROUP BY n""")
def jaccard_components(spark, sf_dir):
    return matching.component_groups(matching.jaccard_matrix(*clusters(spark, sf_dir)), 0.08)


@query(f"WITH {JACCARD} SELECT ca, cb, round(j, 6) j, round(0.2 + 0.8 * j, 6) alpha, round(greatest(0.5, 8 * j), 6) width FROM j WHERE j > 0.05")
def match_edges(spark, sf_dir):
    return rounded(matching.match_edges(matching.jaccard_matrix(*clusters(spark, sf_dir)), 0.05))


@query(f"WITH {JACCARD} SELECT ca, arg_max(cb, (j, -cb)) cb, round(max(j), 6) j FROM j GROUP BY ca")
def best_partner(spark, sf_dir):
    return rounded(matching.best_partner(matching.jaccard_matrix(*clusters(spark, sf_dir))))


# -- probing -------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id, label, unnest(range(64))::INT pos, unnest(embedding)::DOUBLE x FROM embeddings), c AS (SELECT label c, pos, avg(x) m FROM v WHERE vec_id % 5 <> 0 GROUP BY ALL),
d AS (SELECT vec_id, label, c, sum((x - m) * (x - m)) d FROM v JOIN c USING (pos) WHERE vec_id % 5 = 0 GROUP BY ALL), p AS (SELECT vec_id, label t, arg_min(c, (d, c)) s FROM d GROUP BY ALL),
l AS (SELECT t l FROM p UNION SELECT s FROM p), k AS (SELECT l, count(*) FILTER (t = l) su, count(*) FILTER (s = l) sa, count(*) FILTER (t = l AND s = l) tp FROM l, p GROUP BY l),
m AS (SELECT tp, su, CASE WHEN sa > 0 THEN tp / sa::DOUBLE ELSE 0 END p, CASE WHEN su > 0 THEN tp / su::DOUBLE ELSE 0 END r FROM k)
SELECT round(sum(tp) / sum(su)::DOUBLE, 6) accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) f1 FROM m""")
def nearest_centroid_probe(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    found = probing.nearest_centroid(base.where("vec_id % 5 <> 0"), base.where("vec_id % 5 = 0"), "vec_id", "embedding", "label")
    return rounded(probing.scores(found))
