"""Queries over the neighbour graph of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.operators import graph, hops, spectral
from vectorloom.plans.register import query, r, rounded
from vectorloom.plans.vector_queries import embeddings
from vectorloom.session import checkpoint

K = 5
DIST = "d AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
NEAR = f"{DIST}, n AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) k FROM d QUALIFY k <= {K})"
EDGES = f"{NEAR}, e AS (SELECT i src, j dst FROM n UNION SELECT j, i FROM n)"
DEGREE = f"{EDGES}, g AS (SELECT vec_id id, count(dst)::DOUBLE deg FROM embeddings LEFT JOIN e ON src = vec_id GROUP BY vec_id)"
#: All hop distances; the depth bound is above any diameter met.
PATHS = f"""{DEGREE}, w(s, t, h) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION SELECT s, dst, h + 1 FROM w JOIN e ON src = t WHERE h < 9),
p AS (SELECT s, t, min(h) h FROM w WHERE s <> t GROUP BY ALL)"""


def _graph(spark, sf_dir, **options):
    base = embeddings(spark, sf_dir)
    return graph.knn_edges(base, "vec_id", "embedding", K, **options), base.select(F.col("vec_id").alias("id"))


@query(f"WITH {EDGES} SELECT src, dst FROM e")
def knn_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("src", "dst")


@query(f"WITH {NEAR} SELECT a.i src, a.j dst FROM n a JOIN n b ON a.i = b.j AND a.j = b.i")
def knn_mutual_edges(spark, sf_dir):
    return _graph(spark, sf_dir, mode="mutual")[0].select("src", "dst")


@query(f"WITH {NEAR}, s AS (SELECT avg(d) s FROM n WHERE k = {K}), e AS (SELECT i src, j dst, d FROM n UNION ALL SELECT j, i, d FROM n) SELECT src, dst, round(max(exp(-d * d / (2 * s * s))), 6) w FROM e, s GROUP BY ALL")
def knn_gaussian_weights(spark, sf_dir):
    return rounded(_graph(spark, sf_dir, gaussian=True)[0])


@query(f"WITH {NEAR} SELECT i src, j dst, (k - 1)::INT AS rank, round(d, 6) d FROM n")
def knn_join(spark, sf_dir):
    from vectorloom.operators.blocks import nearest

    base = embeddings(spark, sf_dir)
    return rounded(nearest(base, base, "vec_id", "embedding", K, exclude_self=True))


@query(f"WITH {DEGREE}, h AS (SELECT floor(deg)::BIGINT degree, count(*) n FROM g GROUP BY 1) SELECT t.k AS degree, round(coalesce(n, 0) / (SELECT count(*) FROM g)::DOUBLE, 6) share FROM (SELECT unnest(range(0, (SELECT max(degree) + 1 FROM h))) k) t LEFT JOIN h ON h.degree = t.k")
def degree_distribution(spark, sf_dir):
    return rounded(graph.degree_distribution(*_graph(spark, sf_dir)))


@query(f"""WITH RECURSIVE {EDGES}, w(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT dst, m FROM w JOIN e ON src = n),
c AS (SELECT count(DISTINCT m) c FROM (SELECT n, min(m) m FROM w GROUP BY n)), m AS (SELECT count(*) // 2 m FROM e), n2 AS (SELECT count(*) n FROM embeddings)
SELECT n n_nodes, m n_edges, c connected_components, m - n + c number_of_cycles, round(2.0 * m / (n * (n - 1)), 8) density FROM c, m, n2""")
def graph_counts(spark, sf_dir):
    return rounded(graph.counts(*_graph(spark, sf_dir)), 8)


@query(f"WITH {DEGREE} SELECT sum(abs(a.deg - b.deg)) disorder FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst WHERE src < dst")
def disorder(spark, sf_dir):
    return graph.disorder(*_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {PATHS} SELECT sum(h) / 2.0::DOUBLE wiener, sum((a.deg + b.deg) * h) / 2 schultz, sum(a.deg * b.deg * h) / 2 gutman, max(h)::DOUBLE diameter FROM p JOIN g a ON a.id = s JOIN g b ON b.id = t")
def shortest_path_indices(spark, sf_dir):
    """All weights are 1, so above the dense form's size hop searches give the distances."""
    edges, nodes = _graph(spark, sf_dir)
    return (graph.path_indices if nodes.count() <= spectral.DENSE else hops.path_sums)(checkpoint(edges), nodes)


@query(f"WITH {DEGREE} SELECT src i, dst j, round(-1 / sqrt(a.deg * b.deg), 6) AS \"value\" FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst UNION ALL SELECT id, id, 1.0 FROM g WHERE deg > 0")
def laplacian_entries(spark, sf_dir):
    return rounded(graph.laplacian(*_graph(spark, sf_dir), kind="symmetric"))


@query(f"WITH {DEGREE} SELECT src i, dst j, round(-1 / a.deg, 6) AS \"value\" FROM e JOIN g a ON a.id = src UNION ALL SELECT id, id, 1.0 FROM g WHERE deg > 0")
def laplacian_random_walk(spark, sf_dir):
    return rounded(graph.laplacian(*_graph(spark, sf_dir), kind="random_walk"))


@query(f"""WITH {EDGES}, g AS (SELECT src id, count(*) deg FROM e GROUP BY src), w AS (SELECT x.src v, x.dst a, y.dst b FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst),
q AS (SELECT a, b, count(*) - 1 q FROM w GROUP BY ALL), f AS (SELECT v, q, (e.src IS NOT NULL)::INT t, ga.deg da, gb.deg db FROM w JOIN q USING (a, b) LEFT JOIN e ON e.src = w.a AND e.dst = w.b JOIN g ga ON ga.id = w.a JOIN g gb ON gb.id = w.b),
s AS (SELECT v, sum(q) s, sum(da - (q + 1 + t) + db - (q + 1 + t) + q) p FROM f GROUP BY v)
SELECT vec_id id, round(CASE WHEN p > 0 THEN s / p::DOUBLE ELSE 0 END, 6) c4 FROM embeddings LEFT JOIN s ON v = vec_id""")
def square_clustering(spark, sf_dir):
    return rounded(graph.square_clustering(*_graph(spark, sf_dir)))


@query(f"WITH RECURSIVE {EDGES}, w(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT dst, m FROM w JOIN e ON src = n) SELECT n id, min(m) component FROM w GROUP BY n")
def connected_components(spark, sf_dir):
    return graph.connected_components(*_graph(spark, sf_dir))


@query()
def graph_signature(spark, sf_dir):
    """Cycle length, girth and eigengap, with the other metrics, in one row."""
    record = graph.signature(*_graph(spark, sf_dir))
    shares = record.pop("degree_distribution")
    row = {k: (None if v is None else float(v)) for k, v in record.items()} | {"degree_distribution": [float(s) for s in shares]}
    schema = ", ".join(f"{k} double" for k in record) + ", degree_distribution array<double>"
    return spark.createDataFrame([tuple(row.values())], schema)


@query()
def eigengap(spark, sf_dir):
    values = spectral.eigenpairs(*_graph(spark, sf_dir), 6).values
    return spark.createDataFrame([(k, graph.eigengap(values, k)) for k in range(1, 6)], "k int, eigengap double")


@query()
def spectral_layout(spark, sf_dir):
    """Coordinates from the Laplacian's eigenvectors after the first."""
    vectors = spectral.eigenpairs(*_graph(spark, sf_dir), 3).vectors
    return vectors.select("id", r(F.col("v")[1]).alias("x"), r(F.col("v")[2]).alias("y"))
