"""Queries whose result comes from driver-side linear algebra on aggregates; checked by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.operators import alignment, cloud, distances, matching, moments, probing, prototypes, reduce
from vectorloom.plans.register import query, rounded
from vectorloom.plans.vector_queries import LONG, clusters, embeddings, space_a, space_b


def _record(spark, record: dict[str, float]):
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in record.items()], "name string, value double"))


@query()
def spectral_metrics(spark, sf_dir):
    return _record(spark, cloud.spectral_metrics(moments.moments(embeddings(spark, sf_dir), "embedding")))


@query()
def pca_summary(spark, sf_dir):
    s = cloud.pca_summary(moments.moments(embeddings(spark, sf_dir), "embedding"))
    return rounded(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(s["eigenvalues"], s["explained"]))], "rank int, eigenvalue double, explained double"), 8)


@query()
def all_metrics(spark, sf_dir):
    return _record(spark, cloud.compute_metrics(embeddings(spark, sf_dir), "vec_id", "embedding"))


@query("SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS \"value\" FROM (SELECT unnest(range(64)) i) a, (SELECT unnest(range(64)) j) b")
def whiten(spark, sf_dir):
    """Covariance of the whitened vectors, which is the identity."""
    base = embeddings(spark, sf_dir)
    found = moments.moments(moments.Whitening.fit(base, "embedding").whiten(base, "embedding"), "embedding").covariance()
    return rounded(spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(found) for j, x in enumerate(row)], "i int, j int, value double"), 3)


@query(f"WITH {LONG} SELECT vec_id, pos, round(x, 5) + 0.0 AS x FROM v")
def dewhiten(spark, sf_dir):
    """Whitened vectors taken back, component by component."""
    base = embeddings(spark, sf_dir)
    w = moments.Whitening.fit(base, "embedding")
    return rounded(w.dewhiten(w.whiten(base, "embedding"), "embedding").select("vec_id", F.posexplode("embedding").alias("pos", "x")), 5)


@query()
def analysis_operator(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    p = prototypes.compute_prototypes(base, "vec_id", "embedding", method="lloyd", k=8, iterations=3)
    return p.represent(base, "embedding").select("vec_id", "relative")


@query()
def synthesis_operator(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    p = prototypes.compute_prototypes(base, "vec_id", "embedding", method="lloyd", k=8, iterations=3)
    return p.frame.synthesise(p.represent(base, "embedding"), "relative", "rebuilt").select("vec_id", "rebuilt")


@query()
def prewhitened_prototypes(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return prototypes.compute_prototypes(base, "vec_id", "embedding", prewhiten=True, method="lloyd", k=8, iterations=3).represent(base, "embedding").select("vec_id", "relative")


@query()
def procrustes(spark, sf_dir):
    return _record(spark, {"procrustes": distances.procrustes(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e")})


@query()
def mahalanobis(spark, sf_dir):
    return _record(spark, {"mahalanobis": distances.mahalanobis(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e")})


@query()
def sinkhorn(spark, sf_dir):
    a, b = space_a(spark, sf_dir), space_b(spark, sf_dir)
    return _record(spark, {"one_scaling": distances.sinkhorn_cost(a, b, "vec_id", "e"), "converged": distances.sinkhorn_cost(a, b, "vec_id", "e", converge=True)})


@query()
def hungarian(spark, sf_dir):
    m = matching.jaccard_matrix(*clusters(spark, sf_dir))
    return rounded(spark.createDataFrame([(str(a), str(b), s) for a, b, s in matching.match(m, "hungarian")], "a string, b string, score double"))


@query()
def spectral_matching(spark, sf_dir):
    m = matching.jaccard_matrix(*clusters(spark, sf_dir))
    return rounded(spark.createDataFrame([(str(a), str(b), s) for a, b, s in matching.match(m, "spectral")], "a string, b string, score double"))


@query()
def modularity_matching(spark, sf_dir):
    m = matching.jaccard_matrix(*clusters(spark, sf_dir))
    return rounded(spark.createDataFrame([(str(a), str(b), s) for a, b, s in matching.match(m, "modularity")], "a string, b string, score double"))


@query()
def component_matching(spark, sf_dir):
    m = matching.jaccard_matrix(*clusters(spark, sf_dir))
    return rounded(spark.createDataFrame([(str(a), str(b), s) for a, b, s in matching.match(m, "components", threshold=0.08)], "a string, b string, score double"))


@query()
def cca_transmit(spark, sf_dir):
    a, b = space_a(spark, sf_dir), space_b(spark, sf_dir)
    return alignment.CCA.fit(a, b, "vec_id", "e", "e", 8).transmit().apply(a, "e").select("vec_id", "e")


@query()
def linear_transmit(spark, sf_dir):
    a, b = space_a(spark, sf_dir), space_b(spark, sf_dir)
    return alignment.LinearFit.fit(a, b, "vec_id", "e", "e").transmit(8).apply(a, "e").select("vec_id", "e")


@query()
def proto_transmit(spark, sf_dir):
    a, b = space_a(spark, sf_dir), space_b(spark, sf_dir)
    p = prototypes.compute_prototypes(a, "vec_id", "e", prewhiten=True, method="lloyd", k=8, iterations=3)
    return alignment.prototype_transmit(p, alignment.injected(b, "vec_id", "e", p)).apply(a, "e").select("vec_id", "e")


@query()
def functional_map(spark, sf_dir):
    found = alignment.functional_map(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e", n_eigen=6)
    return rounded(spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(found) for j, v in enumerate(row)], "i int, j int, value double"), 4)


@query()
def ot_align(spark, sf_dir):
    return alignment.transported(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e")


@query()
def align_relative(spark, sf_dir):
    left, _ = alignment.align("relative", space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e", n_anchors=6)
    return left.select("vec_id", "relative")


@query()
def align_cca(spark, sf_dir):
    left, _ = alignment.align("cca", space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e", k=6)
    return left.select("vec_id", "relative")


@query()
def alignment_sweep(spark, sf_dir):
    rows = alignment.sweep(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e", "label", [4, 8], F.col("vec_id") % 5 == 0)
    return rounded(spark.createDataFrame([(x["method"], x["k"], float(x["accuracy"]), float(x["mse"])) for x in rows], "method string, k int, accuracy double, mse double"))


@query()
def prototype_k_sweep(spark, sf_dir):
    rows = matching.k_sweep(space_a(spark, sf_dir), space_b(spark, sf_dir), "vec_id", "e", "e", [2, 4])
    names = list(rows[0])
    return rounded(spark.createDataFrame([tuple(float(x[n]) for n in names) for x in rows], ", ".join(f"{n} double" for n in names)))


@query()
def lstsq_probe(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    probe = probing.fit_probe(base.where("vec_id % 5 <> 0"), "embedding", "label")
    return rounded(probing.scores(probe.predict(base.where("vec_id % 5 = 0"), "vec_id", "embedding", "label")))


@query(f"WITH {LONG}, m AS (SELECT pos, avg(x) m FROM v GROUP BY pos) SELECT vec_id, round(sum((x - m) * (x - m)), 5) squared_norm FROM v JOIN m USING (pos) GROUP BY vec_id")
def pca(spark, sf_dir):
    """Squared length of each row's scores on all axes: that of the centred vector, as the axes are orthonormal."""
    found = reduce.reduce("pca", embeddings(spark, sf_dir), "vec_id", "embedding", 64)
    vector = next(c for c, t in found.dtypes if t.startswith("array"))
    squared = F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select("vec_id", squared.alias("squared_norm")), 5)


@query()
def eigen_laplacian(spark, sf_dir):
    return reduce.reduce("eigen_laplacian", embeddings(spark, sf_dir), "vec_id", "embedding", 2)


@query()
def isomap(spark, sf_dir):
    return reduce.reduce("isomap", embeddings(spark, sf_dir), "vec_id", "embedding", 2)


@query()
def lle(spark, sf_dir):
    return reduce.reduce("lle", embeddings(spark, sf_dir), "vec_id", "embedding", 2)


@query()
def dbscan(spark, sf_dir):
    return prototypes.cluster(embeddings(spark, sf_dir), "vec_id", "embedding", method="dbscan", eps=0.9, min_samples=4)


@query()
def agglomerative(spark, sf_dir):
    return prototypes.cluster(embeddings(spark, sf_dir), "vec_id", "embedding", method="agglomerative", k=8)


@query()
def spectral_clustering(spark, sf_dir):
    return prototypes.cluster(embeddings(spark, sf_dir), "vec_id", "embedding", method="spectral", n_clusters=6)


@query()
def kmeans(spark, sf_dir):
    return prototypes.cluster(embeddings(spark, sf_dir), "vec_id", "embedding", method="kmeans", k=8)
