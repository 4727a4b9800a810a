"""Queries over the model registry, metric tables, regressions, and relational operators on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.operators import explore, graph, pairs, registry, regression
from vectorloom.plans.register import query, r, rounded
from vectorloom.sources import tables
from vectorloom.session import checkpoint, table

# -- the registry and its metrics, made from suppliers and their order lines -----------------------

#: The names that suppliers' models are called after: model_name, family, size, num_parameters, pretrain_dataset, pretrain_aug, pretrain_ft
REGISTRY = [
    ("vit_tiny_patch16_224.augreg_in21k", "ViT", "Tiny", 5, "ImageNet-21K", "AugReg", None), ("vit_tiny_patch16_224.augreg_in21k_ft_in1k", "ViT", "Tiny", 5, "ImageNet-21K", "AugReg", "ImageNet-1K"),
    ("vit_small_patch16_224.augreg_in1k", "ViT", "Small", 22, "ImageNet-1K", "AugReg", None), ("vit_small_patch16_224.augreg_in21k", "ViT", "Small", 22, "ImageNet-21K", "AugReg", None),
    ("vit_small_patch16_224.augreg_in21k_ft_in1k", "ViT", "Small", 22, "ImageNet-21K", "AugReg", "ImageNet-1K"), ("vit_base_patch16_224.augreg_in1k", "ViT", "Base", 86, "ImageNet-1K", "AugReg", None),
    ("vit_base_patch16_224.augreg_in21k", "ViT", "Base", None, "ImageNet-21K", "AugReg", None), ("vit_base_patch16_224.orig_in21k", "ViT", "Base", 86, "ImageNet-21K", None, None),
    ("vit_base_patch16_224.orig_in21k_ft_in1k", "ViT", "Base", 86, "ImageNet-21K", None, "ImageNet-1K"), ("vit_large_patch16_224.orig_in21k", "ViT", "Large", 303, "ImageNet-21K", None, None),
    ("vit_large_patch14_clip_224.openai", "ViT", "Large", 303, "WIT-400M", None, None), ("vit_huge_patch14_224.orig_in21k", "ViT", "Huge", 631, "ImageNet-21K", None, None),
    ("convnext_tiny.in12k", "ConvNeXt", "Tiny", 28, "ImageNet-12K", None, None), ("convnext_tiny.in12k_ft_in1k", "ConvNeXt", "Tiny", 28, "ImageNet-12K", None, "ImageNet-1K"),
    ("convnext_tiny.fb_in1k", "ConvNeXt", "Tiny", 28, "ImageNet-1K", None, None), ("convnext_tiny.fb_in22k", "ConvNeXt", "Tiny", 28, "ImageNet-22K", None, None),
    ("convnext_tiny.fb_in22k_ft_in1k", "ConvNeXt", "Tiny", 28, "ImageNet-22K", None, "ImageNet-1K"), ("convnext_small.fb_in1k", "ConvNeXt", "Small", 50, "ImageNet-1K", None, None),
    ("convnext_small.fb_in22k", "ConvNeXt", "Small", 50, "ImageNet-22K", None, None), ("convnext_base.fb_in1k", "ConvNeXt", "Base", 88, "ImageNet-1K", None, None),
    ("convnext_large.fb_in22k", "ConvNeXt", "Large", 197, "ImageNet-22K", None, None), ("swin_tiny_patch4_window7_224.ms_in1k", "Swin", "Tiny", 28, "ImageNet-1K", None, None),
    ("swin_tiny_patch4_window7_224.ms_in22k", "Swin", "Tiny", 28, "ImageNet-22K", None, None), ("swin_base_patch4_window7_224.ms_in22k", "Swin", "Base", 87, "ImageNet-22K", None, None),
    ("swin_base_patch4_window7_224.ms_in22k_ft_in1k", "Swin", "Base", 87, "ImageNet-22K", None, "ImageNet-1K"), ("deit3_small_patch16_224.fb_in1k", "DeiT", "Small", 22, "ImageNet-1K", None, None),
    ("deit3_base_patch16_224.fb_in1k", "DeiT", "Base", 86, "ImageNet-1K", None, None), ("deit3_base_patch16_224.fb_in22k_ft_in1k", "DeiT", "Base", 86, "ImageNet-22K", None, "ImageNet-1K"),
    ("tf_efficientnet_b0.in1k", "EfficientNet", "B0", 5, "ImageNet-1K", None, None), ("tf_efficientnet_b0.aa_in1k", "EfficientNet", "B0", 5, "ImageNet-1K", "AutoAugment", None),
    ("tf_efficientnet_b0.ap_in1k", "EfficientNet", "B0", 5, "ImageNet-1K", "AdvProp", None), ("tf_efficientnet_b0.ns_jft_in1k", "EfficientNet", "B0", 5, "JFT", "NoisyStudent", "ImageNet-1K"),
    ("resnet50.a1_in1k", "ResNet", None, 25, "ImageNet-1K", None, None), ("resnet50.ra_in1k", "ResNet", None, 25, "ImageNet-1K", "RandAugment", None),
    ("legacy_seresnet50.in1k", "ResNet", None, 28, "ImageNet-1K", None, None), ("mobilevit_xs.cvnets_in1k", "MobileViT", "XSmall", 2, "ImageNet-1K", None, None),
    ("mobilevit_s.cvnets_in1k", "MobileViT", "Small", 5, "ImageNet-1K", None, None), ("vit_base_patch14_dinov2.lvd142m", "ViT", "Base", 86, "LVD-142M", None, None),
    ("quux_net.in1k", "unknown", None, None, "ImageNet-1K", None, None), ("vit_small_patch16_224.dino", "ViT", "Small", 21, None, None, None),
]
COLUMNS = "model_name string, family string, size string, num_parameters long, pretrain_dataset string, pretrain_aug string, pretrain_ft string"


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value + "'"


#: Every supplier is a model: named after a row of REGISTRY by its key, with the block of keys in its variant.
REGISTRY_SQL = f"""tpl(place, model_name, family, size, num_parameters, pretrain_dataset, pretrain_aug, pretrain_ft) AS (VALUES {", ".join("(" + ", ".join(map(_literal, (k, *row))) + ")" for k, row in enumerate(REGISTRY))}),
named AS (SELECT s_suppkey, replace(model_name, '.', '_no' || (s_suppkey // {len(REGISTRY)}) || '.') model_name, family, size, num_parameters + floor(abs(s_acctbal))::BIGINT % 7 num_parameters, pretrain_dataset, pretrain_aug, pretrain_ft FROM supplier JOIN tpl ON place = s_suppkey % {len(REGISTRY)}),
reg AS (SELECT * EXCLUDE s_suppkey FROM named)"""
#: Metrics of a model on two data sets, open and filled lines: means over its supplier's order lines; two suppliers of twenty have none.
METRICS_SQL = f"""{REGISTRY_SQL}, met AS (SELECT model_name AS model, CASE l_linestatus WHEN 'O' THEN 'cifar10' ELSE 'mnist' END AS dataset, avg(l_quantity)::DOUBLE AS isotropy, CASE WHEN count(*) % 9 <> 0 THEN avg(l_linenumber)::DOUBLE END AS spread
FROM lineitem JOIN named ON s_suppkey = l_suppkey WHERE s_suppkey % 20 NOT IN (5, 17) GROUP BY ALL)"""


def _named(spark, sf_dir):
    """s_suppkey and the registry's columns of every supplier."""
    names = spark.createDataFrame([(k, *row) for k, row in enumerate(REGISTRY)], "place int, " + COLUMNS)
    own = table(spark, sf_dir, "supplier").withColumn("place", (F.col("s_suppkey") % len(REGISTRY)).cast("int"))
    both = own.join(F.broadcast(names), "place")  # one row a name
    block = F.concat(F.lit("_no"), F.expr(f"s_suppkey div {len(REGISTRY)}"), F.lit("."))
    return both.select(
        "s_suppkey", F.replace("model_name", F.lit("."), block).alias("model_name"), "family", "size", (F.col("num_parameters") + F.floor(F.abs("s_acctbal")) % 7).alias("num_parameters"),
        "pretrain_dataset", "pretrain_aug", "pretrain_ft",
    )


def registry_table(spark, sf_dir):
    return _named(spark, sf_dir).drop("s_suppkey")


def metrics_table(spark, sf_dir):
    own = _named(spark, sf_dir).where(~(F.col("s_suppkey") % 20).isin(5, 17)).select("s_suppkey", F.col("model_name").alias("model"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_linenumber", F.when(F.col("l_linestatus") == "O", "cifar10").otherwise("mnist").alias("dataset"))
    sums = lines.groupBy("l_suppkey", "dataset").agg(F.avg("l_quantity").cast("double").alias("isotropy"), F.when(F.count("*") % 9 != 0, F.avg("l_linenumber").cast("double")).alias("spread"))
    return sums.join(own, F.col("s_suppkey") == F.col("l_suppkey")).select("model", "dataset", "isotropy", "spread")


# -- name parsing --------------------------------------------------------------------------------


def _sql_ladder(rules, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(k)} THEN {_literal(v)}" for k, v in rules) + " END"


def _sql_token(text: str):
    return lambda k: f"contains('_' || {text} || '_', '_{k}_')"


def _sql_match(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, '(?:^|_){pattern}(?:_|$)', 1), '')"


_BY_LENGTH = lambda t: sorted(t.items(), key=lambda kv: -len(kv[0]))
_V, _C = "v", "cfg"
_MACRO = list(registry.MACRO_FAMILIES.items())
_PARSE = f"""WITH {REGISTRY_SQL}, p AS (SELECT model_name, lower(split_part(model_name, '.', 1)) v0, lower(substr(model_name, strpos(model_name, '.') + 1)) cfg FROM reg),
q AS (SELECT *, CASE WHEN starts_with(v0, 'legacy_') THEN substr(v0, 8) ELSE v0 END v, instr(cfg, '_ft_') ft FROM p),
f AS (SELECT *, coalesce({_sql_ladder([(p, f) for p, f, _ in registry.FAMILIES], lambda k: f"starts_with(v, '{k}')")}, 'unknown') fam, {_sql_ladder([(p, g) for p, _, g in registry.FAMILIES], lambda k: f"starts_with(v, '{k}')")} gen,
 CASE WHEN ft > 0 THEN substr(cfg, ft + 4) END aft, CASE WHEN ft > 0 THEN substr(cfg, 1, ft - 1) ELSE cfg END bef FROM q)"""


@query(f"""{_PARSE} SELECT model_name, starts_with(v0, 'legacy_') is_legacy, fam family, gen model_version, {_sql_ladder(_MACRO, lambda k: f"fam = '{k}'")} macro_family,
coalesce({_sql_ladder(registry.SIZES, _sql_token(_V))}, CASE WHEN fam = 'MobileViT' THEN CASE WHEN starts_with(v0, 'mobilevit_xxs') THEN 'XXSmall' WHEN starts_with(v0, 'mobilevit_xs') THEN 'XSmall' WHEN starts_with(v0, 'mobilevit_s') THEN 'Small' END END) size,
coalesce(TRY_CAST({_sql_match(_V, 'patch([0-9]+)')} AS BIGINT), TRY_CAST({_sql_match(_V, 'p([0-9]+)')} AS BIGINT)) patch_size, TRY_CAST({_sql_match(_V, 'window([0-9]+)(?:to[0-9]+)?')} AS BIGINT) window_size,
CASE WHEN NOT starts_with(v, 'swin') AND NOT starts_with(v, 'sam') THEN {_sql_match(_V, '(s[0-9]+)')} END stride_code, {_sql_ladder(registry.POSITIONS, _sql_token(_V))} positional_encoding, {_sql_ladder(registry.HEADS, _sql_token(_V))} head_type,
contains('_' || v || '_', '_aa_') OR regexp_matches(v, '^(?:resnetaa|darknetaa|seresnextaa)') uses_aa, regexp_matches(v, '[0-9]ts(?:_|$)') uses_ts FROM f""")
def registry_parse_variant(spark, sf_dir):
    out = registry.parse_names(registry_table(spark, sf_dir).select("model_name"))
    return out.select("model_name", "is_legacy", "family", "model_version", "macro_family", "size", "patch_size", "window_size", "stride_code", "positional_encoding", "head_type", "uses_aa", "uses_ts")


@query(f"""{_PARSE}, g AS (SELECT *, coalesce({_sql_ladder(_BY_LENGTH(registry.ORGANISATIONS), _sql_token(_C))}, (SELECT any_value(o) FROM (SELECT {_sql_ladder(_BY_LENGTH(registry.ORGANISATIONS), lambda k: f"starts_with(t, '{k}') AND length(t) > {len(k)}")} o FROM (SELECT unnest(string_split(cfg, '_')) t)) WHERE o IS NOT NULL)) org,
coalesce({_sql_ladder(_BY_LENGTH(registry.DATASETS), lambda k: f"starts_with(coalesce(aft, ''), '{k}')")}, CASE WHEN contains(cfg, 'in22k_in1k') OR contains(cfg, 'in21k_in1k') OR contains(cfg, 'in12k_in1k') OR contains(cfg, 'mae_in1k') THEN 'ImageNet-1K' END) ft0 FROM f),
h AS (SELECT *, coalesce({_sql_ladder(_BY_LENGTH(registry.DATASETS), lambda k: f"contains(bef, '{k}')")}, CASE WHEN org = 'OpenAI' THEN 'WIT-400M' WHEN regexp_matches(cfg, '^fb_r[0-9]+') THEN 'SA-1B' END) ds0 FROM g)
SELECT model_name, org pretrain_org, CASE WHEN ds0 IS NULL AND ft0 <> 'ImageNet-1K' THEN ft0 ELSE ds0 END pretrain_dataset, CASE WHEN ds0 IS NULL AND ft0 <> 'ImageNet-1K' THEN 'ImageNet-1K' ELSE ft0 END pretrain_ft,
{_sql_ladder(registry.AUGMENTATIONS, _sql_token(_C))} pretrain_aug, {_sql_ladder(registry.DATASET_SIZES, lambda k: f"contains(cfg, '{k}')")} pretrain_dataset_size, contains('_' || cfg || '_', '_i18n_') pretrain_i18n FROM h""")
def registry_parse_config(spark, sf_dir):
    out = registry.parse_names(registry_table(spark, sf_dir).select("model_name"))
    return out.select("model_name", "pretrain_org", "pretrain_dataset", "pretrain_ft", "pretrain_aug", "pretrain_dataset_size", "pretrain_i18n")


@query(f"""WITH {REGISTRY_SQL}, m(family, macro_family) AS (VALUES ('ViT', 'Vision Transformer'), ('DeiT', 'Vision Transformer'), ('Swin', 'Hierarchical Vision Transformer'), ('ConvNeXt', 'Convolutional'), ('ResNet', 'Convolutional'), ('BEiT', 'Vision Transformer'), ('EVA', 'Vision Transformer'), ('EfficientNet', 'Convolutional'), ('MobileViT', 'Hybrid CNN-Transformer'))
SELECT model_name, family, macro_family, size, CASE WHEN model_name LIKE '%.ns_jft_in1k' THEN 'ImageNet-1K' ELSE pretrain_dataset END pretrain_dataset, pretrain_aug, CASE WHEN model_name NOT LIKE '%.ns_jft_in1k' THEN pretrain_ft END pretrain_ft FROM reg LEFT JOIN m USING (family)""")
def registry_parse_expected(spark, sf_dir):
    """What the names say against the columns that were written down for them; of two data sets in a name the longer key counts."""
    return registry.parse_names(registry_table(spark, sf_dir).select("model_name")).select("model_name", "family", "macro_family", "size", "pretrain_dataset", "pretrain_aug", "pretrain_ft")


@query()
def registry_parse_all(spark, sf_dir):
    """Every parsed column; the rules that need scanning state are checked by unit tests."""
    return registry.parse_names(registry_table(spark, sf_dir).select("model_name"))


# -- pairs ---------------------------------------------------------------------------------------

_RANKS = ", ".join(f"('{n}', {k})" for n, k in pairs.DATASET_RANK.items())
_SIZES = ", ".join(f"('{f}', '{s}', {k})" for f, sizes in pairs.SIZE_RANK.items() for s, k in sizes.items())
BASE = f"{REGISTRY_SQL}, rk(ds, rk) AS (VALUES {_RANKS}), sz(fam, sz, srk) AS (VALUES {_SIZES}), b AS (SELECT reg.*, split_part(model_name, '.', 1) arch_key, rk FROM reg JOIN rk ON ds = pretrain_dataset)"
CHANGE = "SELECT 'dataset_change' analysis_type, c.model_name control_model, t.model_name treatment_model, c.arch_key FROM b c JOIN b t ON c.arch_key = t.arch_key AND c.pretrain_aug IS NOT DISTINCT FROM t.pretrain_aug AND c.rk < t.rk WHERE c.pretrain_ft IS NULL AND t.pretrain_ft IS NULL"
LARGE = "SELECT 'large_vs_finetuned' analysis_type, c.model_name control_model, t.model_name treatment_model, c.arch_key FROM b c JOIN b t ON c.arch_key = t.arch_key AND c.pretrain_dataset = t.pretrain_dataset AND c.pretrain_aug IS NOT DISTINCT FROM t.pretrain_aug WHERE c.pretrain_ft IS NULL AND t.pretrain_ft = 'ImageNet-1K'"
SMALL = "SELECT 'small_vs_finetuned' analysis_type, c.model_name control_model, t.model_name treatment_model, c.arch_key FROM b c JOIN b t ON c.arch_key = t.arch_key AND c.pretrain_aug IS NOT DISTINCT FROM t.pretrain_aug WHERE c.pretrain_ft IS NULL AND c.pretrain_dataset = 'ImageNet-1K' AND t.pretrain_ft = 'ImageNet-1K'"
AUG = "SELECT 'augmentation' analysis_type, c.model_name control_model, t.model_name treatment_model, c.arch_key FROM b c JOIN b t ON c.arch_key = t.arch_key AND c.pretrain_dataset = t.pretrain_dataset AND c.pretrain_ft IS NOT DISTINCT FROM t.pretrain_ft WHERE c.pretrain_aug IS NULL AND t.pretrain_aug IS NOT NULL"
SCALED = "s AS (SELECT b.*, row_number() OVER (PARTITION BY family, pretrain_dataset, pretrain_aug, pretrain_ft ORDER BY srk, coalesce(num_parameters, 0), model_name) k FROM b JOIN sz ON fam = family AND sz = lower(size))"
SCALE = "SELECT 'model_scale' analysis_type, c.model_name control_model, t.model_name treatment_model, lower(c.family) arch_key FROM s c JOIN s t ON c.family = t.family AND c.pretrain_dataset = t.pretrain_dataset AND c.pretrain_aug IS NOT DISTINCT FROM t.pretrain_aug AND c.pretrain_ft IS NOT DISTINCT FROM t.pretrain_ft AND c.k < t.k"
ALL_PAIRS = f"{BASE}, {SCALED}, pr AS ({CHANGE} UNION ALL {LARGE} UNION ALL {SMALL} UNION ALL {AUG} UNION ALL {SCALE})"


@query(f"WITH {BASE} {CHANGE}")
def pairs_dataset_change(spark, sf_dir):
    return pairs.dataset_change(registry_table(spark, sf_dir))


@query(f"WITH {BASE} {LARGE}")
def pairs_large_vs_finetuned(spark, sf_dir):
    return pairs.large_vs_finetuned(registry_table(spark, sf_dir))


@query(f"WITH {BASE} {SMALL}")
def pairs_small_vs_finetuned(spark, sf_dir):
    return pairs.small_vs_finetuned(registry_table(spark, sf_dir))


@query(f"WITH {BASE} {AUG}")
def pairs_augmentation(spark, sf_dir):
    return pairs.augmentation(registry_table(spark, sf_dir))


@query(f"WITH {BASE}, {SCALED} {SCALE}")
def pairs_model_scale(spark, sf_dir):
    return pairs.model_scale(registry_table(spark, sf_dir))


def _models(spark, sf_dir):
    """The registry and the metrics, written once, as every rule reads both."""
    return checkpoint(registry_table(spark, sf_dir)), checkpoint(metrics_table(spark, sf_dir))


def _long(spark, sf_dir):
    return pairs.long_of(*_models(spark, sf_dir), "isotropy", "spread")


def _weighted(spark, sf_dir):
    """The long table with its equal rows put together, for all that only adds it up."""
    return checkpoint(pairs.weighted_long(*_models(spark, sf_dir), "isotropy", "spread"))


METRIC_ROWS = METRICS_SQL.removeprefix(REGISTRY_SQL + ", ")
PAIR_LONG = f"""{ALL_PAIRS}, {METRIC_ROWS}, x AS (SELECT pr.*, reg.family arch_family, concat_ws('|', analysis_type, control_model, treatment_model) pair_id FROM pr LEFT JOIN reg ON model_name = control_model),
l AS (SELECT pair_id, analysis_type, arch_key, arch_family, c.dataset, c.model, 0 is_treatment, c.isotropy, c.spread FROM x JOIN met c ON c.model = control_model JOIN met t ON t.model = treatment_model AND t.dataset = c.dataset
UNION ALL SELECT pair_id, analysis_type, arch_key, arch_family, c.dataset, t.model, 1, t.isotropy, t.spread FROM x JOIN met c ON c.model = control_model JOIN met t ON t.model = treatment_model AND t.dataset = c.dataset)"""


@query(f"WITH {PAIR_LONG} SELECT pair_id, analysis_type, arch_key, arch_family, dataset, model, is_treatment, round(isotropy, 6) isotropy, round(spread, 6) spread FROM l")
def pair_long(spark, sf_dir):
    return rounded(_long(spark, sf_dir))


@query(f"WITH {PAIR_LONG} SELECT analysis_type, dataset, count(*) // 2 n_pairs FROM l GROUP BY ALL")
def obs_counts(spark, sf_dir):
    return pairs.observation_counts(_weighted(spark, sf_dir))


@query(f"WITH {PAIR_LONG} SELECT analysis_type, (count(*) FILTER (dataset = 'cifar10') // 2)::BIGINT cifar10, (count(*) FILTER (dataset = 'mnist') // 2)::BIGINT mnist, (count(*) FILTER (dataset = 'cifar10') // 2 + count(*) FILTER (dataset = 'mnist') // 2)::BIGINT total FROM l GROUP BY ALL")
def obs_counts_wide(spark, sf_dir):
    return pairs.counts_table(_weighted(spark, sf_dir), ["cifar10", "mnist"])


@query(f"WITH {ALL_PAIRS}, {METRIC_ROWS}, m AS (SELECT control_model model FROM pr UNION SELECT treatment_model FROM pr) SELECT model FROM m WHERE model NOT IN (SELECT model FROM met)")
def missing_models(spark, sf_dir):
    named = pairs.paired_models(registry_table(spark, sf_dir)).select(F.col("name").alias("control_model"), F.col("name").alias("treatment_model"))
    return pairs.missing_models(named, metrics_table(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL} SELECT a.model_name model_a, b.model_name model_b FROM reg a JOIN reg b ON a.model_name < b.model_name ORDER BY md5('42-' || a.model_name || '-' || b.model_name) LIMIT 50")
def sampled_model_pairs(spark, sf_dir):
    return pairs.unordered_pairs(registry_table(spark, sf_dir), "model_name", 50)


# -- regression ----------------------------------------------------------------------------------


@query(f"WITH {PAIR_LONG} SELECT analysis_type, round(regr_slope(isotropy, is_treatment::DOUBLE), 6) beta, count(*) n_obs FROM l WHERE isotropy IS NOT NULL GROUP BY analysis_type")
def simple_slopes(spark, sf_dir):
    return rounded(regression.simple_slope(_weighted(spark, sf_dir), "isotropy"))


@query(f"WITH {PAIR_LONG} SELECT analysis_type, round(stddev_samp(isotropy), 6) control_std FROM l WHERE is_treatment = 0 GROUP BY analysis_type")
def control_std(spark, sf_dir):
    return rounded(regression.control_std(_weighted(spark, sf_dir), "isotropy"))


@query(f"WITH {PAIR_LONG}, m AS (SELECT dataset, avg(isotropy) my, avg(is_treatment) mt FROM l GROUP BY dataset) SELECT dataset, round(isotropy - my, 6) + 0.0 AS y_resid, round(is_treatment - mt, 6) + 0.0 AS t_resid FROM l JOIN m USING (dataset)")
def partial_residuals(spark, sf_dir):
    models = _models(spark, sf_dir)
    long, weighted = (f(*models, "isotropy") for f in (pairs.long_of, pairs.weighted_long))
    return rounded(regression.partial_residuals(long, "isotropy", "dataset", weighted))


@query(f"WITH {PAIR_LONG}, m AS (SELECT dataset, avg(isotropy) my FROM l GROUP BY dataset), sd AS (SELECT arch_key, stddev_samp(isotropy - my) spread FROM l JOIN m USING (dataset) GROUP BY arch_key), lt AS (SELECT median(spread) + 1.5 * stddev_samp(spread) lim FROM sd WHERE spread IS NOT NULL) SELECT arch_key, round(spread, 6) spread, spread > lim outlier FROM sd, lt WHERE spread IS NOT NULL ORDER BY sd.spread DESC, arch_key LIMIT 20")
def residual_spread(spark, sf_dir):
    long = _weighted(spark, sf_dir)
    means = F.broadcast(regression.factor_means(long, "isotropy", "dataset"))
    residuals = long.join(means, "dataset").select("arch_key", "n", (F.col("isotropy") - F.col("my")).alias("y_resid"))
    return rounded(regression.residual_spread(residuals, "arch_key"))


@query(f"WITH {PAIR_LONG} SELECT arch_family, is_treatment, round(avg(isotropy), 6) mean, count(isotropy) n, round(1.96 * stddev_samp(isotropy) / sqrt(count(isotropy)), 6) half_width FROM l GROUP BY ALL")
def group_means(spark, sf_dir):
    return rounded(regression.group_means(_weighted(spark, sf_dir), "isotropy", "arch_family"))


@query()
def ols_hc3(spark, sf_dir):
    return rounded(regression.regress(_weighted(spark, sf_dir), ["isotropy", "spread"]))


@query()
def ols_hc3_within(spark, sf_dir):
    return rounded(regression.regress(_weighted(spark, sf_dir), ["isotropy", "spread"], "within"))


@query()
def ols_hc3_interaction(spark, sf_dir):
    return rounded(regression.regress(_weighted(spark, sf_dir), ["isotropy", "spread"], "interaction"))


_RESULTS = [("a", "isotropy", "is_treatment", 1.5, 0.5, 3.0, 0.004, 0.5, 2.5, 0.2, 40, 30, 2.0), ("a", "spread", "is_treatment", -0.4, 0.2, -2.0, 0.045, -0.8, 0.0, 0.1, 40, 30, 0.0), ("b", "isotropy", "is_treatment", 0.1, 0.06, 1.7, 0.09, -0.1, 0.3, 0.05, 20, 15, 0.5), ("b", "isotropy", "joint:dataset", None, None, 2.2, 0.5, None, None, 0.05, 20, 15, 0.5)]
_RESULT_SQL = "res(analysis_type, outcome, term, beta, se, stat, p, ci_low, ci_high, r2, n_obs, df_resid, control_std) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, x)) + ")" for x in _RESULTS) + ")"


@query(f"WITH {_RESULT_SQL} SELECT analysis_type, outcome, round((beta / CASE WHEN control_std = 0 THEN 1 ELSE control_std END)::DOUBLE, 6) beta, round((ci_low / CASE WHEN control_std = 0 THEN 1 ELSE control_std END)::DOUBLE, 6) ci_low, round((ci_high / CASE WHEN control_std = 0 THEN 1 ELSE control_std END)::DOUBLE, 6) ci_high, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END stars FROM res WHERE term = 'is_treatment'")
def forest_scaled(spark, sf_dir):
    return rounded(regression.forest_table(spark.createDataFrame(_RESULTS, regression.RESULT)))


# -- exploration of the registry -----------------------------------------------------------------

_FLAGGED = f"{REGISTRY_SQL}, fl AS (SELECT *, pretrain_aug IS NOT NULL has_aug, pretrain_ft IS NOT NULL has_ft, contains(model_name, 'patch') has_patch FROM reg)"


def _flagged(spark, sf_dir):
    return registry_table(spark, sf_dir).withColumns({"has_aug": F.col("pretrain_aug").isNotNull(), "has_ft": F.col("pretrain_ft").isNotNull(), "has_patch": F.col("model_name").contains("patch")})


@query(f"WITH {REGISTRY_SQL}, w AS (SELECT family, round(100 * avg((size IS NOT NULL)::INT), 1) size, round(100 * avg((num_parameters IS NOT NULL)::INT), 1) num_parameters, round(100 * avg((pretrain_aug IS NOT NULL)::INT), 1) pretrain_aug FROM reg GROUP BY family) UNPIVOT w ON size, num_parameters, pretrain_aug INTO NAME \"column\" VALUE pct")
def registry_completeness(spark, sf_dir):
    return explore.completeness(registry_table(spark, sf_dir), "family", ["size", "num_parameters", "pretrain_aug"])


@query(f"WITH {REGISTRY_SQL} SELECT 'size' AS \"column\", count(*) - count(size) AS nulls FROM reg UNION ALL SELECT 'pretrain_ft', count(*) - count(pretrain_ft) FROM reg")
def null_counts(spark, sf_dir):
    return explore.null_counts(registry_table(spark, sf_dir), ["size", "pretrain_ft"])


@query(f"WITH {_FLAGGED} SELECT 'has_aug' flag, round(100 * avg(has_aug::INT), 6) pct FROM fl UNION ALL SELECT 'has_ft', round(100 * avg(has_ft::INT), 6) FROM fl UNION ALL SELECT 'has_patch', round(100 * avg(has_patch::INT), 6) FROM fl")
def flag_rates(spark, sf_dir):
    return rounded(explore.flag_rates(_flagged(spark, sf_dir), ["has_aug", "has_ft", "has_patch"]))


@query(f"WITH {_FLAGGED}, n AS (SELECT has_aug::INT has_aug, has_ft::INT has_ft, has_patch::INT has_patch, k: row_number() OVER () FROM fl), u AS (UNPIVOT n ON has_aug, has_ft, has_patch INTO NAME f VALUE x) SELECT p.f a, q.f b, round(corr(p.x, q.x), 6) r FROM u p JOIN u q USING (k) GROUP BY ALL")
def flag_corr(spark, sf_dir):
    return rounded(explore.correlations(_flagged(spark, sf_dir), ["has_aug", "has_ft", "has_patch"]))


@query(f"WITH {REGISTRY_SQL} SELECT family, median(num_parameters)::DOUBLE median, count(*) n, count(DISTINCT pretrain_dataset) n_distinct FROM reg GROUP BY family")
def method_scale(spark, sf_dir):
    return explore.group_medians(registry_table(spark, sf_dir), "family", "num_parameters", "pretrain_dataset")


@query(f"WITH {REGISTRY_SQL} SELECT family, count(*) n FROM reg GROUP BY family ORDER BY n DESC, family LIMIT 10")
def top_families(spark, sf_dir):
    return explore.top_values(registry_table(spark, sf_dir), "family")


@query(f"WITH {REGISTRY_SQL} SELECT family, CASE WHEN count(*) FILTER (pretrain_dataset = 'ImageNet-1K') > 1 THEN count(*) FILTER (pretrain_dataset = 'ImageNet-1K') ELSE 0 END AS \"ImageNet-1K\", CASE WHEN count(*) FILTER (pretrain_dataset = 'ImageNet-22K') > 1 THEN count(*) FILTER (pretrain_dataset = 'ImageNet-22K') ELSE 0 END AS \"ImageNet-22K\" FROM reg GROUP BY family")
def dataset_pivot(spark, sf_dir):
    return explore.pivot_counts(registry_table(spark, sf_dir), "family", "pretrain_dataset", ["ImageNet-1K", "ImageNet-22K"])


@query(f"WITH {METRICS_SQL} SELECT dataset, round(avg(isotropy), 6) mean, round(stddev_samp(isotropy) / sqrt(count(isotropy)), 6) se, count(isotropy) n FROM met GROUP BY dataset")
def metric_mean_se(spark, sf_dir):
    return rounded(explore.mean_se(metrics_table(spark, sf_dir), ["dataset"], "isotropy"))


@query(f"WITH {METRICS_SQL} SELECT model, dataset, round((isotropy - (SELECT min(isotropy) FROM met)) / ((SELECT max(isotropy) - min(isotropy) FROM met) + 1e-8), 6) isotropy FROM met")
def parallel_coordinates(spark, sf_dir):
    return rounded(explore.minmax_scaled(metrics_table(spark, sf_dir).select("model", "dataset", "isotropy"), ["isotropy"]))


@query(f"WITH {METRICS_SQL} SELECT model FROM met GROUP BY model HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM met)")
def models_in_all_datasets(spark, sf_dir):
    return explore.in_all_groups(metrics_table(spark, sf_dir), "model", "dataset")


FEATURES = f"""{REGISTRY_SQL}, f AS (SELECT model_name, coalesce(num_parameters, 0)::DOUBLE f0, (pretrain_aug IS NOT NULL)::INT::DOUBLE f1, coalesce((family = 'ViT')::INT, 0)::DOUBLE f2, coalesce((family = 'ConvNeXt')::INT, 0)::DOUBLE f3 FROM reg),
z AS (SELECT model_name, [{', '.join(f'(f{i} - avg(f{i}) OVER ()) / CASE WHEN stddev_pop(f{i}) OVER () = 0 THEN 1 ELSE stddev_pop(f{i}) OVER () END' for i in range(4))}] v FROM f)"""


@query(f"WITH {FEATURES} SELECT model_name, i::INT pos, round(v[i + 1], 6) + 0.0 AS x FROM z, (SELECT unnest(range(4)) i)")
def feature_matrix(spark, sf_dir):
    base = registry_table(spark, sf_dir).withColumn("has_aug", F.col("pretrain_aug").isNotNull())
    out = explore.feature_matrix(base, "model_name", ["num_parameters"], ["has_aug"], {"family": ["ViT", "ConvNeXt"]})
    return rounded(out.select("model_name", F.posexplode("features").alias("pos", "x")))


@query(f"""WITH {METRICS_SQL}, k AS (SELECT row_number() OVER (ORDER BY model, dataset) id, * FROM met), n AS (SELECT id, [isotropy - 25.5, 7 * (coalesce(spread, 0) - 4), (id % 7)::DOUBLE - 3] v FROM k),
s AS (SELECT a.id i, b.id j, list_cosine_similarity(a.v, b.v) c, list_distance([x / sqrt(list_dot_product(a.v, a.v)) for x in a.v], [x / sqrt(list_dot_product(b.v, b.v)) for x in b.v]) d FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT i, j, c FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5), e AS (SELECT i, j, c FROM r WHERE c > 0.9 UNION ALL SELECT j, i, c FROM r WHERE c > 0.9)
SELECT i src, j dst, CASE WHEN max(c) > 0.97 THEN 'high' WHEN max(c) > 0.93 THEN 'medium' ELSE 'low' END band FROM e GROUP BY ALL""")
def similarity_graph(spark, sf_dir):
    base = graph.row_ids(metrics_table(spark, sf_dir), "model", "dataset").withColumn("id", F.col("id").cast("long") + 1)
    vectors = base.select("id", F.array(F.col("isotropy") - 25.5, 7 * (F.coalesce("spread", F.lit(0.0)) - 4), (F.col("id") % 7).cast("double") - 3).alias("features"))
    return explore.similarity_graph(vectors, "id").select("src", "dst", explore.similarity_band(F.col("sim")).alias("band"))


# -- tables --------------------------------------------------------------------------------------


@query(f"WITH {METRICS_SQL} SELECT model, dataset, round(isotropy, 6) isotropy FROM met WHERE model < 'm' UNION ALL SELECT model, dataset, round(isotropy + 100, 6) FROM met WHERE model >= 'm'")
def upsert_keep_first(spark, sf_dir):
    base = metrics_table(spark, sf_dir).select("model", "dataset", "isotropy")
    fresh = base.withColumn("isotropy", F.col("isotropy") + 100)
    return rounded(tables.keep_first(base.where("model < 'm'"), fresh, ["model", "dataset"]))


@query(f"WITH {METRICS_SQL} SELECT model, dataset FROM met WHERE NOT (dataset = 'mnist' AND model < 'm')")
def todo_outputs(spark, sf_dir):
    base = metrics_table(spark, sf_dir).select("model", "dataset")
    return tables.todo(base, base.where("dataset = 'mnist' and model < 'm'"), ["model", "dataset"])


@query(f"WITH {ALL_PAIRS} SELECT control_model AS name FROM pr UNION SELECT treatment_model FROM pr")
def candidate_models(spark, sf_dir):
    return tables.names_of(pairs.paired_models(registry_table(spark, sf_dir)), "name")


@query(f"WITH {METRICS_SQL} SELECT model, dataset, round(isotropy, 6) isotropy, round(spread, 6) spread, NULL::DOUBLE baseline FROM met UNION ALL SELECT 'baseline', 'cifar10', NULL, NULL, 0.5")
def diagonal_union(spark, sf_dir):
    extra = spark.createDataFrame([("baseline", "cifar10", 0.5)], "model string, dataset string, baseline double")
    return rounded(tables.union_by_name(metrics_table(spark, sf_dir), extra))


@query(f"WITH {METRICS_SQL} SELECT model, count(*) n FROM met WHERE regexp_matches(model, 'vit|swin') AND dataset IN ('cifar10', 'mnist') AND spread IS NOT NULL GROUP BY model")
def filtered_models(spark, sf_dir):
    base = metrics_table(spark, sf_dir).where(F.col("model").rlike("vit|swin") & F.col("dataset").isin("cifar10", "mnist")).dropna(subset=["spread"])
    return explore.group_counts(base, "model")


@query("SELECT o_orderkey, dataset, o_orderkey - lo AS local_index FROM orders JOIN (VALUES ('first', 0, 5000), ('second', 5000, 20000), ('third', 20000, 100000000)) b(dataset, lo, hi) ON o_orderkey >= lo AND o_orderkey < hi")
def boundary_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return explore.range_lookup(orders, "o_orderkey", [("first", 5000), ("second", 15000), ("third", 99980000)])


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) <= 3")
def first_per_group(spark, sf_dir):
    return explore.first_rows(table(spark, sf_dir, "part"), "p_brand", 3, "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


@query("SELECT c.p_brand, c.p_size small, t.p_size AS large, count(*) n FROM part c JOIN part t ON c.p_brand = t.p_brand AND c.p_size < t.p_size GROUP BY ALL")
def scale_pairs_on_parts(spark, sf_dir):
    """The size-pair rule at table scale: counts per group first, so pairs of rows are never listed."""
    sizes = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("k"))
    c, t = sizes.alias("c"), sizes.alias("t")
    both = c.join(t, (F.col("c.p_brand") == F.col("t.p_brand")) & (F.col("c.p_size") < F.col("t.p_size")))
    return both.select(F.col("c.p_brand").alias("p_brand"), F.col("c.p_size").alias("small"), F.col("t.p_size").alias("large"), (F.col("c.k") * F.col("t.k")).alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) mean, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) se, count(*) n FROM lineitem GROUP BY ALL")
def lineitem_mean_se(spark, sf_dir):
    return rounded(explore.mean_se(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


@query("SELECT p_brand, median(l_quantity)::DOUBLE median, count(*) n, count(DISTINCT l_suppkey) n_distinct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def brand_medians(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return explore.group_medians(joined, "p_brand", "l_quantity", "l_suppkey")


@query("SELECT vec_id, CASE WHEN CAST('0x' || substr(md5('42-' || vec_id), 1, 8) AS BIGINT) < 3435973836 THEN 'train' ELSE 'test' END AS split FROM embeddings")
def split_80_20(spark, sf_dir):
    """Rows of a data set without splits, dealt 80 to 20 by a hash of the id."""
    return tables.split_rows(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query("SELECT s_suppkey, n_name || ' → ' || s_name AS label, round(log10(s_acctbal + 1100), 6) AS log10_balance, round(log2(s_acctbal + 1100), 6) AS log2_balance FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def labels_and_logs(spark, sf_dir):
    """Label of a pair and logarithms to base 10 and 2."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    amount = F.col("s_acctbal").cast("double") + 1100
    return rounded(both.select("s_suppkey", F.concat("n_name", F.lit(" → "), "s_name").alias("label"), F.log10(amount).alias("log10_balance"), F.log2(amount).alias("log2_balance")))
