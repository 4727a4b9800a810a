"""Matched pairs of models and their metrics in long form.

The registry has the columns model_name, family, size, num_parameters, pretrain_dataset, pretrain_aug,
pretrain_ft. A null in a matching column is a value of its own, so those joins are null-safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.session import checkpoint

#: The pretraining datasets considered, from easiest to hardest; the easier of two is the control.
DATASET_ORDER = ("ImageNet-1K", "ImageNet-12K", "ImageNet-21K", "ImageNet-Winter-21K", "ImageNet-22K")
DATASET_RANK = {name: k for k, name in enumerate(DATASET_ORDER)}
#: The order of size labels by family.
SIZE_RANK = {
    "ViT": {"tiny": 0, "small": 1, "base": 2, "medium": 3, "large": 4, "huge": 5, "gigantic": 6, "enormous": 7},
    "ConvNeXt": {"tiny": 4, "small": 5, "base": 6, "large": 7, "xlarge": 8, "huge": 9},
    "Swin": {"tiny": 0, "small": 1, "base": 2, "large": 3},
    "DeiT": {"tiny": 0, "small": 1, "base": 2, "medium": 3, "large": 4, "huge": 5},
    "MaxViT": {"tiny": 0, "small": 1, "base": 2, "large": 3, "xlarge": 4},
    "MobileNet": {"small": 3, "medium": 4, "large": 5},
    "MobileViT": {"xxsmall": 0, "xsmall": 1, "small": 2, "medium": 3, "large": 4, "xlarge": 5},
}

PAIR = ("analysis_type", "control_model", "treatment_model", "arch_key")
RULES = ("dataset_change", "large_vs_finetuned", "small_vs_finetuned", "augmentation", "model_scale")


def with_arch_key(registry: DataFrame) -> DataFrame:
    """Models pretrained on a known dataset, with arch_key: the model's name up to the first dot."""
    return registry.where(F.col("pretrain_dataset").isin(*DATASET_ORDER)).withColumn("arch_key", F.split_part(F.col("model_name"), F.lit("."), F.lit(1)))


def ranked(column: Column, ranks: dict[str, int]) -> Column:
    """Lookup in a literal table, null where absent."""
    return F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[column]


#: Rows of a group's treatments that meet its controls in one key of the join, pairs that a partition is asked for.
BLOCK, PAIRS_A_TASK = 512, 4_000_000


def _side(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """(grp, place, model_name, arch_key): a rule pairs rows of equal grp of which the control has the lower place. A null key is a value."""
    return rows.where("arch_key is not null").select(F.to_json(F.struct(*keys)).alias("grp"), place.cast("int").alias("place"), "model_name", "arch_key")


def _dataset_change(registry: DataFrame, ranks: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    base = with_arch_key(registry).where(F.col("pretrain_ft").isNull())
    base = base.withColumn("rank", ranked(F.col("pretrain_dataset"), ranks or DATASET_RANK)).where("rank is not null")
    side = _side(base, ["arch_key", "pretrain_aug"], F.col("rank"))
    return side, side


def _large_vs_finetuned(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    base, keys = with_arch_key(registry), ["arch_key", "pretrain_dataset", "pretrain_aug"]
    return _side(base.where("pretrain_ft is null"), keys, F.lit(0)), _side(base.where("pretrain_ft = 'ImageNet-1K'"), keys, F.lit(1))


def _small_vs_finetuned(registry: DataFrame, small: str = "ImageNet-1K") -> tuple[DataFrame, DataFrame]:
    base, keys = with_arch_key(registry), ["arch_key", "pretrain_aug"]
    control = base.where((F.col("pretrain_dataset") == small) & F.col("pretrain_ft").isNull())
    return _side(control, keys, F.lit(0)), _side(base.where(F.col("pretrain_ft") == small), keys, F.lit(1))


def _augmentation(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    base, keys = with_arch_key(registry), ["arch_key", "pretrain_dataset", "pretrain_ft"]
    return _side(base.where("pretrain_aug is null"), keys, F.lit(0)), _side(base.where("pretrain_aug is not null"), keys, F.lit(1))


def _model_scale(registry: DataFrame, ranks: dict[str, dict[str, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    flat = {f"{family}|{size}": rank for family, sizes in (ranks or SIZE_RANK).items() for size, rank in sizes.items()}
    base = with_arch_key(registry).withColumn("rank", ranked(F.concat_ws("|", "family", F.lower("size")), flat))
    base = base.where("rank is not null").withColumn("arch_key", F.lower("family"))
    group = ["family", "pretrain_dataset", "pretrain_aug", "pretrain_ft"]
    order = Window.partitionBy(*group).orderBy("rank", F.coalesce("num_parameters", F.lit(0)), "model_name")
    side = _side(base.withColumn("place", F.row_number().over(order)), group, F.col("place"))
    return side, side


def _joined(kind: str, sides: tuple[DataFrame, DataFrame], columns: Callable, more: list[str] | None = None) -> DataFrame:
    """columns(control, treatment) of every pair of a rule; pairs agree in the columns ``more``, too.

    Only model_scale has groups that grow with the registry. A group's treatments are dealt into blocks of BLOCK places and
    its controls copied to the blocks above them, so a key of the join has at most BLOCK treatments, and there are
    as many partitions as pairs ask for: no task is left with a whole group.
    """
    c, t = sides
    cell = lambda block: F.to_json(F.struct(block.alias("block"), *(more or []), "grp"))
    if kind == "model_scale":
        # the largest number of treatments that a pair of sides can have: places go from 1 to the group's size
        tops = t.groupBy("grp").agg(F.max("place").alias("top"))
        size = tops.agg(F.sum(F.col("top").cast("double") * (F.col("top") - 1) / 2)).first()[0] or 0.0
        c = c.join(tops, "grp").withColumn("block", F.explode(F.sequence(F.expr(f"place div {BLOCK}"), F.expr(f"top div {BLOCK}")))).drop("top")
        t = t.withColumn("block", F.expr(f"place div {BLOCK}"))
        tasks = int(max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, size // PAIRS_A_TASK)))
        c, t = (side.withColumn("cell", cell(F.col("block"))).repartition(tasks, "cell") for side in (c, t))
    else:
        c, t = (side.withColumn("cell", cell(F.lit(0))) for side in (c, t))
    both = c.alias("c").join(t.alias("t").hint("merge"), (F.col("c.cell") == F.col("t.cell")) & (F.col("c.place") < F.col("t.place")))
    return both.select(F.lit(kind).alias("analysis_type"), *columns("c", "t"))


def _pairs(kind: str, sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    names = lambda c, t: [F.col(f"{c}.model_name").alias("control_model"), F.col(f"{t}.model_name").alias("treatment_model"), F.col(f"{c}.arch_key").alias("arch_key")]
    return _joined(kind, sides, names)


def dataset_change(registry: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Same architecture and augmentation, no fine-tuning, different pretraining datasets; control is the easier."""
    return _pairs("dataset_change", _dataset_change(registry, ranks))


def large_vs_finetuned(registry: DataFrame) -> DataFrame:
    """Fine-tuned to ImageNet-1K against not, same architecture, pretraining dataset and augmentation."""
    return _pairs("large_vs_finetuned", _large_vs_finetuned(registry))


def small_vs_finetuned(registry: DataFrame, small: str = "ImageNet-1K") -> DataFrame:
    """Fine-tuned to the small dataset against trained on it alone, same architecture and augmentation."""
    return _pairs("small_vs_finetuned", _small_vs_finetuned(registry, small))


def augmentation(registry: DataFrame) -> DataFrame:
    """With an augmentation recipe against without, same architecture, dataset and fine-tuning."""
    return _pairs("augmentation", _augmentation(registry))


def model_scale(registry: DataFrame, ranks: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """All ordered pairs within family, dataset, augmentation and fine-tuning, by size rank, then parameters (null as 0), then name."""
    return _pairs("model_scale", _model_scale(registry, ranks))


def _sides(registry: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {
        "dataset_change": _dataset_change(registry), "large_vs_finetuned": _large_vs_finetuned(registry), "small_vs_finetuned": _small_vs_finetuned(registry),
        "augmentation": _augmentation(registry), "model_scale": _model_scale(registry),
    }


def all_pairs(registry: DataFrame) -> DataFrame:
    """The five rules put together."""
    rules = (dataset_change, large_vs_finetuned, small_vs_finetuned, augmentation, model_scale)
    out = None
    for rule in rules:
        rows = rule(registry)
        out = rows if out is None else out.unionByName(rows)
    return out


def attach_family(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """The control model's family as arch_family, null if unknown."""
    family = registry.select(F.col("model_name").alias("control_model"), F.col("family").alias("arch_family"))
    return pairs.join(family, "control_model", "left")


def attach_metrics(metrics: DataFrame, probing: DataFrame, *columns: str) -> DataFrame:
    """Probing columns joined to metric rows by model; one probing row per model is used."""
    one = probing.groupBy("model").agg(*[F.min_by(c, "probing_case").alias(c) for c in columns])
    return metrics.join(one, "model", "left")


def pair_long(pairs: DataFrame, metrics: DataFrame, *columns: str) -> DataFrame:
    """Two rows per pair and dataset (is_treatment 0 and 1) with the metrics; pairs missing a side are left out."""
    keyed = pairs.withColumn("pair_id", F.concat_ws("|", "analysis_type", "control_model", "treatment_model"))
    c, t = metrics.alias("c"), metrics.alias("t")
    both = keyed.join(c, keyed.control_model == F.col("c.model")).join(t, (keyed.treatment_model == F.col("t.model")) & (F.col("c.dataset") == F.col("t.dataset")))
    extra = [k for k in pairs.columns if k not in PAIR]
    side = lambda a, flag: both.select("pair_id", "analysis_type", "arch_key", *extra, F.col("c.dataset").alias("dataset"), F.col(f"{a}.model").alias("model"), F.lit(flag).alias("is_treatment"), *[F.col(f"{a}.{m}").alias(m) for m in columns])
    return side("c", 0).unionByName(side("t", 1))


def _with_metrics(side: DataFrame, registry: DataFrame, metrics: DataFrame, columns: tuple[str, ...], family: bool) -> DataFrame:
    """A side's rows once per dataset that its model has metrics in, controls with the family that ``attach_family`` gives."""
    rows = side.join(metrics.where("dataset is not null").select(F.col("model").alias("model_name"), "dataset", *columns), "model_name")
    if family:
        rows = rows.join(registry.select("model_name", F.col("family").alias("arch_family")), "model_name", "left")
    return rows


def long_of(registry: DataFrame, metrics: DataFrame, *columns: str) -> DataFrame:
    """What ``pair_long`` makes of ``all_pairs`` with families, without a shuffle of the pairs: models get their metrics before they meet."""
    out = None
    for kind, (c, t) in _sides(registry).items():
        sides = _with_metrics(c, registry, metrics, columns, True), _with_metrics(t, registry, metrics, columns, False)

        def rows(c: str, t: str, kind: str = kind) -> list[Column]:
            arm = lambda a, flag: F.struct(F.col(f"{a}.model_name").alias("model"), F.lit(flag).alias("is_treatment"), *[F.col(f"{a}.{m}").alias(m) for m in columns])
            pair_id = F.concat_ws("|", F.lit(kind), F.col(f"{c}.model_name"), F.col(f"{t}.model_name")).alias("pair_id")
            return [pair_id, F.col(f"{c}.arch_key").alias("arch_key"), F.col(f"{c}.arch_family").alias("arch_family"), F.col(f"{c}.dataset").alias("dataset"), F.explode(F.array(arm(c, 0), arm(t, 1))).alias("arm")]

        found = _joined(kind, sides, rows, ["dataset"])
        out = found if out is None else out.unionByName(found)
    return out.select("pair_id", "analysis_type", "arch_key", "arch_family", "dataset", "arm.model", "arm.is_treatment", *[F.col(f"arm.{m}").alias(m) for m in columns])


def weighted_long(registry: DataFrame, metrics: DataFrame, *columns: str) -> DataFrame:
    """The long table with equal rows put together: ``n`` is how often a model stands in an arm.

    (analysis_type, arch_key, arch_family, dataset, model, is_treatment, n, columns). A model's partners are counted by
    running counts over its group's places, never listed, so the table grows with the models, not with their pairs.
    """
    out = None
    for kind, (c, t) in _sides(registry).items():
        c, t = _with_metrics(c, registry, metrics, columns, True), _with_metrics(t, registry, metrics, columns, False)
        out_of = lambda rows, arm: rows.where("n > 0").select(F.lit(kind).alias("analysis_type"), "arch_key", "arch_family", "dataset", F.col("model_name").alias("model"), F.lit(arm).alias("is_treatment"), "n", *columns)
        families = c.select("grp", "dataset", "arch_family").distinct()
        t_of = t.join(families, ["grp", "dataset"])  # a treatment once per family of the controls in its group
        plain = t.withColumn("arch_family", F.lit(None).cast("string")).withColumn("arm", F.lit(1))
        above = Window.partitionBy("grp", "dataset").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, -1)
        below = Window.partitionBy("grp", "dataset", "arch_family").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
        count = lambda arm, window: F.coalesce(F.sum((F.col("arm") == arm).cast("long")).over(window), F.lit(0))
        controls = c.withColumn("arm", F.lit(0)).unionByName(plain).withColumn("n", count(1, above)).where("arm = 0")
        treated = c.withColumn("arm", F.lit(0)).unionByName(t_of.withColumn("arm", F.lit(1))).withColumn("n", count(0, below)).where("arm = 1")
        found = out_of(controls, 0).unionByName(out_of(treated, 1))
        out = found if out is None else out.unionByName(found)
    return out


def paired_models(registry: DataFrame) -> DataFrame:
    """(name): the distinct models of ``all_pairs``, from each group's least and largest places instead of its pairs."""
    out = None
    for c, t in _sides(registry).values():
        ends = c.groupBy("grp").agg(F.min("place").alias("least")).join(t.groupBy("grp").agg(F.max("place").alias("most")), "grp")
        found = c.join(ends, "grp").where("place < most").select(F.col("model_name").alias("name")).unionByName(t.join(ends, "grp").where("place > least").select(F.col("model_name").alias("name")))
        out = found if out is None else out.unionByName(found)
    return out.where("name is not null").distinct()


def missing_models(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Models of the pairs that have no metric row."""
    models = pairs.select(F.col("control_model").alias("model")).union(pairs.select("treatment_model")).where("model is not null").distinct()
    return models.join(metrics.select("model").distinct(), "model", "left_anti")


def unordered_pairs(models: DataFrame, column: str = "model", limit: int | None = None, seed: int = 42) -> DataFrame:
    """(model_a, model_b), a < b; with a limit those of smallest md5 of seed and both names.

    All pairs are gone through by definition. Names are dealt to as many tasks as their pairs ask for, as Spark would put the few
    bytes of them into one; each task gets all names, whose number the pairs bound.
    """
    names = checkpoint(models.select(F.col(column).alias("model_a")).distinct())
    n = names.count()
    tasks = max(1, min(20_000, n * n // (2 * PAIRS_A_TASK)))
    rows = names.repartition(tasks, "model_a").join(F.broadcast(names.select(F.col("model_a").alias("model_b"))), F.col("model_a") < F.col("model_b"))
    if limit is None:
        return rows
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), "model_a", F.lit("-"), "model_b"))).limit(limit)


def observation_counts(long: DataFrame) -> DataFrame:
    """(analysis_type, dataset, n_pairs): half the rows of the long table, be it weighted or not."""
    rows = F.sum("n") if "n" in long.columns else F.count("*")
    return long.groupBy("analysis_type", "dataset").agg(F.floor(rows / 2).alias("n_pairs"))


def counts_table(long: DataFrame, datasets: list[str]) -> DataFrame:
    """Pair counts with a column per dataset and a total."""
    wide = observation_counts(long).groupBy("analysis_type").pivot("dataset", datasets).agg(F.sum("n_pairs"))
    filled = wide.fillna(0)
    total = sum((F.col(f"`{d}`") for d in datasets), F.lit(0))
    return filled.withColumn("total", total)
