"""Model names parsed into registry columns, as Catalyst expressions made from rule tables.

A name is ``variant.config``, split at the first dot. Matching is on lower-cased text; a token is a part
between underscores. Rules apply in order, the first that matches decides. Every output is a CASE ladder or a
regular expression, so parsing is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name prefix, family, generation. Longer prefixes come before the shorter ones they start with.
FAMILIES: list[tuple[str, str, str | None]] = [
    ("aimv2", "AIMv2", "v2"), ("sam2_hiera", "SAM2-Hiera", "2"), ("eva02", "EVA", "v2"), ("eva", "EVA", None),
    ("beitv2", "BEiT", "v2"), ("beit3", "BEiT", "v3"), ("beit", "BEiT", None), ("naflexvit", "ViT", None), ("vit_", "ViT", None),
    ("deit3", "DeiT", "III"), ("deit", "DeiT", None), ("swinv2", "Swin", "v2"), ("swin_s3", "Swin", "S3"), ("swin", "Swin", None),
    ("convnextv2", "ConvNeXt", "v2"), ("convnext", "ConvNeXt", None), ("caformer", "MetaFormer", None), ("convformer", "MetaFormer", None),
    ("poolformerv2", "MetaFormer", "v2"), ("poolformer", "MetaFormer", None), ("efficientvit", "EfficientViT", None),
    ("efficientformerv2", "EfficientFormer", "v2"), ("efficientformer", "EfficientFormer", None), ("efficientnetv2", "EfficientNet", "v2"),
    ("tf_efficientnetv2", "EfficientNet", "v2"), ("tf_efficientnet", "EfficientNet", None), ("efficientnet", "EfficientNet", None),
    ("mobilenetv5", "MobileNet", "v5"), ("mobilenetv4", "MobileNet", "v4"), ("mobilenetv3", "MobileNet", "v3"), ("mobilenetv2", "MobileNet", "v2"),
    ("mobilenetv1", "MobileNet", "v1"), ("mobilenet_edgetpu", "MobileNet", "EdgeTPU"), ("tf_mobilenetv3", "MobileNet", "v3"), ("mobilenet", "MobileNet", None),
    ("mobileone", "MobileOne", None), ("mobilevitv2", "MobileViT", "v2"), ("mobilevit", "MobileViT", None), ("resnetv2", "ResNet", "v2"),
    ("resnetrs", "ResNet", "RS"), ("resnetaa", "ResNet", "AA"), ("resnetblur", "ResNet", "Blur"), ("resnext", "ResNeXt", None), ("resnest", "ResNeSt", None),
    ("resnet50_clip", "ResNet", "CLIP"), ("resnet50x", "ResNet", "CLIP-scaled"), ("resnet101_clip", "ResNet", "CLIP"), ("resnet", "ResNet", None),
    ("wide_resnet", "Wide-ResNet", None), ("regnety", "RegNet", "Y"), ("regnetx", "RegNet", "X"), ("regnetv", "RegNet", "V"), ("regnetz", "RegNet", "Z"),
    ("maxxvitv2", "MaxViT", "v2"), ("maxxvit", "MaxViT", None), ("maxvit", "MaxViT", None), ("vitamin", "ViTamin", None), ("hiera", "Hiera", None),
    ("mvitv2", "MViT", "v2"), ("mvit", "MViT", None), ("coatnet", "CoAtNet", None), ("coatnext", "CoAtNeXt", None), ("coat", "CoaT", None), ("davit", "DaViT", None),
    ("dm_nfnet", "NFNet", None), ("eca_nfnet", "NFNet", None), ("nfnet", "NFNet", None), ("nf_resnet", "ResNet", "NF"), ("nf_regnet", "RegNet", "NF"),
    ("mambaout", "MambaOut", None), ("samvit", "SAM-ViT", None), ("xcit", "XCiT", None), ("csatv2", "CSAFormer", "v2"), ("csat", "CSAFormer", None),
    ("gc_efficientnetv2", "EfficientNet", "v2-GC"), ("gcvit", "GCViT", None), ("focalnet", "FocalNet", None), ("fastvit", "FastViT", None), ("shvit", "ShViT", None),
    ("starnet", "StarNet", None), ("nextvit", "NextViT", None), ("flexivit", "FlexiViT", None), ("dpn", "DPN", None), ("dla", "DLA", None), ("pvt_v2", "PVT", "v2"),
    ("pvt", "PVT", None), ("twins", "Twins", None), ("sequencer2d", "Sequencer2D", None), ("mixer", "MLP-Mixer", None), ("gmlp", "gMLP", None), ("gmixer", "gMixer", None),
    ("resmlp", "ResMLP", None), ("vgg", "VGG", None), ("densenet", "DenseNet", None), ("hrnet", "HRNet", None), ("hgnetv2", "HGNet", "v2"), ("hgnet", "HGNet", None),
    ("xception", "Xception", None), ("inception_resnet", "InceptionResNet", None), ("inception_next", "InceptionNeXt", None), ("inception", "Inception", None),
    ("nasnet", "NASNet", None), ("pnasnet", "PNASNet", None), ("repvgg", "RepVGG", None), ("repvit", "RepViT", None), ("repghostnet", "RepGhostNet", None),
    ("convmixer", "ConvMixer", None), ("convit", "ConViT", None), ("crossvit", "CrossViT", None), ("cait", "CaiT", None), ("volo", "VOLO", None), ("pit", "PiT", None),
    ("tnt", "TNT", None), ("visformer", "VisFormer", None), ("fasternet", "FasterNet", None), ("ghostnetv3", "GhostNet", "v3"), ("ghostnetv2", "GhostNet", "v2"),
    ("ghostnet", "GhostNet", None), ("eca_botnext", "BotNet", "ECA"), ("eca_halonext", "HaloNet", "ECA"), ("eca_resnet", "ResNet", "ECA"), ("eca_resnext", "ResNeXt", "ECA"),
    ("ecaresnet", "ResNet", "ECA"), ("seresnet", "ResNet", "SE"), ("seresnext", "ResNeXt", "SE"), ("sehalonet", "HaloNet", "SE"), ("sebotnet", "BotNet", "SE"),
    ("gcresnet", "ResNet", "GC"), ("gcresnext", "ResNeXt", "GC"), ("tiny_vit", "TinyViT", None), ("res2net", "Res2Net", None), ("res2next", "Res2NeXt", None),
    ("tresnet", "TResNet", None), ("swiftformer", "SwiftFormer", None), ("levit", "LeViT", None), ("lambda_resnet", "ResNet", "Lambda"), ("halonet", "HaloNet", None),
    ("halo2botnet", "HaloNet", None), ("halobotnet", "HaloNet", None), ("lamhalobotnet", "HaloNet", None), ("bat_resnext", "ResNeXt", "BAT"), ("botnet", "BotNet", None),
    ("cspdarknet", "DarkNet", "CSP"), ("cspresnext", "ResNeXt", "CSP"), ("cspresnet", "ResNet", "CSP"), ("cs3sedarknet", "DarkNet", "CS3-SE"), ("cs3darknet", "DarkNet", "CS3"),
    ("cs3edgenet", "EdgeNet", "CS3"), ("cs3se_edgenet", "EdgeNet", "CS3-SE"), ("darknetaa", "DarkNet", "AA"), ("darknet", "DarkNet", None), ("gernet", "GENet", None),
    ("haloregnetz", "RegNet", "HaloZ"), ("senet", "SENet", None), ("spnasnet", "SPNASNet", None), ("test_byobnet", "BYOBNet", "test"), ("test_convnext", "ConvNeXt", "test"),
    ("test_efficientnet_evos", "EfficientNet", "test-EvoS"), ("test_efficientnet_gn", "EfficientNet", "test-GN"), ("test_efficientnet_ln", "EfficientNet", "test-LN"),
    ("test_efficientnet", "EfficientNet", "test"), ("test_nfnet", "NFNet", "test"), ("test_resnet", "ResNet", "test"), ("test_vit", "ViT", "test"), ("selecsls", "SelecSLS", None),
    ("mixnet", "MixNet", None), ("tf_mixnet", "MixNet", None), ("skresnext", "ResNeXt", "SK"), ("skresnet", "ResNet", "SK"), ("edgenext", "EdgeNeXt", None), ("rdnet", "RDNet", None),
    ("rexnetr", "RexNet", "R"), ("rexnet", "RexNet", None), ("fbnetv3", "FBNet", "v3"), ("fbnetc", "FBNet", "C"), ("semnasnet", "MnasNet", "SE"), ("mnasnet", "MnasNet", None),
    ("lcnet", "LCNet", None), ("hardcorenas", "HardCoreNAS", None), ("nest", "NestNet", None), ("ese_vovnet", "VoVNet", "ESE"), ("tinynet", "TinyNet", None), ("csp", "CSP-Net", None),
]

#: Family and its coarse category.
MACRO_FAMILIES: dict[str, str] = {
    "ViT": "Vision Transformer", "DeiT": "Vision Transformer", "CaiT": "Vision Transformer", "BEiT": "Vision Transformer",
    "EVA": "Vision Transformer", "FlexiViT": "Vision Transformer", "AIMv2": "Vision Transformer", "ViTamin": "Vision Transformer",
    "SAM-ViT": "Vision Transformer", "NaFlexViT": "Vision Transformer", "CSAFormer": "Vision Transformer", "Swin": "Hierarchical Vision Transformer",
    "MViT": "Hierarchical Vision Transformer", "Hiera": "Hierarchical Vision Transformer", "SAM2-Hiera": "Hierarchical Vision Transformer",
    "PVT": "Hierarchical Vision Transformer", "Twins": "Hierarchical Vision Transformer", "DaViT": "Hierarchical Vision Transformer",
    "GCViT": "Hierarchical Vision Transformer", "FocalNet": "Hierarchical Vision Transformer", "CrossViT": "Vision Transformer",
    "XCiT": "Vision Transformer", "TNT": "Vision Transformer", "VOLO": "Vision Transformer", "VisFormer": "Vision Transformer",
    "Sequencer2D": "Vision Transformer", "CoAtNet": "Hybrid CNN-Transformer", "CoAtNeXt": "Hybrid CNN-Transformer",
    "MaxViT": "Hybrid CNN-Transformer", "CoaT": "Hybrid CNN-Transformer", "TinyViT": "Hybrid CNN-Transformer", "NextViT": "Hybrid CNN-Transformer",
    "FastViT": "Hybrid CNN-Transformer", "MobileViT": "Hybrid CNN-Transformer", "EfficientViT": "Hybrid CNN-Transformer",
    "LeViT": "Hybrid CNN-Transformer", "NestNet": "Hybrid CNN-Transformer", "PiT": "Hybrid CNN-Transformer", "BotNet": "Hybrid CNN-Transformer",
    "HaloNet": "Hybrid CNN-Transformer", "ShViT": "Hybrid CNN-Transformer", "SwiftFormer": "Hybrid CNN-Transformer",
    "EfficientFormer": "Hybrid CNN-Transformer", "RepViT": "Hybrid CNN-Transformer", "MetaFormer": "MetaFormer", "MLP-Mixer": "MLP", "ResMLP": "MLP",
    "gMixer": "MLP", "ConvNeXt": "Convolutional", "ConViT": "Hybrid CNN-Transformer", "InceptionNeXt": "Convolutional", "RDNet": "Convolutional",
    "ResNet": "Convolutional", "ResNeXt": "Convolutional", "Wide-ResNet": "Convolutional", "ResNeSt": "Convolutional", "Res2Net": "Convolutional",
    "Res2NeXt": "Convolutional", "SENet": "Convolutional", "DenseNet": "Convolutional", "VGG": "Convolutional", "Inception": "Convolutional",
    "InceptionResNet": "Convolutional", "NFNet": "Convolutional", "HRNet": "Convolutional", "DLA": "Convolutional", "DPN": "Convolutional",
    "RegNet": "Convolutional", "EfficientNet": "Convolutional", "HGNet": "Convolutional", "HGNetV2": "Convolutional", "TResNet": "Convolutional",
    "MobileNet": "Convolutional", "MobileOne": "Convolutional", "MixNet": "Convolutional", "MnasNet": "Convolutional", "FBNet": "Convolutional",
    "LCNet": "Convolutional", "RexNet": "Convolutional", "GENet": "Convolutional", "GhostNet": "Convolutional", "RepGhostNet": "Convolutional",
    "RepVGG": "Convolutional", "EdgeNeXt": "Convolutional", "FasterNet": "Convolutional", "VoVNet": "Convolutional", "NASNet": "Convolutional",
    "HardCoreNAS": "Convolutional", "Xception": "Convolutional", "TinyNet": "Convolutional", "SPNASNet": "Convolutional", "CSPNet": "Convolutional",
    "DarkNet": "Convolutional", "StarNet": "Convolutional", "MambaOut": "State Space Model",
}

#: Size token and label.
SIZES: list[tuple[str, str]] = [
    ("3b", "3B"), ("1b", "1B"), ("xxs", "XXSmall"), ("xs", "XSmall"), ("xxlarge", "XXLarge"), ("xlarge", "XLarge"), ("gigantic", "Gigantic"), ("giantopt", "GiantOpt"),
    ("huge_plus", "Huge+"), ("huge", "Huge"), ("giant", "Giant"), ("so400m", "SO400M"), ("so150m2", "SO150M2"), ("so150m", "SO150M"), ("large2", "Large2"), ("large", "Large"),
    ("base_plus", "Base+"), ("base", "Base"), ("mediumd", "MediumD"), ("medium", "Medium"), ("betwixt", "Betwixt"), ("small_plus", "Small+"), ("small", "Small"), ("little", "Little"),
    ("wee", "Wee"), ("pwee", "pWee"), ("dwee", "dWee"), ("dpwee", "dpWee"), ("tiny", "Tiny"), ("femto", "Femto"), ("atto", "Atto"), ("pico", "Pico"), ("nano", "Nano"),
    ("micro", "Micro"), ("mini", "Mini"), ("zepto", "Zepto"), ("b8", "B8"), ("b7", "B7"), ("b6", "B6"), ("b5", "B5"), ("b4", "B4"), ("b3", "B3"), ("b2", "B2"), ("b1", "B1"), ("b0", "B0"),
    ("l1", "L1"), ("l3", "L3"), ("l7", "L7"), ("050", "0.50x"), ("075", "0.75x"), ("100", "1.00x"), ("125", "1.25x"), ("150", "1.50x"), ("175", "1.75x"), ("200", "2.00x"),
    ("enormous", "Enormous"), ("xsmall", "XSmall"), ("300m", "300M"), ("xl", "XL"), ("el", "EL"), ("em", "EM"), ("es", "ES"), ("lite4", "Lite4"), ("lite3", "Lite3"),
    ("lite2", "Lite2"), ("lite1", "Lite1"), ("lite0", "Lite0"), ("s12", "S12"), ("s18", "S18"), ("s24", "S24"), ("s36", "S36"), ("m36", "M36"), ("m48", "M48"), ("b36", "B36"),
    ("b48", "B48"), ("kobe", "Kobe"), ("tinynet_a", "A"), ("tinynet_b", "B"), ("tinynet_c", "C"), ("tinynet_d", "D"), ("tinynet_e", "E"), ("lite", "Lite"), ("5m", "5M"),
    ("11m", "11M"), ("21m", "21M"),
]

#: Head, positional encoding and boolean tokens; valid input sizes.
HEADS = [("clsgap", "CLS+GAP"), ("gap", "GAP"), ("cls", "CLS")]
POSITIONS = [("rope_mixed_ape", "RoPE-Mixed-APE"), ("rope_mixed", "RoPE-Mixed"), ("rope_ape", "RoPE-APE"), ("rope_reg", "RoPE"), ("rope", "RoPE"), ("relpos", "RelPos"), ("srelpos", "SRelPos"), ("rpn", "RPN"), ("sincos", "SinCos"), ("ape", "APE")]
FLAGS = {"is_pruned": "pruned", "is_gap": "gap", "uses_rmlp": "rmlp", "uses_rw": "rw", "uses_cr": "cr", "uses_ns": "ns", "uses_abswin": "abswin", "uses_quickgelu": "quickgelu"}
PRETRAIN_RESOLUTIONS = (160, 192, 224, 240, 256, 288, 320, 336, 378, 384, 396, 448, 475, 480, 512, 576, 640, 896, 1024)
RESOLUTIONS = tuple(sorted((*PRETRAIN_RESOLUTIONS, 768)))

#: Dataset, organisation, method, dataset-size and augmentation tokens of the config part.
DATASETS: dict[str, str] = {
    "in1k": "ImageNet-1K", "in21k": "ImageNet-21K", "in22k": "ImageNet-22K", "in12k": "ImageNet-12K", "inw21k": "ImageNet-Winter-21K", "ig1b": "Instagram-1B",
    "yfcc15m": "YFCC-15M", "yfcc100m": "YFCC-100M", "cc12m": "CC-12M", "sa1b": "SA-1B", "laion2b": "LAION-2B", "laion400m": "LAION-400M", "laion2": "LAION-2B",
    "laiona": "LAION-Aesthetic", "datacompxl": "DataComp-XL", "datacomp1b": "DataComp-1B", "metaclip2": "MetaCLIP-2", "metaclip": "MetaCLIP", "dfn5b": "DFN-5B",
    "dfn2b": "DFN-2B", "dfndr2b": "DFN-DR-2B", "merged2b": "Merged-2B", "webli": "WebLI", "pali2": "PaLI-2", "pali": "PaLI", "ogvl": "OGVL", "m38m": "M-3.8B", "m30m": "M-3B",
    "jft": "JFT", "lvd142m": "LVD-142M", "lvd1689m": "LVD-1689M", "sat493m": "SAT-493M", "green": "Green-dataset", "mclip2": "mCLIP-2", "seer": "Instagram-1B",
    "swag": "Instagram-3.6B", "wit": "WIT-400M",
}
ORGANISATIONS: dict[str, str] = {
    "apple": "Apple", "openai": "OpenAI", "msft": "Microsoft", "ms": "Microsoft", "goog": "Google", "tf": "Google/TF", "naver": "Naver", "paddle": "Baidu/PaddlePaddle",
    "sail": "SAIL", "miil": "MIIL", "snap": "Snap", "nv": "NVIDIA", "bd": "Baidu", "fb": "Meta", "ch": "Chris Ha", "dm": "DeepMind", "mx": "MXNet community",
    "gluon": "GluonCV/MXNet", "nav": "NaverAI", "pycls": "pycls", "cvnets": "CVNets/Apple", "rmsp": "RMSProp recipe", "lamb": "LAMB recipe", "sbb2": "timm SBB-v2 recipe",
    "sbb": "timm SBB recipe", "ra4": "timm RA4 recipe", "ra3": "timm RA3 recipe", "ra2": "timm RA2 recipe", "ra": "timm RA recipe", "a1h": "timm A1H recipe",
    "a1": "timm A1 recipe", "a2": "timm A2 recipe", "a3": "timm A3 recipe", "b1k": "timm B1K recipe", "b2k": "timm B2K recipe", "bt": "Bag-of-Tricks recipe",
    "tv2": "torchvision-v2", "tv": "torchvision", "sw": "Ross Wightman", "c2ns": "timm C2-NS recipe", "c2": "timm C2 recipe", "c1": "timm C1 recipe", "ah": "timm AH recipe",
    "agc": "AGC recipe", "d": "timm D recipe",
}
METHODS = [
    ("siglip", "SigLIP"), ("mclip", "mCLIP"), ("clip", "CLIP"), ("fcmae", "FCMAE"), ("mae", "MAE"), ("mim", "MIM"), ("ijepa", "I-JEPA"), ("dinov3", "DINOv3"), ("dinov2", "DINOv2"),
    ("dino", "DINO"), ("swsl", "SWSL"), ("swag", "SWAG"), ("wsl", "WSL"), ("ssl", "SSL"), ("ssld", "SSLD"), ("seer", "SEER"), ("nadamuon", "NadAMuon"), ("augreg", "AugReg"),
    ("distilled", "Distillation"), ("dist", "Distillation"), ("pt", "Pretraining"), ("ltt", "LTT"),
]
DATASET_SIZES = [("metaclip_400m", "400M"), ("metaclip_2pt5b", "2.5B"), ("dfn2b_s39b", "s39b"), ("2pt5", "2.5T"), ("2pt1", "2.1T"), ("400m", "400M"), ("s39b", "s39b"), ("6m", "6M")]
AUGMENTATIONS = [("augreg", "AugReg"), ("ap", "AdvProp"), ("ns", "NoisyStudent"), ("aa", "AutoAugment"), ("ra", "RandAugment")]
WIDTHS = {"050": "0.50x", "075": "0.75x", "100": "1.00x", "125": "1.25x", "150": "1.50x", "175": "1.75x", "200": "2.00x"}

def _null() -> Column:
    return F.lit(None).cast("string")


def _ladder(rules, test) -> Column:
    """CASE over (key, value) rules in order."""
    out = None
    for key, value in rules:
        out = F.when(test(key), value) if out is None else out.when(test(key), value)
    return out.otherwise(_null())


def _token(text: Column, key: str) -> Column:
    return F.concat(F.lit("_"), text, F.lit("_")).contains(f"_{key}_")


def _match(text: Column, pattern: str) -> Column:
    """First group of a token pattern, null without a match."""
    return F.nullif(F.regexp_extract(text, f"(?:^|_){pattern}(?:_|$)", 1), F.lit(""))


def _number(text: Column) -> Column:
    return F.try_cast(text, "bigint") if hasattr(F, "try_cast") else text.try_cast("bigint")


def _valid_resolution(text: Column) -> Column:
    """The first three- or four-digit token that is a known input size, scanning tokens without overlap.

    A match takes the underscore behind it, so of two adjacent candidates the second is not seen.
    """
    padded = F.concat(text, F.lit("_"))
    found = F.regexp_extract_all(padded, F.lit(r"(?:^|_)(\d{3,4})_"), 1)
    return F.try_element_at(F.filter(F.transform(found, lambda t: t.cast("bigint")), lambda n: n.isin(*RESOLUTIONS)), F.lit(1))


def parse_names(df: DataFrame, name: str = "model_name") -> DataFrame:
    """All registry columns that follow from the name; a name without a dot raises.

    num_parameters and latent_dim need the network itself and are left to the caller.
    """
    full = F.col(name)
    checked = F.when(full.contains("."), full).otherwise(F.raise_error(F.concat(F.lit("a model name needs a dot: "), full)))
    raw = F.substring_index(checked, ".", 1)
    config = F.substring(checked, F.length(raw) + 2, F.length(checked))
    base = df.select(full.alias("model_name"), F.lower(raw).alias("v0"), config.alias("pretrain_config"), F.lower(config).alias("cfg"))
    base = base.withColumn("is_legacy", F.col("v0").startswith("legacy_")).withColumn("v", F.when(F.col("is_legacy"), F.substring("v0", F.lit(8), F.length("v0"))).otherwise(F.col("v0")))
    v, v0, cfg = F.col("v"), F.col("v0"), F.col("cfg")
    base = base.withColumn("family", F.coalesce(_ladder([(p, f) for p, f, _ in FAMILIES], v.startswith), F.lit("unknown")))
    base = base.withColumn("model_version", _ladder([(p, ver) for p, _, ver in FAMILIES], v.startswith))
    family = F.col("family")
    base = base.withColumn("macro_family", F.create_map(*[F.lit(x) for pair in MACRO_FAMILIES.items() for x in pair])[family])

    width_token = _match(v0, r"(050|075|100|125|150|175|200)")
    small = F.when(
        (family == "EfficientFormer") & (F.col("model_version") == "v2"),
        _ladder([("efficientformerv2_l", "L"), ("efficientformerv2_s0", "S0"), ("efficientformerv2_s1", "S1"), ("efficientformerv2_s2", "S2")], v0.startswith),
    ).when(
        family == "MobileViT",
        F.coalesce(_ladder([("mobilevit_xxs", "XXSmall"), ("mobilevit_xs", "XSmall"), ("mobilevit_s", "Small")], v0.startswith), _ladder(WIDTHS.items(), lambda k: width_token == k)),
    ).when((family == "ViT") & v0.contains("intern300m"), F.lit("300M"))
    base = base.withColumn("size", F.coalesce(_ladder(SIZES, lambda k: _token(v, k)), small))

    depth = _match(v, r"(\d{2,3})")
    three = _match(v, r"(\d{3})")
    depth_ok = ~_number(depth).isin(*RESOLUTIONS, 4, 8, 14, 16, 32)
    base = base.select(
        "*",
        F.coalesce(_number(_match(v, r"patch(\d+)")), _number(_match(v, r"p(\d+)"))).alias("patch_size"),
        _valid_resolution(v).alias("input_resolution"),
        _number(_match(v, r"window(\d+)(?:to\d+)?")).alias("window_size"),
        F.when(~v.startswith("swin") & ~v.startswith("sam"), _match(v, r"(s\d+)")).alias("stride_code"),
        F.coalesce(_match(v, r"(f\d+|l\d+)"), F.when(depth_ok, depth)).alias("depth_code"),
        F.coalesce(_match(v, r"(\d+x\d+d)"), _match(v, r"(w\d+)"), _match(v, r"(\d+w(?:_\d+s)?)"), _match(v, r"(x\d+)"), F.when(~_number(three).isin(*RESOLUTIONS), three)).alias("width_code"),
        _ladder(HEADS, lambda k: _token(v, k)).alias("head_type"),
        _number(_match(v, r"reg(\d+)")).alias("num_registers"),
        _ladder(POSITIONS, lambda k: _token(v, k)).alias("positional_encoding"),
        F.when(_token(v, "quickgelu"), F.lit("QuickGELU")).alias("activation"),
        F.initcap(_match(v, r"pe_(lang|core|spatial)")).alias("pe_scope"),
        (_token(v, "distilled") | _token(v, "dist") | _token(cfg, "dist")).alias("is_distilled"),
        *[_token(v, token).alias(flag) for flag, token in FLAGS.items()],
        v.rlike(r"\dts(?:_|$)").alias("uses_ts"),
        (_token(v, "aa") | v.rlike("^(?:resnetaa|darknetaa|seresnextaa)")).alias("uses_aa"),
    )
    return _parse_config(base).drop("v", "v0", "cfg")


def _parse_config(base: DataFrame) -> DataFrame:
    cfg, own = F.col("cfg"), F.col("pretrain_config")
    by_length = lambda table: sorted(table.items(), key=lambda kv: -len(kv[0]))
    ft_at = F.instr(cfg, "_ft_")
    after = F.when(ft_at > 0, F.substring(cfg, ft_at + 4, F.length(cfg)))
    before = F.when(ft_at > 0, F.substring(cfg, F.lit(1), ft_at - 1)).otherwise(cfg)
    tokens = F.split(cfg, "_")

    method = _ladder(METHODS, lambda k: F.exists(tokens, lambda t: t.contains(k)))
    exact = _ladder(by_length(ORGANISATIONS), lambda k: _token(cfg, k))
    started = F.transform(tokens, lambda t: _ladder(by_length(ORGANISATIONS), lambda k: t.startswith(k) & (F.length(t) > len(k))))
    org = F.coalesce(exact, F.try_element_at(F.filter(started, lambda x: x.isNotNull()), F.lit(1)))
    implied = F.when(cfg.contains("in22k_in1k") | cfg.contains("in21k_in1k") | cfg.contains("in12k_in1k") | cfg.contains("mae_in1k"), F.lit("ImageNet-1K"))
    base = base.withColumn("m0", method).withColumn("pretrain_org", org)
    base = base.withColumn("ft0", F.coalesce(_ladder(by_length(DATASETS), lambda k: F.coalesce(after.startswith(k), F.lit(False))), implied))
    named = _ladder(by_length(DATASETS), before.contains)
    fallback = F.when(F.col("pretrain_org") == "OpenAI", F.lit("WIT-400M")).when(cfg.rlike(r"^fb_r\d+"), F.lit("SA-1B"))
    base = base.withColumn("ds0", F.coalesce(named, fallback))
    promoted = F.col("ds0").isNull() & F.col("ft0").isNotNull() & (F.col("ft0") != "ImageNet-1K")
    base = base.withColumn("pretrain_dataset", F.when(promoted, F.col("ft0")).otherwise(F.col("ds0")))
    base = base.withColumn("pretrain_ft", F.when(promoted, F.lit("ImageNet-1K")).otherwise(F.col("ft0")))

    v0, family = F.col("v0"), F.col("family")
    by_variant = F.when(v0.contains("_clip") | v0.endswith("clip"), F.lit("CLIP")).when(v0.contains("dinov2"), F.lit("DINOv2")).when(v0.contains("dinov3"), F.lit("DINOv3"))
    by_variant = by_variant.when(v0.contains("dino") & ~v0.contains("dinov"), F.lit("DINO"))
    autoregressive = (family == "AIMv2") & (F.col("m0") == "Pretraining")
    base = base.withColumn("pretrain_method", F.when(autoregressive, F.lit("Autoregressive")).otherwise(F.coalesce("m0", by_variant)))

    own_before = F.when(ft_at > 0, F.substring(own, F.lit(1), ft_at - 1)).otherwise(own)
    own_after = F.when(ft_at > 0, F.substring(own, ft_at, F.length(own)))
    trailing = lambda text: _number(F.nullif(F.regexp_extract(text, r"_(\d{3,4})$", 1), F.lit("")))
    valid = lambda n: F.when(n.isin(*PRETRAIN_RESOLUTIONS), n)
    return base.select(
        "*",
        _ladder(DATASET_SIZES, cfg.contains).alias("pretrain_dataset_size"),
        F.coalesce(_number(_match(own, r"r(\d{3,4})")), valid(trailing(own_before))).alias("pretrain_resolution"),
        valid(trailing(own_after)).alias("pretrain_ft_resolution"),
        F.coalesce(_number(_match(cfg, r"e(\d{2,4})")), _number(_match(cfg, r"(\d{3,4})ep"))).alias("pretrain_epochs"),
        _match(cfg, r"(\d+pt\d+)").alias("pretrain_tokens"),
        _ladder(AUGMENTATIONS, lambda k: _token(cfg, k)).alias("pretrain_aug"),
        _token(cfg, "i18n").alias("pretrain_i18n"),
    ).drop("m0", "ft0", "ds0")
