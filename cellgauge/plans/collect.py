"""A run that honours invalidation: modules whose metrics a change of settings leaves valid don't run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blockcodec, closedloop, codecs, codes, neighbours, sampling
from ..sources.arrays import unpack
from . import catalog

#: A module makes its metrics, a column each, from packed arrays and the settings bound and codec.
Module = Callable[[DataFrame, dict], DataFrame]


@dataclass
class Collected:
    """field_id and a column for each metric; the modules that ran, in order."""

    table: DataFrame
    ran: list[str]


def _neighbours(packed: DataFrame, settings: dict) -> DataFrame:
    cells, dims = unpack(neighbours.checked(packed)), _open(settings)
    both = neighbours.neighbour_features(cells, dims).join(neighbours.non_constant_share(cells, dims), "field_id")
    return both.select("field_id", *[F.col(c).alias(f"neighbours:{c}") for c in both.columns if c != "field_id"])


def _open(settings: dict) -> list[int]:
    """The arrays' dims with the first open; of one dimension unless the settings say otherwise."""
    return [0, *settings.get("dims", [0])[1:]]


def _ratio(name: str, how: Callable[[DataFrame, dict], DataFrame]) -> Module:
    return lambda packed, settings: how(packed, settings).select("field_id", F.col("ratio").alias(name))


def _sampled_tiles(packed: DataFrame, settings: dict) -> DataFrame:
    t = sampling.sampled_tiles(unpack(packed), _open(settings), settings.get("n", sampling.N_TILES), settings.get("seed", 0), settings.get("block_size"))
    return codecs.sampled_ratio(t, settings.get("codec", "quant_zlib"), settings["bound"]).withColumnRenamed("estimate", "ratio")


def _sampled_blocks(packed: DataFrame, settings: dict) -> DataFrame:
    """The transform codec's ratio on evenly placed blocks; needs the arrays' dims."""
    c = sampling.sampled_blocks(unpack(packed), settings["dims"], settings.get("sample_ratio", 0.01))
    return blockcodec.transform_ratio(c, settings["dims"], settings["bound"])


def _entropy(packed: DataFrame, settings: dict) -> DataFrame:
    return codes.quant_entropy_ratio(unpack(packed), settings["bound"]).select("field_id", F.col("entropy").alias("entropy:entropy"), F.col("ratio").alias("entropy:ratio"))


def observed(packed: DataFrame, settings: dict, plugins: list[str]) -> DataFrame:
    """field_id and a column for each number of the named listeners, from one run of the codec."""
    c = codecs.observed(packed, settings.get("codec", "quant_zlib"), settings["bound"], [codecs.LISTENERS[p]() for p in plugins])
    return c.select("field_id", *[F.col("metrics")[n].alias(n) for p in plugins for n in CODEC_METRICS[p]])


#: What each listener says.
CODEC_METRICS = {"size": ["size:raw_bytes", "size:compressed_bytes", "size:ratio"], "error_stat": ["error_stat:max_error", "error_stat:mse", "error_stat:value_range", "error_stat:psnr"], "time": ["time:compress", "time:decompress"]}

MODULES: dict[str, Module] = {
    "neighbours": _neighbours,
    "lorenzo_bits": _ratio("lorenzo_bits:ratio", lambda p, s: codes.corrected_ratio(closedloop.scan_histograms(p, s["bound"], 1), codes.CENTER, 0)),
    "interpolation_bits": _ratio("interpolation_bits:ratio", lambda p, s: codes.code_bits(closedloop.scan_histograms(p, s["bound"], how="interpolation"), codes.CENTER, 0)),
    "sampled_tiles": _ratio("sampled_tiles:ratio", _sampled_tiles),
    "sampled_blocks": _ratio("sampled_blocks:ratio", _sampled_blocks),
    "range": lambda p, s: p.select("field_id", (F.array_max("values") - F.array_min("values")).alias("range:value_range"), F.size("values").cast("double").alias("range:n_values")),
    "entropy": _entropy,
}


def invalid_metrics(scheme: catalog.Scheme, changes: set[str]) -> list[catalog.Metric]:
    """The scheme's metrics that a change set makes invalid; labels only in a training."""
    classes = set(scheme.classes(changes))
    return [m for m in scheme.metrics if classes & set(m.causes or catalog.CLASSES) and (m.usage == "feature" or catalog.TRAINING in changes)]


def collect(scheme: catalog.Scheme, changes: set[str], packed: DataFrame, settings: dict, cached: DataFrame | None = None) -> Collected:
    """The scheme's features and, where labels are wanted, its labels: fresh where the changes make them invalid, else from cached.

    The fields are those of packed, whatever else the cache holds. Each module that has an invalid metric
    runs once, and all listeners to a codec in one run of it. Labels need the real codec, so their modules run
    only in a training that the predictor needs, or on request; without one, labels that aren't cached
    are left out. A value that is neither fresh nor cached is an error that names its metric.
    """
    wanted = catalog.uses_real_codec(scheme, changes)
    usage = {m.module: m.usage for m in scheme.metrics}
    stale = [m.module for m in invalid_metrics(scheme, changes)]
    if wanted:
        stale += [m.module for m in scheme.metrics if m.usage == "label"]
    ran = [m for m in dict.fromkeys(stale) if usage[m] == "feature" or wanted]
    fresh = packed.select("field_id").distinct()
    listeners = [m for m in ran if m in codecs.LISTENERS]
    own = {m.column or m.metric: m.metric for m in scheme.metrics if m.module in ran}
    parts = [MODULES[m](packed, settings) for m in ran if m not in listeners] + ([observed(packed, settings, listeners)] if listeners else [])
    for part in parts:
        fresh = fresh.join(part.select("field_id", *[F.col(f"`{c}`").alias(own[c]) for c in part.columns if c in own]), "field_id", "left")
    held = cached if cached is not None else packed.sparkSession.createDataFrame([], "field_id string")
    metrics = [m.metric for m in scheme.metrics if m.usage == "feature" or wanted or m.metric in held.columns]
    return Collected(catalog.fresh_or_cached(fresh, held, metrics, how="left"), ran)


def features(scheme: catalog.Scheme, collected: Collected) -> DataFrame:
    return collected.table.select("field_id", *[F.col(f"`{m}`") for m in scheme.of_usage("feature")])


def labels(scheme: catalog.Scheme, collected: Collected) -> DataFrame:
    return collected.table.select("field_id", *[F.col(f"`{m}`") for m in scheme.of_usage("label")])


#: A scheme with a feature of the data alone and one that depends on the error bound.
CODES = catalog.Scheme(
    "codes",
    (catalog.Metric("range:value_range", "range", "feature", (catalog.DATA,), False, False), catalog.Metric("entropy:entropy", "entropy", "feature", (catalog.DEPENDENT, catalog.DATA), False, False), catalog.Metric("size:ratio", "size", "label", (catalog.DEPENDENT, catalog.DATA), True, False)),
    {catalog.RUNTIME: (), catalog.DEPENDENT: ("bound",), catalog.AGNOSTIC: ("level",)},
    ("bound", "level"),
    predictor="offset",
    training_required=True,
)

_TIME = (catalog.NONDETERMINISTIC, catalog.RUNTIME, catalog.DEPENDENT, catalog.AGNOSTIC, catalog.DATA)
#: The time that a codec takes, where it runs, from what is known before.
TIMING = catalog.Scheme(
    "timing",
    (
        catalog.Metric("range:value_range", "range", "feature", (catalog.DATA,), False, False),
        catalog.Metric("range:n_values", "range", "feature", (catalog.DATA,), False, False),
        catalog.Metric("time:compress", "time", "label", _TIME, True, False),
        catalog.Metric("time:decompress", "time", "label", _TIME, True, True),
    ),
    CODES.settings,
    CODES.all_settings,
    predictor="least_squares",
    training_required=True,
)
#: The ratio of an ideal entropy coder, which needs no codec, from how far values are from the ones before.
ENTROPY_CODER = catalog.Scheme(
    "entropy_coder",
    (catalog.Metric("neighbours:mean_lorenzo_difference", "neighbours", "feature", (catalog.DATA,), False, False), catalog.Metric("entropy:ratio", "entropy", "label", (catalog.DEPENDENT, catalog.DATA), False, False)),
    CODES.settings,
    CODES.all_settings,
    predictor="offset",
    training_required=True,
)
#: The same label from all neighbourhood features, which depend on the data alone and are dear.
TEXTURE = catalog.Scheme(
    "texture",
    tuple(catalog.Metric(f"neighbours:{m}", "neighbours", "feature", (catalog.DATA,), False, False) for m in ("value_range", "mean_value", "mean_neighbor_difference", "mean_lorenzo_difference", "mean_spline_difference", "non_constant_block_percentage"))
    + (catalog.Metric("entropy:ratio", "entropy", "label", (catalog.DEPENDENT, catalog.DATA), False, False),),
    CODES.settings,
    CODES.all_settings,
    predictor="least_squares",
    training_required=True,
)
#: The published schemes and those of this package.
SCHEMES = catalog.SCHEMES | {s.name: s for s in (CODES, TIMING, ENTROPY_CODER, TEXTURE)}
