"""The composite vulnerability score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelanes.functions import formulas
from tradelanes.functions.guards import coerce_double, stable, zero_if_null
from tradelanes.operators import ranking
from tradelanes.operators.alerts import CORRIDOR

NORMALISATIONS = ("min_max", "percentile_rank", "log_percentile")
COMPOSITIONS = ("weighted_linear", "geometric_mean", "hybrid")
INPUTS = ("sci", "his", "crs")


@dataclass(frozen=True)
class ScoringConfig:
    """How scores are normalised and composed; out-of-range values are refused."""

    normalisation: str = "percentile_rank"
    composition: str = "hybrid"
    alpha: float = 0.90
    w_hazard: float = 1.0
    w_price: float = 1.0
    w_supply_chain: float = 1.0

    def __post_init__(self) -> None:
        if self.normalisation not in NORMALISATIONS:
            raise ValueError(f"unknown normalisation: {self.normalisation}")
        if self.composition not in COMPOSITIONS:
            raise ValueError(f"unknown composition: {self.composition}")
        if not 0.01 <= self.alpha <= 0.99:
            raise ValueError("alpha must be between 0.01 and 0.99")
        if min(self.w_hazard, self.w_price, self.w_supply_chain) < 0:
            raise ValueError("weights must not be negative")


def normalise_corridors(corridors: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Add ``sci_norm``, ``his_norm`` and ``crs_norm``.

    Hazard intensity is exponentially distributed and is always ranked on its
    logarithm, whatever the method; the others follow the method.
    ``corridors`` is read several times; pass a materialised frame.
    """
    df = corridors
    for name in INPUTS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
        elif dict(df.dtypes)[name] != "double":
            df = df.withColumn(name, coerce_double(F.col(name)))
    method = {name: config.normalisation for name in INPUTS}
    method["his"] = "log_percentile"
    ranked = [name for name in INPUTS if method[name] != "min_max"]
    for name in INPUTS:
        if method[name] == "min_max":
            df = ranking.normalise_min_max(df, name, f"{name}_norm")
    measures = {
        name: F.log1p(F.col(name)) if method[name] == "log_percentile" else F.col(name)
        for name in ranked
    }
    df = df.withColumns({f"_m_{name}": measure for name, measure in measures.items()})
    cuts = ranking.cut_points(df, [f"_m_{name}" for name in ranked])
    for name in ranked:
        df = ranking.normalise_percentile_rank(
            df, f"_m_{name}", CORRIDOR, f"{name}_norm", cuts[f"_m_{name}"]
        )
    return df.drop(*[f"_m_{name}" for name in ranked])


def _compose(config: ScoringConfig, values: list[Column]) -> Column:
    if config.composition == "hybrid":
        sci, crs, his, pas, sccs = values
        return formulas.score_hybrid(
            sci, crs, his, pas, sccs, config.w_hazard, config.w_price, config.w_supply_chain
        )
    weights = formulas.equal_weights(len(values))
    if config.composition == "weighted_linear":
        return formulas.score_weighted_linear(values, weights)
    return formulas.score_geometric_mean(values, weights)


def composite_scores(corridors: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Add the score, the inputs it lacked, and the hazard-only stand-in.

    A corridor without a structural input gets no score. Price and
    supply-chain signals count 0 where absent.
    """
    parts = ["sci_norm", "crs_norm", "his_norm"]
    extra = [
        zero_if_null(F.col(name)) if name in corridors.columns else F.lit(0.0)
        for name in ("pas_norm", "sccs_norm")
    ]
    complete = F.col(parts[0]).isNotNull() & F.col(parts[1]).isNotNull() & F.col(parts[2]).isNotNull()
    score = _compose(config, [F.col(p) for p in parts] + extra)
    missing = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts]))
    return corridors.withColumns(
        {
            "cvs": F.when(complete, score),
            "cvs_missing_inputs": missing,
            "cvs_hazard_only": F.col("his_norm"),
        }
    )


def rank_scored(scored: DataFrame) -> DataFrame:
    """Highest score first, corridors without one last."""
    return scored.orderBy(stable(F.col("cvs")).desc_nulls_last(), *CORRIDOR)


def score(corridors: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Normalise and compose. ``corridors`` must be stored or materialised."""
    return composite_scores(normalise_corridors(corridors, config), config)
