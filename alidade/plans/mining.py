"""The mining plan: generate, screen, prune, recompute and freeze."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alidade import __version__
from alidade.operators.audit import difference, factor_id, freeze, panel_fingerprint
from alidade.operators.screening import factor_correlations, information_coefficients, prune_redundant, summary, turnover
from alidade.operators.timeseries import forward_return
from alidade.plans.grammar import evaluate, long_values, parse, to_sql


@dataclass(frozen=True)
class Thresholds:
    """What a factor must reach on the screening dates."""

    least_t: float = 2.0
    least_coverage: float = 0.5
    most_turnover: float = 1.0
    most_correlation: float = 0.9
    most_false: float = 1.0  # expected share of chance among what passes; 1 leaves this out


@dataclass
class Outcome:
    """Definitions that stay, best first, with the statistics of all that were screened."""

    accepted: list[str]
    statistics: list[dict] = field(default_factory=list)


def labelled_values(panel: DataFrame, definitions: list[str], label_field: str = "total") -> DataFrame:
    """Long factor values with the forward return of label_field, which is made apart from the factors' columns."""
    labelled = panel.withColumn("label", forward_return(F.col(label_field)))
    return long_values(evaluate(labelled, definitions, keep=("label",)), definitions, keep=("label",))


def false_discovery_limit(ratios: list[float], share: float) -> float:
    """The least |t| that passes if at most `share` of what passes is to be chance (Benjamini and Hochberg, normal tails); infinity if none does."""
    sizes = sorted((abs(t) for t in ratios), reverse=True)
    return min((t for k, t in enumerate(sizes, 1) if math.erfc(t / math.sqrt(2)) <= share * k / len(sizes)), default=math.inf)


def screen(panel: DataFrame, definitions: list[str], until: str, rules: Thresholds = Thresholds(), batch: int = 40, label_field: str = "total") -> Outcome:  # noqa: B008
    """Screen on dates up to `until`; what is later is left for holding out. One job a batch of definitions, not one a factor.

    The driver gets a row a factor and a row a pair of factors of what passes. Pairs are made for two half batches at a time, so a job
    never holds more than `batch` factors.
    """
    names = {factor_id(str(parse(d))): str(parse(d)) for d in definitions}
    rows: list[dict] = []
    texts = list(names.values())
    for k in range(0, len(texts), batch):
        values = labelled_values(panel, texts[k : k + batch], label_field).where(F.col("dt") <= F.lit(until).cast("date"))
        found = summary(information_coefficients(values)).join(turnover(values), "factor_id", "left")
        rows += [r.asDict() for r in found.collect()]
    least = max(rules.least_t, false_discovery_limit([r["t_ratio"] for r in rows if r["t_ratio"] is not None], rules.most_false))
    passed = [
        r for r in rows
        if r["t_ratio"] is not None and abs(r["t_ratio"]) >= least and (r["coverage"] or 0) >= rules.least_coverage and (r["turnover"] or 0) <= rules.most_turnover
    ]
    good = [names[r["factor_id"]] for r in passed]
    pairs = {}
    half = max(batch // 2, 1)
    halves = [good[k : k + half] for k in range(0, len(good), half)]
    for some in combinations(halves, 2) if len(halves) > 1 else [halves]:
        part = [d for h in some for d in h]
        if len(part) > 1:
            values = labelled_values(panel, part, label_field).where(F.col("dt") <= F.lit(until).cast("date"))
            pairs |= {(r.factor_a, r.factor_b): r.correlation for r in factor_correlations(values).collect()}
    kept = prune_redundant([(r["factor_id"], abs(r["t_ratio"])) for r in passed], [(a, b, c) for (a, b), c in pairs.items()], rules.most_correlation)
    return Outcome([names[k] for k in kept], rows)


def held_out(panel: DataFrame, definitions: list[str], after: str, label_field: str = "total") -> DataFrame:
    """The summary of definitions on the dates after `after`, which screening until then has not seen."""
    values = labelled_values(panel, definitions, label_field).where(F.col("dt") > F.lit(after).cast("date"))
    return summary(information_coefficients(values))


def recompute(panel: DataFrame, definitions: list[str]) -> DataFrame:
    """Long factor values by the second path: SQL text instead of columns."""
    view = f"panel_{uuid.uuid4().hex}"
    panel.createOrReplaceTempView(view)
    return long_values(panel.sparkSession.sql(to_sql(definitions, view)), definitions)


def check(panel: DataFrame, definitions: list[str], tolerance: float = 1e-9) -> DataFrame:
    """How the two paths differ, by factor."""
    return difference(long_values(evaluate(panel, definitions), definitions), recompute(panel, definitions), tolerance)


def seal(panel: DataFrame, accepted: list[str], store: str, name: str, seed: int | None = None) -> DataFrame:
    """Freeze the accepted definitions with their values; raises if recomputation does not agree, or if the name is taken."""
    off = check(panel, accepted).where("missing > 0 or beyond > 0").limit(1).count()
    if off:
        raise ValueError("recomputed values differ; nothing was frozen")
    values = long_values(evaluate(panel, accepted), accepted)
    spark = panel.sparkSession
    definitions = spark.createDataFrame([(factor_id(str(parse(d))), str(parse(d))) for d in accepted], "factor_id string, definition string")
    return freeze(values, definitions, store, name, {"engine": __version__, "spark": spark.version, "seed": str(seed), "panel": panel_fingerprint(panel)})
