"""What measured figures say about hypotheses of a retrieval's failure: a status for each, with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Figures that the rules read; each may be null or missing where it wasn't measured.
FIGURES = (
    "objective_r10", "train_r10", "val_r10", "train_median", "coverage_top100", "rebuild_difference", "perturbed_difference",
    "missing_keys", "unexpected_keys", "eval_difference", "dropout_in_eval", "gate_dominant_share", "learned_r10", "mean_r10", "max_r10",
)
HIGH, LOW, SAME, COLLAPSE = 0.5, 0.1, 1e-4, 0.9


def hypotheses(figures: DataFrame) -> DataFrame:
    """(place, hypothesis, status, evidence) of one row of figures; a hypothesis without its figures has no row.

    A high recall among ten is 0.5 or more, a low one below 0.1; figures that differ by less than 1e-4 are the same.
    """
    row = figures.select(*[(F.col(c) if c in figures.columns else F.lit(None)).cast("double").alias(c) for c in FIGURES])
    c = {name: F.col(name) for name in FIGURES}
    high, low = (lambda x: F.coalesce(x, F.lit(0.0)) >= HIGH), (lambda x: F.coalesce(x, F.lit(0.0)) < LOW)
    zero = lambda x: F.coalesce(x, F.lit(0.0)) == 0
    fresh = (F.coalesce(c["rebuild_difference"], F.lit(1.0)) < SAME) & (F.coalesce(c["perturbed_difference"], F.lit(0.0)) > SAME)
    loaded = zero(c["missing_keys"]) & zero(c["unexpected_keys"]) & (F.coalesce(c["eval_difference"], F.lit(1.0)) < SAME) & zero(c["dropout_in_eval"])
    better = (F.coalesce(c["mean_r10"], F.lit(0.0)) > c["learned_r10"]) | (F.coalesce(c["max_r10"], F.lit(0.0)) > c["learned_r10"])
    rules = [
        ("descriptors are those of the current checkpoint", ["rebuild_difference"], fresh, "Supported", "Insufficient", ["rebuild_difference", "perturbed_difference"]),
        ("train queries rank high over the full gallery", ["train_r10"], high(c["train_r10"]), "Supported", "Refuted", ["train_r10", "train_median"]),
        ("the objective and the full gallery disagree", ["objective_r10", "train_r10"], high(c["objective_r10"]) & low(c["train_r10"]), "Supported", "Insufficient", ["objective_r10", "train_r10", "coverage_top100"]),
        ("memorisation or a shift between splits", ["train_r10", "val_r10"], high(c["train_r10"]) & low(c["val_r10"]), "Supported", "Insufficient", ["train_r10", "val_r10"]),
        ("an error of evaluation, cache, labels or checkpoint", ["train_r10"], low(c["train_r10"]), "Insufficient", "Insufficient", ["train_r10"]),
        ("the checkpoint is loaded whole and in evaluation mode", ["eval_difference"], loaded, "Supported", "Refuted", ["missing_keys", "unexpected_keys", "eval_difference", "dropout_in_eval"]),
        ("the gate has collapsed to one level", ["gate_dominant_share"], c["gate_dominant_share"] > COLLAPSE, "Supported (flag)", "Refuted", ["gate_dominant_share"]),
        ("learned weights rank worse than the mean or the best level", ["learned_r10"], better, "Supported", "Refuted", ["learned_r10", "mean_r10", "max_r10"]),
    ]
    rows = []
    for place, (name, needs, holds, yes, no, shown) in enumerate(rules):
        known = F.lit(True)
        for n in needs:
            known = known & c[n].isNotNull()
        told = F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), F.coalesce(F.round(c[s], 6).cast("string"), F.lit("unknown"))) for s in shown])
        fields = [F.lit(place).alias("place"), F.lit(name).alias("hypothesis"), F.when(holds, yes).otherwise(no).alias("status"), told.alias("evidence")]
        rows.append(F.when(known, F.struct(*fields)))
    return row.select(F.inline(F.array_compact(F.array(*rows))))


def markdown(found: DataFrame, title: str = "Report of hypotheses") -> str:
    """The rows of hypotheses(), eight at most, as a Markdown table."""
    cells = [(r.hypothesis, r.status, r.evidence) for r in found.orderBy("place").collect()]
    return "\n".join([f"# {title}", "", "| hypothesis | status | evidence |", "|-|-|-|", *[f"| {' | '.join(r)} |" for r in cells], ""])
