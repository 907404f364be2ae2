"""Reports, comparisons, noise bounds and their documents."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.text import format_delta, format_number
from driftline.operators.judging import DEFAULT_JUDGE

#: The sample size under which a report warns, and which way each metric is better.
SMALL_N = 30
METRICS = (("mmd", "lower_is_better"), ("token_l2", "lower_is_better"), ("jmq", "higher_is_better"))
#: Published rows (model, mmd, jmq, token_l2), measured elsewhere.
PUBLISHED = (
    ("14B SFT superbaseline", 0.037, 0.49, 0.0039),
    ("14B DFT", 0.018, 0.80, 0.0036),
    ("8B DFT", 0.023, 0.56, 0.0031),
    ("4B DFT", 0.025, 0.40, 0.0042),
)
PUBLISHED_CAVEAT = "Published under another protocol: other judge, harness and corpus; read differences as a direction only."
#: Costs in dollars, and the sum that asks for consent.
CALL_COST, TEXT_COST, COST_GATE = 0.0005, 0.01, 1.0
#: Fixed values: (mmd_min, mmd_max, token_l2_max) for stand-in instruments and the real embedder.
REAL_EMBEDDER = "nvidia/llama-embed-nemotron-8b"
STUB_BOUNDS, REAL_BOUNDS = (-0.10, 0.10, 0.10), (-0.05, 0.05, 0.08)
WINDOW_Z = 3.0


class BenchmarkRefused(ValueError):
    """Published rows beside a report that isn't known to be on a public corpus."""


class CostError(RuntimeError):
    """Costs over the gate without consent."""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def caveats(n: Column, ran_mmd: Column, ran_jmq: Column, judge: Column) -> Column:
    """Kinds of caveats of a report."""
    kinds = F.array(
        F.when(n < SMALL_N, "small_n"), F.when(ran_mmd, "mmd_bandwidth_comparability"), F.when(ran_jmq & (judge != DEFAULT_JUDGE), "non_default_judge")
    )
    return F.filter(kinds, lambda k: k.isNotNull())


def caveat_text(kind: str, n: int, judge: str) -> str:
    return {
        "small_n": f"N={n} is under {SMALL_N}: all metrics vary much at this size, so take their values as indications.",
        "mmd_bandwidth_comparability": "The published rows' kernel bandwidth is unknown, so absolute discrepancies compare only roughly; the one used is in the configuration.",
        "non_default_judge": f"Judged by {judge}, not {DEFAULT_JUDGE}: win rates compare only within one judge.",
    }[kind]


def delta(metric: Column, draft: Column, rewrite: Column) -> Column:
    """(draft, rewrite, delta, comparable, status, improved) of a metric by name."""
    d = rewrite - draft
    closer = F.when(metric == "jmq", d > 0).otherwise(d < 0)
    status = F.when(d == 0, "unchanged").when(closer, "improved").when(d.isNotNull(), "regressed")
    return F.struct(
        draft.alias("draft"), rewrite.alias("rewrite"), d.alias("delta"), d.isNotNull().alias("comparable"), status.alias("status"),
        F.when(d != 0, closer).alias("improved"),
    )


def unpivoted(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, value) of reports with the three metrics; NaN is null."""
    pairs = ", ".join(f"'{m}', nanvl({m}, null)" for m, _ in METRICS)
    return reports.select(*keys, F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, value)"))


def deltas(draft: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(report_id, metric, draft, rewrite, delta, comparable, status, improved): each rewrite's metrics less the draft's one report's."""
    d = unpivoted(draft, []).select("metric", F.col("value").alias("d"))
    r = unpivoted(rewrites, ["report_id"])
    return r.join(d, "metric").select("report_id", "metric", delta(F.col("metric"), F.col("d"), F.col("value")).alias("x")).select("report_id", "metric", "x.*")


def trajectory(rewrites: DataFrame) -> DataFrame:
    """Rewrites in order of round, those without one last as they came."""
    return rewrites.orderBy(F.col("round").asc_nulls_last(), "input_index")


def refuse_unconfirmed(reports: DataFrame) -> DataFrame:
    """Reports (report_id, corpus) beside which published rows may stand; a personal or unknown corpus is refused."""
    bad = [r["report_id"] for r in reports.where("corpus is null or corpus = 'personal'").orderBy("report_id").limit(10).collect()]
    if bad:
        raise BenchmarkRefused(f"published rows don't go beside reports on a personal or unknown corpus: {', '.join(bad)}")
    return reports


def published(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED), "model string, mmd double, jmq double, token_l2 double")


def window(n: Column) -> tuple[Column, Column]:
    """Bounds of a fair judge's win rate over n comparisons: three standard errors about a half."""
    half = WINDOW_Z * F.sqrt(F.lit(0.25) / n)
    return F.greatest(F.lit(0.0), 0.5 - half), F.least(F.lit(1.0), 0.5 + half)


def fair_window(n: int) -> tuple[float, float]:
    if n <= 0:
        raise ValueError(f"a window needs comparisons, not {n}")
    half = WINDOW_Z * math.sqrt(0.25 / n)
    return max(0.0, 0.5 - half), min(1.0, 0.5 + half)


def bounds_for(embedder: str | None) -> tuple[float, float, float]:
    return REAL_BOUNDS if embedder == REAL_EMBEDDER else STUB_BOUNDS


def violations(mmd: float, token_l2: float, win_rate: float | None, n: int | None, embedder: str | None = None, skip_judge: bool = False) -> list[str]:
    """All bounds that a half against the other half breaks; what is no number breaks its bound."""
    lo, hi, l2 = bounds_for(embedder)
    out = []
    if not mmd <= hi:
        out.append(f"mmd {mmd:.6g} is over {hi:g}")
    elif not mmd >= lo:
        out.append(f"mmd {mmd:.6g} is under {lo:g}")
    if not token_l2 <= l2:
        out.append(f"token_l2 {token_l2:.6g} is over {l2:g}")
    if not skip_judge:
        if win_rate is None or not n:
            out.append("the judge gave no valid verdict")
        else:
            a, b = fair_window(n)
            if not a <= win_rate <= b:
                out.append(f"win rate {win_rate:.4f} is outside [{a:.4f}, {b:.4f}] for n={n}")
    return out


def estimate(calls: int, each: float) -> dict:
    return {"calls": calls, "estimated_usd": calls * each, "threshold_usd": COST_GATE}


def gate(cost: dict, consent: bool) -> dict:
    if cost["estimated_usd"] > COST_GATE and not consent:
        raise CostError(f"estimated ${cost['estimated_usd']:.2f} is over ${COST_GATE:.2f}; say yes to go on")
    return cost


def report_document(r: dict) -> str:
    """A report in Markdown."""
    lines = [f"# Report {r['report_id']}", "", f"{r['compared']['candidate_set']} against {r['compared']['reference_set']}, N={r['compared']['n']}", "", "| setting | value |", "|-|-|"]
    lines += [f"| {k} | {v} |" for k, v in r["config"].items()]
    lines += ["", "| metric | value |", "|-|-|", f"| mmd | {format_number(r['mmd'])} |", f"| token_l2 | {format_number(r['token_l2'])} |"]
    if r["jmq"]:
        lines += ["", "| dimension | score | win rate | wins | losses | invalid |", "|-|-|-|-|-|-|"]
        lines += [f"| {d} | {format_number(x['score'])} | {format_number(x['win_rate'])} | {x['wins']} | {x['losses']} | {x['invalid']} |" for d, x in r["jmq"].items() if d != "bias_audit"]
        if audit := r["jmq"].get("bias_audit"):
            lines += ["", f"Model first in {audit['model_first']} of {audit['pairs']} pairs."]
    lines += ["", *(f"- {c['kind']}: {c['message']}" for c in r["caveats"])]
    return "\n".join(lines) + "\n"


def comparison_document(c: dict) -> str:
    """A comparison in Markdown."""
    lines = [f"# Comparison {c['comparison_id']}", "", "| report | round | mmd | token_l2 | jmq |", "|-|-|-|-|-|"]
    for r in [c["draft"], *c["rewrites"]]:
        lines.append(f"| {r['report_id']} | {r.get('round', '')} | " + " | ".join(format_number(r[m]) for m, _ in METRICS) + " |")
    for r in c["rewrites"]:
        lines += ["", f"## {r['report_id']}", "", *(f"- {m}: {format_delta(x['delta'], x['status'])}" for m, x in r["deltas"].items())]
    if c.get("trajectory"):
        lines += ["", "## By round", "", *(f"- k{t['round'] if t['round'] is not None else '?'}: " + ", ".join(f"{m} {format_number(t[m])}" for m, _ in METRICS) for t in c["trajectory"])]
    if c.get("benchmark"):
        lines += ["", "## Published", "", c["benchmark"]["caveat"], "", "| model | mmd | jmq | token_l2 |", "|-|-|-|-|", *(f"| {m} | {a} | {b} | {t} |" for m, a, b, t in c["benchmark"]["rows"])]
    return "\n".join(lines) + "\n"
