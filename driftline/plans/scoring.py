"""Whole runs: scoring one set against another, the self-check, the comparison of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import judging, metrics, progress, sampling, seams, setops
from driftline.plans import reports as rp
from driftline.session import intermediates
from driftline.sources import records
from driftline.streaming import incremental

#: The metrics in the order they are reported.
ALL_METRICS = ("mmd", "token_l2", "jmq")
#: Fixed value: what the judge is told instead of a prompt when halves of one set are compared, before the pair's name.
PLACEHOLDER = "self-check pair "


def selected(names: str) -> tuple[str, ...]:
    """Metrics of a comma-separated list, in order; an unknown one is an error."""
    asked = {n.strip() for n in names.split(",") if n.strip()}
    if not asked or (unknown := asked - set(ALL_METRICS)):
        raise ValueError(f"metrics are {', '.join(ALL_METRICS)}, not {', '.join(sorted(unknown)) if asked else 'none'}")
    return tuple(m for m in ALL_METRICS if m in asked)


def _sides(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    return candidate.select("pair_id", "text", F.lit("a").alias("side")).unionByName(reference.select("pair_id", "text", F.lit("b").alias("side")))


def embeddings(both: DataFrame, embedder: Callable | None) -> DataFrame:
    """(g, side, id, v) of both sides' texts; each content is embedded once."""
    keyed = both.withColumn("content_sha256", tx.content_sha256("text"))
    place = [F.lit(0).alias("g"), "side", F.concat("side", "pair_id").alias("id")]
    if embedder is None:
        return keyed.select(*place, seams.stub_embedding().alias("v"))
    made = seams.embedded(keyed.select("content_sha256", "text").dropDuplicates(["content_sha256"]), embedder).withColumnRenamed("vector", "v")
    return keyed.join(made, "content_sha256").select(*place, "v")


def score(
    candidate: DataFrame, reference: DataFrame, *, names: str = ",".join(ALL_METRICS), prompts: DataFrame | None = None, seed: int = 0, report_id: str = "report",
    sets: tuple[str, str] = ("candidate", "reference"), corpus: str | None = None, round_no: int | None = None, judge: Callable | None = None, judge_model: str = judging.DEFAULT_JUDGE,
    embedder: Callable | None = None, embedder_id: str = "stub", templates: dict[str, str] | None = None, verdicts_path: str | None = None, thresholds: dict | None = None,
    per_batch: int = progress.PER_BATCH, resume: bool = False,
) -> dict:
    """A report (a dict) of a candidate set of (pair_id, text) against a reference set; metrics that don't run are None.

    The sets must name the same pairs, with texts that aren't blank; that is checked before any model
    is called.  Verdicts are written batch by batch, so those that were finished outlive a failure;
    with ``resume`` they stand and only the others are asked for, else the log begins anew.
    """
    asked, started = selected(names), rp.now()
    n = setops.check_pairing(candidate, reference)
    both = _sides(candidate, reference)
    mmd = l2 = sigma = None
    jmq: dict = {}
    if "mmd" in asked:
        row = metrics.mmd2(embeddings(both, embedder), "g", "side", "v", "id").first()
        mmd, sigma = row["mmd2"], row["bandwidth"]
    if "token_l2" in asked:
        l2 = metrics.token_l2(both, []).first()["token_l2"]
    if "jmq" in asked:
        if judge is None or prompts is None or verdicts_path is None:
            raise ValueError("jmq needs a judge, prompts and a place for the verdicts")
        pairs = setops.joined_pairs(candidate, reference, prompts)
        if pairs.count() != n:
            raise setops.SetError("there is no prompt for some pairs")
        rendered = judging.rendered(judging.tasks(pairs, seed, by_generator=True), templates or {})
        if resume:
            done = incremental.have(candidate.sparkSession, verdicts_path, records.schema("verdict"), "json")
            rendered = rendered.join(done.select("pair_id", "dimension"), ["pair_id", "dimension"], "left_anti")
        with intermediates(candidate.sparkSession):
            for k, rows in enumerate(progress.batches(rendered, "pair_id", per_batch)):
                records.write_lines(judging.judged(rows, judge, judge_model), verdicts_path, "verdict", "append" if k or resume else "overwrite")
        jmq = judged_block(records.read_strict(candidate.sparkSession, verdicts_path, "verdict"))
    return assembled(report_id, sets, n, seed, judge_model, embedder_id, sigma, mmd, l2, jmq, "mmd" in asked, "jmq" in asked, corpus, round_no, thresholds, started)


def judged_block(v: DataFrame) -> dict:
    """Scores by dimension and the audit of positions, from verdicts alone."""
    cols = ("score", "win_rate", "wins", "losses", "invalid", "n")
    by = {r["dimension"]: {c: r[c] for c in cols} for r in judging.scores(v).collect()}
    return {d: by[d] for d in records.DIMENSIONS} | {"bias_audit": judging.order_audit(v).first().asDict()}


def assembled(report_id, sets, n, seed, judge_model, embedder_id, sigma, mmd, l2, jmq, ran_mmd, ran_jmq, corpus, round_no, thresholds, started) -> dict:
    kinds = [k for k, on in (("small_n", n < rp.SMALL_N), ("mmd_bandwidth_comparability", ran_mmd), ("non_default_judge", ran_jmq and judge_model != judging.DEFAULT_JUDGE)) if on]
    compared = {"candidate_set": sets[0], "reference_set": sets[1], "n": n} | ({"corpus": corpus} if corpus else {}) | ({"round": round_no} if round_no is not None else {})
    return {
        "report_id": report_id, "compared": compared,
        "config": {"seed": seed, "judge_model": judge_model, "embedder_id": embedder_id, "tokenizer_id": "whitespace", "mmd_bandwidth": sigma, "thresholds": thresholds or {}},
        "mmd": mmd, "token_l2": l2, "jmq": jmq, "caveats": [{"kind": k, "message": rp.caveat_text(k, n, judge_model)} for k in kinds],
        "timestamps": {"started": started, "finished": rp.now()}, "schema_version": records.SCHEMA_VERSION,
    }


def recomputed(spark: SparkSession, path: str, seed: int, sets: tuple[str, str], report_id: str, embedder_id: str = "stub", corpus: str | None = None) -> dict:
    """A report of persisted verdicts, without a call to any model; the judge is the one that they name."""
    v = records.read_strict(spark, path, "verdict")
    who = judging.judge_of(v).first()
    return assembled(report_id, sets, who["n"], seed, who["judge_model"], embedder_id, None, None, None, judged_block(v), False, True, corpus, None, None, rp.now())


def self_check(
    reference: DataFrame, *, seed: int = 0, skip_judge: bool = False, judge: Callable | None = None, embedder: Callable | None = None, embedder_id: str = "stub",
    templates: dict[str, str] | None = None, verdicts_path: str | None = None, judge_model: str = judging.DEFAULT_JUDGE,
) -> dict:
    """Half of a human set scored against the other half: values, bounds and every bound that is broken."""
    split, dropped = sampling.half_split_by_generator(reference, seed)
    pairs = sampling.split_pairs(split, reference)
    a, b = pairs.select("pair_id", F.col("model_text").alias("text")), pairs.select("pair_id", F.col("human_text").alias("text"))
    prompts = pairs.select("pair_id", F.concat(F.lit(PLACEHOLDER), F.col("pair_id")).alias("prompt"))
    report = score(
        a, b, names="mmd,token_l2" if skip_judge else "mmd,token_l2,jmq", prompts=prompts, seed=seed, report_id="self-check", sets=("half-a", "half-b"), judge=judge, judge_model=judge_model,
        embedder=embedder, embedder_id=embedder_id, templates=templates, verdicts_path=verdicts_path,
    )
    overall = report["jmq"].get("overall", {})
    rate, n = overall.get("win_rate"), overall.get("n")
    broken = rp.violations(report["mmd"], report["token_l2"], rate, n, embedder_id, skip_judge)
    return {
        "report": report, "mmd": report["mmd"], "token_l2": report["token_l2"], "jmq_win_rate": rate, "jmq_n": n, "jmq_window": rp.fair_window(n) if n else None,
        "half_size": report["compared"]["n"], "dropped_pair_id": dropped, "violations": broken,
    }


def value(report: dict, metric: str) -> float | None:
    """A metric of a report; jmq is the overall dimension's score."""
    x = report["jmq"].get("overall", {}).get("score") if metric == "jmq" else report[metric]
    return None if x is None or x != x else float(x)


def corpus_of(report: dict) -> str | None:
    c = report["compared"]
    return c.get("corpus") or ("personal" if any(str(c.get(k, "")).startswith("personal-") for k in ("candidate_set", "reference_set")) else None)


def compared(spark: SparkSession, draft: dict, rewrites: list[dict], comparison_id: str, with_published: bool = False) -> dict:
    """Draft and rewrites side by side with differences, by round if there are several, and published rows if asked for."""
    if not rewrites:
        raise ValueError("a comparison needs a rewrite")
    kind = "report_id string, input_index int, round int, corpus string, mmd double, token_l2 double, jmq double"
    rows = [(r["report_id"], k, r["compared"].get("round"), corpus_of(r), *(value(r, m) for m, _ in rp.METRICS)) for k, r in enumerate([draft, *rewrites])]
    df = spark.createDataFrame(rows, kind)
    if with_published:
        rp.refuse_unconfirmed(df)
    # reports may share an id, so deltas go by position
    numbered = df.withColumn("report_id", F.col("input_index").cast("string"))
    found = rp.deltas(numbered.where("input_index = 0"), numbered.where("input_index > 0")).collect()
    by = lambda k: {r["metric"]: {c: r[c] for c in ("draft", "rewrite", "delta", "improved", "status", "comparable")} for r in found if r["report_id"] == str(k)}
    plain = lambda r: {"report_id": r[0], "round": r[2], "corpus": r[3], "mmd": r[4], "token_l2": r[5], "jmq": r[6]}
    out = {"comparison_id": comparison_id, "metric_directions": dict(rp.METRICS), "draft": plain(rows[0]), "rewrites": [plain(r) | {"deltas": {m: by(r[1])[m] for m, _ in rp.METRICS}} for r in rows[1:]]}
    if len(rewrites) > 1:
        ordered = rp.trajectory(df.where("input_index > 0")).collect()
        out["trajectory"] = [{c: r[c] for c in ("round", "input_index", "report_id", "mmd", "token_l2", "jmq")} for r in ordered]
    if with_published:
        out["benchmark"] = {"caveat": rp.PUBLISHED_CAVEAT, "external_protocol": True, "rows": [list(r) for r in rp.PUBLISHED]}
    return out
