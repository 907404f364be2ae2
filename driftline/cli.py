"""The seven commands.  JSON goes to stdout, progress to stderr; see EXIT for the codes.

Models are behind factories that a caller of :func:`main` passes in; a command that needs one that is
absent ends as a missing dependency, before it reads or spends anything.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import cascade, detection, judging, progress, sampling, setops
from driftline.operators.seams import as_factory, in_flight
from driftline.plans import reports as rp
from driftline.plans import scoring
from driftline.session import build_session, cut
from driftline.sources import records
from driftline.streaming import incremental

#: Exit codes.
EXIT = {"ok": 0, "input": 2, "dependency": 3, "self_check": 4, "io": 5, "no_delta": 6}
#: The variable that holds each detector's key.
DETECTOR_KEYS = {"pangram": "PANGRAM_API_KEY", "gptzero": "GPTZERO_API_KEY"}

INPUT_ERRORS = (ValueError, KeyError, TypeError, rp.CostError, sampling.ShortageError, FileNotFoundError, PySparkException)


class Missing(RuntimeError):
    """A client, key or file that a command needs from outside."""


def say(message: str) -> None:
    print(message, file=sys.stderr)


def emit(record: dict) -> None:
    print(records.dump(record), end="")


def client(clients: dict[str, object], name: str) -> Callable:
    if name not in clients:
        raise Missing(f"no client for {name}")
    return as_factory(clients[name])


def templates(clients: dict[str, object]) -> dict[str, str]:
    if "templates" in clients:
        return clients["templates"]
    try:
        return {d: t for d, t, _ in records.judge_templates(os.getcwd())}
    except FileNotFoundError as e:
        raise Missing(str(e)) from e


def write_report(out: str | None, record: dict, document: str) -> None:
    if out:
        records.write_together({out: records.dump(record), Path(out).with_suffix(".md"): document})


def write_set(df: DataFrame, folder: str, set_id: str, role: str, corpus: str, round_no: int | None = None) -> str:
    """Texts and manifest of a set, in the order of the frame's ord."""
    rows = df.orderBy("ord").select("pair_id", "text")
    rows.write.mode("overwrite").json(f"{folder}/{set_id}.jsonl")
    # the manifest is one document that lists the ids
    ids = [r[0] for r in rows.select("pair_id").toLocalIterator()]
    manifest = {"set_id": set_id, "role": role, "corpus": corpus, "pair_ids": ids, "provenance": {"texts_path": f"{set_id}.jsonl"}, "schema_version": records.SCHEMA_VERSION}
    if round_no is not None:
        manifest["round"] = round_no
    path = f"{folder}/{set_id}.manifest.json"
    records.write_together({path: records.dump(manifest)})
    return path


def build_corpus(spark: SparkSession, a, clients) -> int:
    target = sampling.TIERS[a.tier]
    if a.corpus == "personal":
        if not a.source:
            raise ValueError("a personal corpus needs --source")
        docs = records.personal_documents(spark, a.source)
        rows = docs.select(F.col("ord").alias("position"), tx.strip("text").alias("text"), F.create_map(F.lit("path"), F.col("path")).alias("source")).where("text <> ''")
        rows = rows.withColumn("word_count", tx.word_count("text")).withColumn("register", F.lit("personal"))
    else:
        if not a.source:
            raise Missing("documents are read from a Parquet folder: --source")
        docs = spark.read.parquet(a.source)
        good = sampling.pool(sampling.qualified(docs), target, "doc_id")
        drawn = sampling.sample_by_generator(spark, good, target, a.seed, "doc_id")
        rows = drawn.select("position", "text", F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("source"), "word_count", tx.register(F.lit("")).alias("register"))
    planned = cut(rows.withColumn("pair_id", sampling.stable_id(a.corpus, F.col("position"))), "planned-pairs")
    folder = f"{a.out}/{a.corpus}"
    left = setops.remaining(planned, incremental.have(spark, f"{folder}/pairs", records.schema("pair")))
    try:
        rp.gate(rp.estimate(left.count(), rp.CALL_COST), a.yes)
    except rp.CostError as e:  # this command's own code
        raise Missing(str(e)) from e
    make = client(clients, "prompter")

    def run(frames):
        ask = make()
        for pdf in frames:
            yield pdf.assign(prompt=list(in_flight(lambda x: ask(x[0], x[1], judging.DEFAULT_JUDGE), zip(pdf["text"], pdf["instruction"], strict=True))))

    def prompted(rows: DataFrame) -> DataFrame:
        asked = rows.select("pair_id", "text", tx.prompt_variant(F.col("position")).alias("instruction"))
        made = asked.mapInPandas(run, "pair_id string, text string, instruction string, prompt string").select("pair_id", "prompt")
        return rows.join(made, "pair_id").select(
            "pair_id", F.lit(a.corpus).alias("corpus"), "prompt", F.col("text").alias("reference_text"), "source", "register", F.lit(judging.DEFAULT_JUDGE).alias("prompt_generator"), F.col("word_count").cast("int")
        )

    done = progress.append(planned, f"{folder}/pairs", records.schema("pair"), prompted, per_batch=a.batch, others=True)
    all_ = spark.read.schema(records.schema("pair")).parquet(f"{folder}/pairs")
    own = planned.select("pair_id", F.col("position").alias("ord")).join(records.reference_set(all_), "pair_id")
    manifest = write_set(own, folder, f"{a.corpus}-{a.tier}", "human_reference", a.corpus)
    emit({"command": "build-corpus", "status": "ok", "seed": a.seed, "pairs": own.count(), "already_done": done.before, "prompted": done.new, "manifest": manifest})
    return EXIT["ok"]


def generate(spark: SparkSession, a, clients) -> int:
    make = client(clients, "drafter")
    pairs = spark.read.schema(records.schema("pair")).parquet(a.corpus)
    corpora = [r[0] for r in pairs.select("corpus").distinct().limit(2).collect()]
    if len(corpora) != 1:
        raise records.RecordError(f"one corpus is needed, not {corpora}")
    store, kind = f"{a.out}/drafts", records.T._parse_datatype_string("pair_id string, text string, seed long")
    done = progress.append(pairs, store, kind, lambda rows: cascade.drafted(rows, make, a.seed, a.temperature, a.top_p), per_batch=a.batch)
    all_ = spark.read.schema(kind).parquet(store)
    n = all_.count()
    own = all_.withColumn("ord", F.col("pair_id"))
    manifest = write_set(own, a.out, f"{corpora[0]}-{n}-draft", "instruct_draft", corpora[0])
    # what is kept is committed whole, so there are no torn records to skip
    emit({"command": "generate", "status": "ok", "pairs": n, "already_done": done.before, "generated": done.new, "skipped_truncated": 0, "manifest": manifest})
    return EXIT["ok"]


def rewriter_ready(checkout: str | None, make: Callable) -> None:
    """The rewriter is there and answers, before anything is rewritten: its folder, where one is named, and a client that can be made."""
    if checkout and not Path(checkout).is_dir():
        raise Missing(f"no checkout of the rewriter at {checkout}")
    try:
        make()
    except Exception as e:
        raise Missing(f"the rewriter doesn't answer: {e}") from e


def _drafts(spark: SparkSession, a) -> tuple[DataFrame, int]:
    """(drafts, lines that were skipped): a file's, a run's own, or those of another program's bundle log in the run's folder."""
    log = Path(a.run or "", "bundles.jsonl")
    if a.draft_file:
        return records.import_drafts(spark, a.draft_file), 0
    if not log.exists():
        return spark.read.parquet(f"{a.run}/drafts"), 0
    good = records.nascent_bundles(spark, str(log))
    return good.select("pair_id", "prompt", F.col("draft.text").alias("text")), records.read_tolerant(spark, str(log), "bundle")[1].first()["bad_lines"]


def rewrite(spark: SparkSession, a, clients) -> int:
    cascade.check_rounds(a.rounds)
    if bool(a.run) == bool(a.draft_file):
        raise ValueError("give one of --run and --draft-file")
    make = client(clients, "rewriter")
    rewriter_ready(a.hip_repo, make)
    drafts, skipped = _drafts(spark, a)
    corpora = [r[0] for r in drafts.select(tx.corpus_of("pair_id")).distinct().limit(2).collect()]
    if len(corpora) != 1:
        raise records.RecordError(f"drafts of one corpus are needed, not {corpora}")

    def rewritten(rows: DataFrame) -> DataFrame:
        return cascade.run(rows, make, a.rounds, lambda df, k: cut(df, f"rounds-k{k}")).where("k > 0")

    store, kind = f"{a.out}/rounds", f"pair_id string, text string, report {tx.DEGENERATION}, k int"
    done = progress.append(drafts.select("pair_id", "text"), store, kind, rewritten, per_batch=a.batch, partition_by=["k"])
    out = spark.read.schema(kind).parquet(store)
    n, sets = drafts.count(), []
    for k in range(1, a.rounds + 1):
        good = out.where((F.col("k") == k) & ~F.col("report.hard_tripped")).withColumn("ord", F.col("pair_id"))
        if not good.isEmpty():
            sets.append(write_set(good, a.out, f"{corpora[0]}-{n}-rewrite-k{k}", "rewrite", corpora[0], k))
    for old in Path(a.out).glob("*-rewrite-k*.manifest.json"):
        if int(old.name.removesuffix(".manifest.json").rpartition("-k")[2]) > a.rounds:
            old.unlink()
    flagged = out.where("report.hard_tripped").count()
    emit({"command": "rewrite", "status": "ok", "pairs": n, "already_done": done.before, "rewritten": done.new, "skipped_truncated": skipped, "flagged_degenerate": flagged, "adapter": a.adapter, "seed_applied": False, "sets": sets})
    return EXIT["ok"]


def score(spark: SparkSession, a, clients) -> int:
    out_id = Path(a.out).stem if a.out else None
    if a.recompute_jmq_from:
        if "://" not in a.recompute_jmq_from and not Path(a.recompute_jmq_from).exists():
            raise Missing(f"no verdicts at {a.recompute_jmq_from}")
        corpus = None
        if Path(a.candidate).is_file():
            corpus = records.read_document(a.candidate).get("corpus")
        report = scoring.recomputed(spark, a.recompute_jmq_from, a.seed, (a.candidate, a.reference), out_id or "recompute", a.embedder, corpus)
    else:
        asked = scoring.selected(a.metrics)
        cm, cand = records.read_set(spark, a.candidate)
        rm, ref = records.read_set(spark, a.reference)
        n = setops.check_pairing(cand, ref)
        extra: dict = {}
        if "jmq" in asked:
            extra["thresholds"] = rp.gate(rp.estimate(6 * n, rp.CALL_COST), a.yes)
            if not a.prompts:
                raise ValueError("jmq needs --prompts")
            extra |= {
                "prompts": spark.read.parquet(a.prompts).select("pair_id", "prompt"), "judge": client(clients, "judge"), "verdicts_path": str(Path(a.out or "results/report.json").parent / "verdicts.jsonl"),
                "templates": templates(clients),
            }
        embedder = client(clients, "embedder") if "mmd" in asked and a.embedder != "stub" else None
        report = scoring.score(
            cand, ref, names=a.metrics, seed=a.seed, report_id=out_id or f"{cm['set_id']}-vs-{rm['set_id']}", sets=(cm["set_id"], rm["set_id"]), corpus=cm["corpus"], round_no=cm.get("round"),
            judge_model=a.judge, embedder=embedder, embedder_id=a.embedder, per_batch=a.batch, resume=a.resume, **extra,
        )
    write_report(a.out, report, rp.report_document(report))
    emit(report)
    return EXIT["ok"]


def self_check(spark: SparkSession, a, clients) -> int:
    _, ref = records.read_set(spark, a.reference)
    extra = {} if a.skip_jmq else {"judge": client(clients, "judge"), "templates": templates(clients), "verdicts_path": a.verdicts}
    result = scoring.self_check(ref, seed=a.seed, skip_judge=a.skip_jmq, **extra)
    emit({"command": "self-check", "status": "failed" if result["violations"] else "ok"} | result)
    return EXIT["self_check"] if result["violations"] else EXIT["ok"]


def detect(spark: SparkSession, a, clients) -> int:
    key = DETECTOR_KEYS[a.detector]
    if not os.environ.get(key):
        raise Missing(f"{key} is not set")
    if not a.out.endswith(".json"):
        raise ValueError("--out must end in .json")
    texts, counts = None, []
    for path in a.sets:
        m, df = records.read_set(spark, path)
        counts.append({"set_id": m["set_id"], "texts": len(m["pair_ids"])})
        if not m["pair_ids"]:
            raise ValueError(f"{path} is empty")
        one = df.select(F.lit(m["set_id"]).alias("set_id"), F.lit(m["role"]).alias("role"), "pair_id", "text")
        texts = one if texts is None else texts.unionByName(one)
    cost = rp.gate(rp.estimate(sum(c["texts"] for c in counts), rp.TEXT_COST), a.yes)
    make = client(clients, "detector")
    try:
        scores = detection.scored(texts, make).toPandas()
    except PySparkException as e:
        raise Missing(f"a detector call failed: {str(e)[:300]}") from e
    rows = spark.createDataFrame(scores, "set_id string, role string, pair_id string, text_sha string, human_prob double")
    sets = [r.asDict(recursive=True) for r in detection.nested(rows).collect()]
    rise = detection.rise(detection.summary(rows, ["set_id", "role"])).first().asDict()
    delta = rise | {"threshold": detection.RISE} if rise["delta"] is not None else None
    report = {
        "report_id": Path(a.out).stem, "detector": a.detector, "seed": a.seed, "n_sets": len(sets), "sets": sets, "sc005": delta, "cost": cost | {"per_set": counts},
        "caveats": [] if delta else [{"kind": "sc005_not_computed", "message": "needs exactly one draft set and one rewrite set"}], "timestamps": {"finished": rp.now()}, "schema_version": records.SCHEMA_VERSION,
    }
    lines = "".join(json.dumps({k: r[k] for k in ("set_id", "pair_id", "text_sha", "human_prob")}, ensure_ascii=False) + "\n" for r in scores.to_dict("records"))
    beside = a.out.removesuffix(".json") + ".scores.jsonl"
    records.write_together({beside: lines, a.out: records.dump(report)})
    lost = len(a.sets) >= 2 and delta is None
    emit({"command": "detect", "status": "sc005_not_computed" if lost else "ok", "detector": a.detector, "n_sets": len(sets), "out": a.out, "scores": beside, "sc005": delta})
    return EXIT["no_delta"] if lost else EXIT["ok"]


def report(spark: SparkSession, a, clients) -> int:
    need = ("report_id", "compared", "mmd", "token_l2", "jmq")
    draft, rewrites = records.read_document(a.draft_report, need), [records.read_document(p, need) for p in a.rewrite_report]
    c = scoring.compared(spark, draft, rewrites, Path(a.out).stem if a.out else f"{draft['report_id']}-comparison", a.benchmark)
    write_report(a.out, c, rp.comparison_document(c))
    emit(c)
    return EXIT["ok"]


COMMANDS = {"build-corpus": build_corpus, "generate": generate, "rewrite": rewrite, "score": score, "self-check": self_check, "detect": detect, "report": report}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftline", description="Build corpora, draft, rewrite, score and compare text sets.")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--batch", type=int, default=progress.PER_BATCH, help="calls whose results are kept together: what a run that fails may lose")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("build-corpus")
    c.add_argument("--tier", choices=list(sampling.TIERS), default="smoke")
    c.add_argument("--corpus", default="fineweb", choices=["fineweb", "personal"])
    c.add_argument("--source")
    c.add_argument("--out", default="data/corpus")
    c.add_argument("--yes", action="store_true")
    c = sub.add_parser("generate")
    c.add_argument("--corpus", required=True)
    c.add_argument("--model", default="stub")
    c.add_argument("--temperature", type=float, default=0.7)
    c.add_argument("--top-p", type=float, default=0.95)
    c.add_argument("--out", default="results/run")
    c = sub.add_parser("rewrite")
    c.add_argument("--run")
    c.add_argument("--draft-file")
    c.add_argument("--adapter", default="stub")
    c.add_argument("--hip-repo", help="checkout of the rewriter; checked before anything is rewritten")
    c.add_argument("--rounds", type=int, default=cascade.ROUNDS_DEFAULT)
    c.add_argument("--temperature", type=float, default=1.0)
    c.add_argument("--top-p", type=float, default=0.95)
    c.add_argument("--out", default="results/run")
    c = sub.add_parser("score")
    c.add_argument("--candidate", required=True)
    c.add_argument("--reference", required=True)
    c.add_argument("--metrics", default=",".join(scoring.ALL_METRICS))
    c.add_argument("--judge", default=judging.DEFAULT_JUDGE)
    c.add_argument("--embedder", default="stub")
    c.add_argument("--out")
    c.add_argument("--recompute-jmq-from")
    c.add_argument("--resume", action="store_true", help="keep the verdicts that the log has, and ask for the others only")
    c.add_argument("--prompts")
    c.add_argument("--yes", action="store_true")
    c = sub.add_parser("self-check")
    c.add_argument("--reference", required=True)
    c.add_argument("--skip-jmq", action="store_true")
    c.add_argument("--verdicts", default="results/self-check.jsonl")
    c = sub.add_parser("detect")
    c.add_argument("--sets", nargs="+", required=True)
    c.add_argument("--detector", choices=list(DETECTOR_KEYS), default="pangram")
    c.add_argument("--out", default="results/reports/detect.json")
    c.add_argument("--yes", action="store_true")
    c = sub.add_parser("report")
    c.add_argument("--draft-report", required=True)
    c.add_argument("--rewrite-report", action="append", required=True)
    c.add_argument("--benchmark", action="store_true")
    c.add_argument("--out")
    return p


def main(argv: list[str] | None = None, clients: dict[str, object] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command is None:
        parser().print_help(sys.stderr)
        return EXIT["input"]
    try:
        return COMMANDS[a.command](spark or build_session(), a, clients or {})
    except Missing as e:
        say(f"{a.command}: {e}")
        return EXIT["dependency"]
    except INPUT_ERRORS as e:
        say(f"{a.command}: {str(e)[:800]}")
        return EXIT["input"]
    except OSError as e:
        say(f"{a.command}: could not write: {e}")
        return EXIT["io"]


if __name__ == "__main__":
    raise SystemExit(main())
