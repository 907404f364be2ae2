"""Readers and writers of the record files: JSON lines, JSON documents, text sets, rewriter output.

JSON lines are parsed with a declared schema; a record's version and its set of keys are checked
besides, as a schema alone drops unknown keys silently.
"""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import content_sha256, strip

#: The version that is read, and the values that enumerated fields may have.
SCHEMA_VERSION = 1
ROLES = ("human_reference", "instruct_draft", "rewrite")
DIMENSIONS = ("overall", "clarity", "coherence", "creativity", "depth", "relevance")
ORDERS = ("model_first", "human_first")
CHOICES = ("A", "B", "invalid")

_OPEN = "map<string,string>"
#: Schemas of the entities, all with the version besides.
ENTITIES = {
    "pair": f"pair_id string, corpus string, prompt string, reference_text string, source {_OPEN}, register string, prompt_generator string, word_count int",
    "text_set": f"set_id string, role string, corpus string, pair_ids array<string>, provenance {_OPEN}, round int",
    "text": "pair_id string, text string",
    "bundle": (
        "run_id string, pair_id string, prompt string, draft struct<text:string,model_id:string,sampling:struct<temperature:double,top_p:double,seed:bigint>>, "
        "rounds array<struct<k:int,text:string,flags:array<string>,hard_tripped:boolean>>, final_round int, degeneration struct<empty:boolean,length_ratio:double,"
        "length_ratio_tripped:boolean,repetition_flagged:boolean,non_ascii_fraction:double,non_ascii_burst_tripped:boolean,hard_tripped:boolean,flags:array<string>>, "
        f"adapter_id string, config {_OPEN}, requested_k int"
    ),
    "verdict": "pair_id string, dimension string, judge_model string, order string, raw_response string, choice string, retry_count int, model_won boolean",
    "detector_score": "set_id string, pair_id string, text_sha string, human_prob double",
}
#: Keys a record may leave out.
OPTIONAL = {"text_set": ("provenance", "round"), "bundle": ("draft",), "verdict": ("model_won",)}
#: Records without a version field.
UNVERSIONED = ("text", "detector_score")


class RecordError(ValueError):
    """A record that can't be read as what it should be."""


def schema(entity: str) -> T.StructType:
    return T._parse_datatype_string(ENTITIES[entity])


def parsed(lines: DataFrame, entity: str) -> DataFrame:
    """``lines`` (value, ...) with record (a struct or null) and problem (null for a good record); blank lines are gone.

    Problems: ``json`` for no JSON object, ``version`` for a missing or other version, ``keys`` for
    unknown or missing keys, ``value`` for a value outside its enumeration.
    """
    known = [f.name for f in schema(entity)]
    versioned = entity not in UNVERSIONED
    allowed = F.array(*[F.lit(k) for k in [*known, "schema_version"]])
    needed = F.array(*[F.lit(k) for k in known if k not in OPTIONAL.get(entity, ())])
    keys = F.json_object_keys("value")
    record = F.from_json("value", schema(entity))
    problem = F.when(keys.isNull(), "json")
    if versioned:
        version = F.get_json_object("value", "$.schema_version")
        problem = problem.when(version.isNull() | (version != str(SCHEMA_VERSION)), "version")
    problem = problem.when((F.size(F.array_except(keys, allowed)) > 0) | (F.size(F.array_except(needed, keys)) > 0), "keys")
    bad = _bad_value(entity)
    if bad is not None:
        problem = problem.when(bad, "value")
    out = lines.where(F.char_length(strip("value")) > 0).withColumn("record", record)
    return out.withColumn("problem", problem)


def _bad_value(entity: str) -> Column | None:
    r = F.col("record")
    if entity == "text_set":
        wrong = ~r["role"].isin(*ROLES) | (F.coalesce(r["corpus"], F.lit("")) == "") | (r["round"].isNotNull() & (r["role"] != "rewrite"))
        return F.coalesce(wrong, F.lit(True))
    if entity == "verdict":
        return F.coalesce(~(r["dimension"].isin(*DIMENSIONS) & r["order"].isin(*ORDERS) & r["choice"].isin(*CHOICES)), F.lit(True))
    return None


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line_no): lines of JSON-lines files in order; the number rises within a file and may have gaps."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"))


def read_strict(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Records; the first bad line fails the read when it is reached."""
    rows = parsed(numbered(spark, path), entity)
    fail = F.raise_error(F.concat(F.lit(f"bad {entity} record ("), F.col("problem"), F.lit("): "), F.substring("value", 1, 200)))
    ok = rows.select(F.when(F.col("problem").isNotNull(), fail.cast(schema(entity))).otherwise(F.col("record")).alias("r"))
    return ok.select("r.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, in its own place."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return packed.select("r.*")


def read_tolerant(spark: SparkSession, path: str, entity: str, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(records with line_no, one row with the number of bad lines): bad lines are skipped, and the last record of a key stands."""
    rows = parsed(numbered(spark, path), entity)
    good = last_wins(rows.where("problem is null").select("record.*", "line_no"), key, "line_no")
    return good, rows.agg(F.count_if(F.col("problem").isNotNull()).alias("bad_lines"))


def count_bad(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that are no JSON at all; a key that comes twice is none."""
    lines = spark.read.text(path).where(F.char_length(strip("value")) > 0)
    return lines.agg(F.count_if(F.json_object_keys("value").isNull()).alias("bad_lines"))


def write_lines(df: DataFrame, path: str, entity: str | None = None, mode: str = "append") -> None:
    """Write or append records as JSON lines; the commit of the files takes the place of a flush."""
    out = df if entity is None or entity in UNVERSIONED else df.withColumn("schema_version", F.lit(SCHEMA_VERSION))
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_document(path: str | Path, required: tuple[str, ...] = ()) -> dict:
    """A one-record JSON file of the read version."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    if raw.get("schema_version") != SCHEMA_VERSION:
        raise RecordError(f"{path}: schema_version {raw.get('schema_version')!r}, not {SCHEMA_VERSION}")
    if missing := [k for k in required if k not in raw]:
        raise RecordError(f"{path}: without {missing}")
    return raw


def write_together(files: dict[str | Path, str]) -> None:
    """Write several small files or none: all are staged beside their places first, then moved; a failed move takes the others back."""
    staged: list[tuple[Path, Path]] = []
    moved: list[tuple[Path, bytes | None]] = []
    try:
        for path, text in files.items():
            final = Path(path)
            final.parent.mkdir(parents=True, exist_ok=True)
            temp = final.with_name(f".{final.name}.{os.getpid()}")
            staged.append((temp, final))
            temp.write_text(text, encoding="utf-8")
        for temp, final in staged:
            before = final.read_bytes() if final.exists() else None
            os.replace(temp, final)
            moved.append((final, before))
    except OSError:
        for final, before in moved:
            final.unlink(missing_ok=True) if before is None else final.write_bytes(before)
        for temp, _ in staged:
            with contextlib.suppress(OSError):
                temp.unlink()
        raise


def dump(record: dict) -> str:
    """Indented JSON; a number that isn't one becomes null."""
    clean: Callable = lambda v: (
        None if isinstance(v, float) and v != v else {k: clean(x) for k, x in v.items()} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list | tuple) else v
    )
    return json.dumps(clean(record), ensure_ascii=False, indent=2) + "\n"


def texts_path(manifest: str | Path, provenance: dict | None) -> Path:
    """The texts of a set: what its provenance names, seen from the manifest, else X.jsonl beside X.manifest.json."""
    manifest = Path(manifest)
    if named := (provenance or {}).get("texts_path"):
        return Path(named) if Path(named).is_absolute() else manifest.parent / named
    return manifest.with_name(manifest.name.removesuffix(".json").removesuffix(".manifest") + ".jsonl")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that come more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    if twice := [r[0] for r in duplicates(df, key).orderBy(key).limit(5).collect()]:
        raise RecordError(f"{key} comes more than once: {twice}")
    return df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, text) with unique ids; keys besides the two are allowed here."""
    rows = spark.read.schema("pair_id string, text string").option("mode", "FAILFAST").json(str(path))
    return require_unique(rows, "pair_id")


def read_set(spark: SparkSession, manifest: str | Path) -> tuple[dict, DataFrame]:
    """(manifest, its (pair_id, text, ord) in the manifest's order)."""
    raw = read_document(manifest, ("set_id", "role", "corpus", "pair_ids"))
    if raw["role"] not in ROLES or not raw["corpus"] or (raw.get("round") is not None and raw["role"] != "rewrite"):
        raise RecordError(f"{manifest}: role, corpus or round")
    ids = raw["pair_ids"]
    if len(ids) != len(set(ids)):
        raise RecordError(f"{manifest}: a pair_id comes more than once")
    texts = read_texts(spark, str(texts_path(manifest, raw.get("provenance"))))
    listed = spark.createDataFrame(list(enumerate(ids)), "ord int, pair_id string")
    if missing := [r[0] for r in listed.join(texts, "pair_id", "left_anti").limit(5).collect()]:
        raise RecordError(f"{manifest}: texts missing for {missing}")
    return raw, listed.join(texts, "pair_id").orderBy("ord")


def personal_documents(spark: SparkSession, paths: str) -> DataFrame:
    """(ord, path, text) of a comma-separated list of text files, in its order; bytes that are no UTF-8 become U+FFFD."""
    named = [p.strip() for p in paths.split(",") if p.strip()]
    if any("://" in p and not p.startswith(("file://", "hdfs://", "s3")) for p in named):
        raise RecordError("only paths are read; fetch web addresses first")
    one = lambda k, p: spark.read.text(p, wholetext=True).select(F.lit(k).alias("ord"), F.lit(p).alias("path"), F.col("value").alias("text"))
    out = [one(k, p) for k, p in enumerate(named)]
    if not out:
        raise RecordError("no path given")
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def rewriter_output(spark: SparkSession, path: str, ordered: DataFrame) -> DataFrame:
    """(pair_id, text) of a rewriter's Parquet, joined on source_row_index with ``ordered`` (ord, pair_id).

    Missing columns, an index that is out of range or comes twice, a pair without a row and a blank
    text are errors.
    """
    raw = spark.read.parquet(path)
    if missing := {"source_row_index", "output_text"} - set(raw.columns):
        raise RecordError(f"{path}: without {sorted(missing)}")
    out = raw.select(F.col("source_row_index").cast("int").alias("ord"), F.col("output_text").alias("text"))
    require_unique(out, "ord")
    if stray := out.join(ordered, "ord", "left_anti").limit(3).collect():
        raise RecordError(f"{path}: rows out of range: {[r['ord'] for r in stray]}")
    got = ordered.join(out, "ord", "left")
    if blank := got.where("text is null or " + "trim(text) = ''").limit(3).collect():
        raise RecordError(f"{path}: no text for {[r['pair_id'] for r in blank]}")
    return got.select("pair_id", "text")


def reference_set(pairs: DataFrame) -> DataFrame:
    """(pair_id, text) of a corpus' pairs; no pair and several corpora are errors."""
    corpora = [r[0] for r in pairs.select("corpus").distinct().limit(3).collect()]
    if len(corpora) != 1:
        raise RecordError(f"one corpus is needed, not {corpora}")
    return pairs.select("pair_id", F.col("reference_text").alias("text"))


def judge_templates(folder: str | Path) -> list[tuple[str, str, str]]:
    """(dimension, template, its SHA-256) of the six files, as they are; looked for in the folder and in those above it."""
    import hashlib

    start = Path(folder).resolve()
    for base in (start, *start.parents):
        if all((base / f"{d}.txt").is_file() for d in DIMENSIONS):
            return [(d, (raw := (base / f"{d}.txt").read_bytes()).decode(), hashlib.sha256(raw).hexdigest()) for d in DIMENSIONS]
    raise FileNotFoundError(f"no folder with the {len(DIMENSIONS)} judge templates at or above {start}")


def import_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Bundles without rounds from (pair_id, text[, prompt]) lines; bad JSON, a missing field, a blank text, an id that comes twice and no line are errors."""
    lines = spark.read.text(path).where(F.char_length(strip("value")) > 0)
    rows = lines.select(F.json_object_keys("value").alias("keys"), F.from_json("value", "pair_id string, text string, prompt string").alias("r")).select("keys", "r.*")
    bad = rows.where("keys is null or pair_id is null or text is null").limit(1).count() or rows.where(F.char_length(strip("text")) == 0).limit(1).count()
    if bad or rows.isEmpty():
        raise RecordError(f"{path}: drafts need a pair_id and a text that isn't blank in every line, and a line at least")
    require_unique(rows, "pair_id")
    return rows.select("pair_id", F.coalesce("prompt", F.lit("")).alias("prompt"), "text", content_sha256("text").alias("text_sha"))


def nascent_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of a run, ready to be rewritten; no bundle at all, and one without a draft, are errors."""
    good, _ = read_tolerant(spark, path, "bundle")
    if good.isEmpty():
        raise RecordError(f"{path}: no bundle")
    if lost := good.where("draft is null or draft.text is null").select("pair_id").limit(5).collect():
        raise RecordError(f"{path}: no draft for {[r[0] for r in lost]}")
    return good


def write_rounds(rounds: DataFrame, path: str) -> None:
    """(k, pair_id, text) sets, a folder a round; rounds that the frame lacks are gone afterwards."""
    rounds.write.mode("overwrite").partitionBy("k").parquet(path)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """As :func:`last_wins`, by window."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
