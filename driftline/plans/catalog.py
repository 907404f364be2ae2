"""The registered queries over the input tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import cascade, detection, judging, metrics, sampling, seams, setops
from driftline.plans import bindings as b
from driftline.plans import reports as rp
from driftline.session import cut, fresh_path
from driftline.sources import records
from driftline.sources.records import DIMENSIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 7


def query(sql: str | None = None, views: bool = False):
    """Register a query under its function's name; ``views``: the SQL goes on from the domain views."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = b.SQL + sql if views else sql
        return fn

    return put


def sub(sql: str, x: str) -> str:
    """SQL with its place {0} filled; other braces stay."""
    return sql.replace("{0}", x)


# --- text expressions ---------------------------------------------------------------------------

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = f"len(regexp_extract_all(text, '[^{_WS}]+'))"
_NON_ASCII = r"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text)::DOUBLE END"
_MARKERS = "|".join(tx.BOILERPLATE)
_LINES = rf"list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: length(regexp_replace(x, '[{_WS}]', '', 'g')) > 0)"
_BOILER = f"CASE WHEN len({_LINES}) > 0 THEN len(list_filter({_LINES}, lambda x: regexp_matches(lower(x), '{_MARKERS}'))) / len({_LINES})::DOUBLE END"
_STRIP = f"regexp_replace(coalesce(text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {_WORDS}::BIGINT AS word_count FROM documents")
def doc_word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.word_count("text").alias("word_count"))


@query(f"SELECT doc_id, round({_NON_ASCII}, 9) AS fraction, coalesce({_NON_ASCII} <= 0.10, false) AS looks_english FROM documents")
def doc_looks_english(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(tx.non_ascii_fraction("text"), 9).alias("fraction"), tx.looks_english("text").alias("looks_english"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def doc_sha256(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.content_sha256("text").alias("sha"))


@query(f"SELECT doc_id, round({_BOILER}, 9) AS fraction, coalesce({_BOILER} > 0.30, true) AS heavy FROM documents")
def doc_boilerplate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(tx.boilerplate_fraction("text"), 9).alias("fraction"), tx.boilerplate_heavy("text").alias("heavy"))


@query("SELECT doc_id, 'documents' AS dataset, source AS config, CASE WHEN doc_id IS NULL THEN 'index-' || coalesce(n_chars, 0) ELSE doc_id::VARCHAR END AS origin FROM documents")
def doc_provenance(spark, sf_dir):
    p = tx.provenance("documents", "", F.col("doc_id"), F.lit(None), F.coalesce("n_chars", F.lit(0)))
    return docs(spark, sf_dir).select("doc_id", p.alias("p"), "source").select("doc_id", F.col("p.dataset").alias("dataset"), F.col("source").alias("config"), F.col("p.doc_id").alias("origin"))


@query("SELECT page_id, CASE WHEN contains(lower(coalesce(url, '')), 'news') THEN 'news' ELSE 'blog' END AS register FROM pages")
def page_register(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", tx.register("url").alias("register"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS slug FROM pages")
def page_slug(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", tx.slug("url").alias("slug"))


_QUALIFIED = f"""
WITH s AS (SELECT doc_id, lang, source, {_STRIP} AS text FROM documents),
w AS (SELECT *, {_WORDS}::BIGINT AS word_count FROM s WHERE length(text) > 0),
qualified AS (
  SELECT * FROM w WHERE word_count BETWEEN 150 AND 1200 AND coalesce(lang = 'en', {_NON_ASCII} <= 0.10) AND NOT coalesce({_BOILER} > 0.30, true)
)
"""


@query(_QUALIFIED + "SELECT doc_id, word_count, sha256(text) AS sha FROM qualified")
def qualified_docs(spark, sf_dir):
    return sampling.qualified(docs(spark, sf_dir)).select("doc_id", "word_count", tx.content_sha256("text").alias("sha"))


@query(_QUALIFIED + "SELECT source, count(*) AS docs, sum(word_count)::BIGINT AS words FROM qualified GROUP BY source")
def qualified_by_source(spark, sf_dir):
    return sampling.qualified(docs(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("docs"), F.sum("word_count").alias("words"))


@query(_QUALIFIED + "SELECT doc_id, word_count FROM qualified ORDER BY doc_id LIMIT 500")
def corpus_pool(spark, sf_dir):
    return sampling.pool(sampling.qualified(docs(spark, sf_dir)), 50, "doc_id").select("doc_id", "word_count")


_SAMPLE = _QUALIFIED + f"""
, pool AS (SELECT * FROM qualified ORDER BY doc_id LIMIT 500),
drawn AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS position FROM pool QUALIFY position < 50)
"""


@query(_SAMPLE + "SELECT doc_id, position::INTEGER AS position FROM drawn")
def corpus_sample_hash(spark, sf_dir):
    pool = sampling.pool(sampling.qualified(docs(spark, sf_dir)), 50, "doc_id")
    return sampling.sample_by_hash(pool, 50, SEED, "doc_id").select("doc_id", "position")


@query()
def corpus_sample_mersenne(spark, sf_dir):
    pool = sampling.pool(sampling.qualified(docs(spark, sf_dir)), 50, "doc_id")
    return sampling.sample_by_generator(spark, pool, 50, SEED, "doc_id").select("doc_id", "position")


_VARIANTS = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in tx.PROMPT_VARIANTS) + "]"


@query(_SAMPLE + f"""SELECT printf('web-%05d', position) AS pair_id, doc_id, word_count, ({_VARIANTS})[position % 4 + 1] AS instruction,
       'Write about: ' || array_to_string(regexp_extract_all(text, '[^{_WS}]+')[1:8], ' ') AS prompt FROM drawn""")
def corpus_pairs_smoke(spark, sf_dir):
    pool = sampling.pool(sampling.qualified(docs(spark, sf_dir)), 50, "doc_id")
    drawn = sampling.sample_by_hash(pool, 50, SEED, "doc_id")
    return drawn.select(
        sampling.stable_id("web", F.col("position")).alias("pair_id"), "doc_id", "word_count", tx.prompt_variant(F.col("position")).alias("instruction"),
        F.concat(F.lit("Write about: "), F.array_join(F.slice(tx.words("text"), 1, 8), " ")).alias("prompt"),
    )


_STARTS = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{_WS}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: lower(regexp_extract(s, '([A-Za-z'']+)', 1))), lambda w: w <> '')"


def _runs(source: str, keys: str) -> str:
    """Longest runs of equal sentence starts, by gaps and islands."""
    return f"""
starts AS (SELECT {keys}, unnest({_STARTS}) AS w, generate_subscripts({_STARTS}, 1) AS i FROM {source}),
islands AS (SELECT {keys}, w, i - row_number() OVER (PARTITION BY {keys}, w ORDER BY i) AS g FROM starts),
runs AS (SELECT {keys}, max(n)::INTEGER AS run FROM (SELECT {keys}, w, g, count(*) AS n FROM islands GROUP BY ALL) GROUP BY {keys})
"""


@query("WITH " + _runs("documents", "doc_id") + "SELECT d.doc_id, coalesce(run, 0)::INTEGER AS run FROM documents d LEFT JOIN runs USING (doc_id)")
def doc_repetition_run(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.repetition_run("text").cast("int").alias("run"))


_CHECKS = """
CASE WHEN blank THEN NULL ELSE ratio END AS length_ratio,
CASE WHEN blank THEN 0.0 ELSE fraction END AS non_ascii_fraction,
coalesce(blank OR ratio < 0.5 OR ratio > 2.0 OR fraction > 0.05, fraction > 0.05, false) AS hard_tripped,
CASE WHEN blank THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN ratio < 0.5 OR ratio > 2.0 THEN 'length_ratio' END,
  CASE WHEN fraction > 0.05 THEN 'non_ascii_burst' END, CASE WHEN run >= 3 THEN 'repetition' END], lambda x: x IS NOT NULL), ',') END AS flags
"""


@query("WITH " + _runs("documents", "doc_id") + f""", m AS (
  SELECT doc_id, length({_STRIP}) = 0 AS blank, length(text) / 1000.0::DOUBLE AS ratio, {_NON_ASCII} AS fraction, coalesce(run, 0) AS run FROM documents LEFT JOIN runs USING (doc_id)
), c AS (SELECT doc_id, {_CHECKS} FROM m)
SELECT doc_id, round(length_ratio, 9) AS length_ratio, round(non_ascii_fraction, 9) AS non_ascii_fraction, hard_tripped, flags FROM c""")
def doc_degeneration(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", tx.degeneration("text", F.lit(1000)).alias("r"))
    return d.select(
        "doc_id", F.round("r.length_ratio", 9).alias("length_ratio"), F.round("r.non_ascii_fraction", 9).alias("non_ascii_fraction"), F.col("r.hard_tripped").alias("hard_tripped"),
        F.array_join("r.flags", ",").alias("flags"),
    )


@query()
def pair_seed_blake2b(spark, sf_dir):
    return b.pairs(spark, sf_dir).select("pair_id", tx.pair_seed("pair_id", SEED).alias("seed"))


@query("SELECT pair_id, regexp_replace(pair_id, '-[^-]*$', '') AS corpus FROM pairs", views=True)
def pair_corpus(spark, sf_dir):
    return b.pairs(spark, sf_dir).select("pair_id", tx.corpus_of("pair_id").alias("corpus"))


# --- gates and joins of sets --------------------------------------------------------------------


@query("""SELECT coalesce(d.pair_id, r.pair_id) AS pair_id, CASE WHEN r.pair_id IS NULL THEN 'candidate' ELSE 'reference' END AS side
FROM drafts d FULL JOIN refs r ON d.pair_id = r.pair_id WHERE d.pair_id IS NULL OR r.pair_id IS NULL""", views=True)
def set_id_diff(spark, sf_dir):
    return setops.id_difference(b.drafts(spark, sf_dir), b.references(spark, sf_dir))


@query(f""", c AS (SELECT count(*) AS n_candidate, count_if(length({_STRIP}) < 1) AS short_candidate FROM drafts),
r AS (SELECT count(*) AS n_reference, count_if(length({_STRIP}) < 1) AS short_reference FROM refs),
d AS (SELECT count_if(r.pair_id IS NULL) AS only_candidate, count_if(d.pair_id IS NULL) AS only_reference FROM drafts d FULL JOIN refs r ON d.pair_id = r.pair_id)
SELECT n_candidate, short_candidate::BIGINT AS short_candidate, n_reference, short_reference::BIGINT AS short_reference, only_candidate::BIGINT AS only_candidate,
       only_reference::BIGINT AS only_reference, CASE WHEN n_candidate <> n_reference THEN 'count' WHEN only_candidate + only_reference > 0 THEN 'pairing'
       WHEN n_candidate < 2 THEN 'min_n' WHEN short_candidate + short_reference > 0 THEN 'length' END AS failed FROM c, r, d""", views=True)
def set_pairing_gate(spark, sf_dir):
    return setops.pairing_gate(b.drafts(spark, sf_dir), b.references(spark, sf_dir))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return records.duplicates(docs(spark, sf_dir), "text")


@query("SELECT pair_id, d.text AS model_text, r.text AS human_text FROM drafts d JOIN refs r USING (pair_id)", views=True)
def align_common_pairs(spark, sf_dir):
    c, r = setops.align_common(b.drafts(spark, sf_dir), b.references(spark, sf_dir))
    return c.withColumnRenamed("text", "model_text").join(r.withColumnRenamed("text", "human_text"), "pair_id")


@query("SELECT pair_id FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM drafts)", views=True)
def resume_remaining(spark, sf_dir):
    return setops.remaining(b.pairs(spark, sf_dir), b.drafts(spark, sf_dir)).select("pair_id")


@query(", q AS (SELECT printf('web-%05d', doc_id) AS pair_id FROM labels WHERE quality = 1) SELECT pair_id FROM drafts WHERE pair_id NOT IN (SELECT pair_id FROM q)", views=True)
def drift_strays(spark, sf_dir):
    planned = b.table(spark, sf_dir, "labels").where("quality = 1").select(b.pair_id(F.col("doc_id")).alias("pair_id"))
    return setops.strays(b.drafts(spark, sf_dir), planned).select("pair_id")


@query("SELECT text, count(DISTINCT source) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def homogeneity_violations(spark, sf_dir):
    """Texts that come from more than one source."""
    return docs(spark, sf_dir).groupBy("text").agg(F.count_distinct("source").alias("n")).where("n > 1").select("text", "n")


@query("""WITH cache AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE lang = 'en')
SELECT DISTINCT sha256(text) AS content_sha256 FROM documents WHERE sha256(text) NOT IN (SELECT s FROM cache)""")
def emb_cache_misses(spark, sf_dir):
    d = docs(spark, sf_dir)
    cache = d.where("lang = 'en'").select(F.lit("stub").alias("embedder_id"), tx.content_sha256("text").alias("content_sha256")).distinct()
    return setops.cache_misses(d, cache, "stub").select("content_sha256")


@query("""WITH c AS (SELECT label AS embedder_id, vec_id, len(embedding) AS d, (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0)::INTEGER AS odd FROM embeddings)
SELECT embedder_id::VARCHAR AS embedder_id, count(*) AS entries, (count(*) - count(DISTINCT vec_id))::BIGINT AS twice, (max(d) - min(d))::INTEGER AS dim_spread, sum(odd)::BIGINT AS not_finite FROM c GROUP BY embedder_id""")
def emb_cache_audit(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings")
    cache = e.select(F.col("label").cast("string").alias("embedder_id"), F.col("vec_id").cast("string").alias("content_sha256"), F.col("embedding").alias("vector"))
    return setops.cache_audit(cache)


@query("SELECT doc_id, sha256(text) AS content_sha256, 8::INTEGER AS dim FROM documents")
def emb_cache_round(spark, sf_dir):
    """All documents through the cache twice; the second time nothing is embedded."""
    from driftline.operators import cache

    path = fresh_path(spark, "embeddings")
    d = docs(spark, sf_dir).select("doc_id", "text")
    first = cache.embed(d, path, "stub", seams.stub_embedder, "doc_id")
    again = cache.embed(d, path, "stub", seams.no_embedder, "doc_id")
    both = first.withColumnRenamed("vector", "v").join(again, "doc_id").where("v = vector")
    return both.join(d, "doc_id").select("doc_id", tx.content_sha256("text").alias("content_sha256"), F.size("vector").alias("dim"))


# --- judging ------------------------------------------------------------------------------------

_TEMPLATE = "Judge {dimension}.\nPrompt: {prompt}\nA: {candidate_a}\nB: {candidate_b}\nReturn only A or B."


def templates() -> dict[str, str]:
    return {d: _TEMPLATE.replace("{dimension}", d) for d in DIMENSIONS}


def joined(spark, sf_dir):
    return setops.joined_pairs(b.drafts(spark, sf_dir), b.references(spark, sf_dir), b.pairs(spark, sf_dir))


_DIMS = "(SELECT unnest(['" + "', '".join(DIMENSIONS) + "']) AS dimension)"
_UNIT = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_ORDER = f"CASE WHEN {_UNIT.format(f"'{SEED}:' || pair_id")} < 0.5 THEN 'model_first' ELSE 'human_first' END"
_JUDGE = f"""
, jp AS (SELECT pair_id, prompt, d.text AS model_text, reference_text AS human_text FROM drafts d JOIN pairs USING (pair_id)),
jt AS (SELECT *, {_ORDER} AS "order" FROM jp, {_DIMS})
"""
_REPLY = "CASE WHEN substr(md5({0}), 1, 1) < '6' THEN 'A' WHEN substr(md5({0}), 1, 1) < 'c' THEN 'b. ' ELSE 'unclear' END"
_CHOICE = f"coalesce(nullif(upper(regexp_extract({{0}}, '^[{_WS}]*([ABab])[{_WS}]*\\.*[{_WS}]*$', 1)), ''), 'invalid')"
_WON = "CASE WHEN choice = 'invalid' THEN NULL WHEN \"order\" = 'model_first' THEN choice = 'A' ELSE choice = 'B' END"
_VERDICTS = _JUDGE + f""", jr AS (SELECT *, {_REPLY.format(f"'{SEED}:' || pair_id || ':' || dimension")} AS raw_response FROM jt),
jc AS (SELECT *, {sub(_CHOICE, "raw_response")} AS choice FROM jr), verdicts AS (SELECT *, {_WON} AS model_won FROM jc)
"""


@query(_JUDGE + "SELECT * FROM jp", views=True)
def judge_pairs(spark, sf_dir):
    return joined(spark, sf_dir)


@query(_JUDGE + 'SELECT pair_id, dimension, "order" FROM jt', views=True)
def judge_tasks(spark, sf_dir):
    return judging.tasks(joined(spark, sf_dir), SEED).select("pair_id", "dimension", "order")


_T = "'Judge ' || dimension || '.' || chr(10) || 'Prompt: {prompt}' || chr(10) || 'A: {candidate_a}' || chr(10) || 'B: {candidate_b}' || chr(10) || 'Return only A or B.'"


@query(_JUDGE + f"""SELECT pair_id, dimension, sha256(replace(replace(replace({_T}, '{{prompt}}', prompt),
  '{{candidate_a}}', CASE WHEN "order" = 'model_first' THEN model_text ELSE human_text END), '{{candidate_b}}', CASE WHEN "order" = 'model_first' THEN human_text ELSE model_text END)) AS sha FROM jt""", views=True)
def judge_render(spark, sf_dir):
    r = judging.rendered(judging.tasks(joined(spark, sf_dir), SEED), templates())
    return r.select("pair_id", "dimension", tx.content_sha256("rendered").alias("sha"))


@query(f'SELECT pair_id, {_ORDER} AS "order" FROM pairs', views=True)
def judge_order_hash(spark, sf_dir):
    return b.pairs(spark, sf_dir).select("pair_id", tx.order_by_hash("pair_id", SEED).alias("order"))


@query()
def judge_order_mersenne(spark, sf_dir):
    return b.pairs(spark, sf_dir).select("pair_id", tx.order_by_mersenne("pair_id", SEED).alias("order"))


#: Ways to say a letter, or not to; each task gets one of them, with its own letter in place of the tilde.
_REPLIES = ("~", " ~ ", "~.", "~.\n", "", "The answer is ~", "A or B", "~..", "~. .", " ~ ", "~B", ".", "~?")
_SAYS = "[" + ", ".join("'" + r.replace("\n", "' || chr(10) || '") + "'" for r in _REPLIES) + "]"


@query(_JUDGE + f""", said AS (SELECT pair_id, dimension, ('0x' || substr(md5(pair_id || dimension), 1, 4))::INTEGER AS h FROM jt),
r AS (SELECT pair_id, dimension, replace(({_SAYS})[h % 13 + 1], '~', ['A', 'b', 'B', 'a'][h // 13 % 4 + 1]) AS reply FROM said)
SELECT pair_id, dimension, {sub(_CHOICE, 'reply')} AS choice FROM r""", views=True)
def judge_parse(spark, sf_dir):
    """What is read from replies in all kinds of forms, one for every task."""
    t = judging.tasks(joined(spark, sf_dir), SEED)
    h = F.conv(F.substring(F.md5(F.concat("pair_id", "dimension").cast("binary")), 1, 4), 16, 10).cast("int")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    reply = F.replace(pick(_REPLIES, h % 13), F.lit("~"), pick(("A", "b", "B", "a"), F.floor(h / 13) % 4))
    return t.select("pair_id", "dimension", tx.parse_choice(reply).alias("choice"))


def stub_verdicts(spark, sf_dir):
    return judging.verdicts(judging.tasks(joined(spark, sf_dir), SEED), judging.stub_reply(SEED, "pair_id", "dimension"))


@query(_VERDICTS + 'SELECT pair_id, dimension, "order", raw_response, choice, model_won FROM verdicts', views=True)
def verdicts(spark, sf_dir):
    return stub_verdicts(spark, sf_dir).select("pair_id", "dimension", "order", "raw_response", "choice", "model_won")


_SCORES = f"""SELECT d.dimension, count_if(model_won)::BIGINT AS wins, count_if(NOT model_won)::BIGINT AS losses, count_if(choice = 'invalid')::BIGINT AS invalid,
  count(model_won)::BIGINT AS n, round(count_if(model_won) / nullif(count(model_won), 0)::DOUBLE, 9) AS win_rate, round(2 * count_if(model_won) / nullif(count(model_won), 0)::DOUBLE, 9) AS score
FROM {_DIMS} d LEFT JOIN verdicts v ON v.dimension = d.dimension GROUP BY d.dimension"""


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Sums in another order differ in the last digits; 0.0 is added against a negative zero."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in cols})


@query(_VERDICTS + _SCORES, views=True)
def jmq_scores(spark, sf_dir):
    return rounded(judging.scores(stub_verdicts(spark, sf_dir)), "win_rate", "score")


@query(_VERDICTS + """, o AS (SELECT pair_id, min("order") AS o FROM verdicts GROUP BY pair_id)
SELECT count(*) AS pairs, count_if(o = 'model_first')::BIGINT AS model_first, count_if(o = 'human_first')::BIGINT AS human_first,
       round(count_if(o = 'model_first') / nullif(count(*), 0)::DOUBLE, 9) AS model_first_fraction FROM o""", views=True)
def jmq_bias_audit(spark, sf_dir):
    return rounded(judging.order_audit(stub_verdicts(spark, sf_dir)), "model_first_fraction")


@query(_VERDICTS + _SCORES, views=True)
def jmq_recompute(spark, sf_dir):
    """Scores from verdicts that were written and read again."""
    path = fresh_path(spark, "verdicts")
    cols = [c.split()[0] for c in records.ENTITIES["verdict"].split(", ")]
    records.write_lines(stub_verdicts(spark, sf_dir).select(*cols), path, "verdict", "overwrite")
    return rounded(judging.scores(records.read_strict(spark, path, "verdict")), "win_rate", "score")


@query(_VERDICTS + _SCORES, views=True)
def jmq_stream(spark, sf_dir):
    """Scores of a verdict log that comes in three deliveries, the second of which brings the first one's verdicts again."""
    from driftline.streaming import verdicts as live

    base = fresh_path(spark, "verdict-log")
    cols = [c.split()[0] for c in records.ENTITIES["verdict"].split(", ")]
    own = cut(stub_verdicts(spark, sf_dir).select(*cols), "verdicts").withColumn("_digit", F.substring(F.md5(F.concat("pair_id", "dimension").cast("binary")), 1, 1))
    for part in ("_digit < '5'", "_digit < 'a'", "_digit >= 'a'"):
        records.write_lines(own.where(part).drop("_digit"), f"{base}/log", "verdict")
        live.keep_scores(live.log(spark, f"{base}/log"), f"{base}/out", f"{base}/state")
    return rounded(spark.read.parquet(f"{base}/out/scores"), "win_rate", "score")


@query(_VERDICTS + """, named AS (SELECT pair_id, dimension, CASE WHEN dimension = 'overall' AND substr(md5(pair_id), 1, 1) = '0' THEN 'another-judge' ELSE 'gpt-5.4-mini' END AS m FROM verdicts),
sets AS (SELECT 'all' AS verdicts, * FROM named UNION ALL SELECT 'clarity', * FROM named WHERE dimension = 'clarity' UNION ALL SELECT 'second', * FROM named WHERE m = 'another-judge')
SELECT verdicts, CASE WHEN count(DISTINCT m) = 1 THEN min(m) ELSE 'mixed:' || string_agg(DISTINCT m, ',' ORDER BY m) END AS judge_model, count(DISTINCT pair_id) AS n FROM sets GROUP BY verdicts""", views=True)
def judge_identity(spark, sf_dir):
    """Who judged all verdicts, those of one dimension, and those of a second judge."""
    second = (F.col("dimension") == "overall") & (F.substring(F.md5(F.col("pair_id").cast("binary")), 1, 1) == "0")
    v = stub_verdicts(spark, sf_dir).withColumn("judge_model", F.when(second, "another-judge").otherwise(judging.DEFAULT_JUDGE))
    sets = {"all": v, "clarity": v.where("dimension = 'clarity'"), "second": v.where("judge_model = 'another-judge'")}
    found = [judging.judge_of(x).where("n > 0").select(F.lit(k).alias("verdicts"), "judge_model", "n") for k, x in sets.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


_FULL = f"""replace(replace(replace({_T}, '{{prompt}}', prompt), '{{candidate_a}}', CASE WHEN "order" = 'model_first' THEN model_text ELSE human_text END),
  '{{candidate_b}}', CASE WHEN "order" = 'model_first' THEN human_text ELSE model_text END)"""


@query(_JUDGE + f""", jr AS (SELECT pair_id, dimension, 'gpt-5.4-mini' AS judge_model, "order", CASE WHEN substr(md5({_FULL}), 1, 1) < '8' THEN 'A' ELSE 'B' END AS raw_response FROM jt)
SELECT *, raw_response AS choice, 0::INTEGER AS retry_count, (raw_response = 'A') = ("order" = 'model_first') AS model_won FROM jr""", views=True)
def judge_live(spark, sf_dir):
    """Verdicts of the stand-in judge, called as a real one would be."""
    r = judging.rendered(judging.tasks(joined(spark, sf_dir), SEED), templates())
    return judging.judged(r, seams.stub_judge)


# --- token frequencies --------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '[^{_WS}]+')) AS tok FROM documents) SELECT lang, tok, count(*) AS n FROM t GROUP BY lang, tok""")
def token_counts(spark, sf_dir):
    return metrics.token_counts(docs(spark, sf_dir), ["lang"])


def _l2(source: str, by: str) -> str:
    """Token L2 in SQL by the definition: frequencies over the joint vocabulary."""
    group = f"{by}, " if by else ""
    using = f"({by})" if by else ""
    return f""", tk AS (SELECT {group}side, unnest(regexp_extract_all(text, '[^{_WS}]+')) AS tok FROM {source}),
tc AS (SELECT {group}tok, count_if(side = 'a') AS na, count_if(side = 'b') AS nb FROM tk GROUP BY {group}tok),
tt AS (SELECT {group}sum(na)::DOUBLE AS ta, sum(nb)::DOUBLE AS tb FROM tc {f"GROUP BY {by}" if by else ""}),
l2 AS (SELECT {group}round(sqrt(sum(pow(coalesce(na / nullif(ta, 0), 0) - coalesce(nb / nullif(tb, 0), 0), 2))), 9) AS token_l2, count(*) AS vocab_size
       FROM tc {f"JOIN tt USING {using}" if by else ", tt"} {f"GROUP BY {by}" if by else ""})
"""


def sides(a: DataFrame, c: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit("a")).unionByName(c.withColumn("side", F.lit("b")))


_DRAFT_REF = """, common AS (SELECT pair_id FROM drafts JOIN refs USING (pair_id)),
st AS (SELECT 'a' AS side, text FROM drafts JOIN common USING (pair_id) UNION ALL SELECT 'b', text FROM refs JOIN common USING (pair_id))
"""


@query(_DRAFT_REF + _l2("st", "") + "SELECT token_l2, vocab_size FROM l2", views=True)
def token_l2_draft_ref(spark, sf_dir):
    c, r = setops.align_common(b.drafts(spark, sf_dir), b.references(spark, sf_dir))
    return rounded(metrics.token_l2(sides(c, r), []), "token_l2")


@query("WITH pr AS (SELECT DISTINCT lang AS other FROM documents WHERE lang <> 'en'), st AS (SELECT other, 'a' AS side, text FROM documents, pr WHERE lang = 'en' "
       "UNION ALL SELECT lang, 'b', text FROM documents WHERE lang <> 'en')" + _l2("st", "other") + "SELECT other, token_l2, vocab_size FROM l2")
def token_l2_by_lang(spark, sf_dir):
    """English against each other language; the counts of English are made once and taken for each."""
    counts = metrics.token_counts(docs(spark, sf_dir).where("lang is not null"), ["lang"])
    others = counts.where("lang <> 'en'").select("lang").distinct().select(F.collect_set("lang").alias("o"))
    # a language is a row of a short list, so English counts are multiplied by few
    en = counts.where("lang = 'en'").join(others).select(F.explode("o").alias("other"), "tok", F.col("n").alias("na"), F.lit(0).alias("nb"))
    both = en.unionByName(counts.where("lang <> 'en'").select(F.col("lang").alias("other"), "tok", F.lit(0).alias("na"), F.col("n").alias("nb")))
    one = both.groupBy("other", "tok").agg(F.sum("na").cast("double").alias("na"), F.sum("nb").cast("double").alias("nb"))
    s = one.groupBy("other").agg(
        F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.sum(F.col("na") * F.col("na")).alias("aa"), F.sum(F.col("nb") * F.col("nb")).alias("bb"),
        F.sum(F.col("na") * F.col("nb")).alias("ab"), F.count("*").alias("vocab_size"),
    )
    square = F.expr("aa / ta / ta + bb / tb / tb - 2 * ab / ta / tb")
    return rounded(s.select("other", F.sqrt(F.greatest(square, F.lit(0.0))).alias("token_l2"), "vocab_size"), "token_l2")


@query("WITH st AS (SELECT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS side, text FROM documents JOIN labels USING (doc_id))" + _l2("st", "") + "SELECT token_l2, vocab_size FROM l2")
def token_l2_by_quality(spark, sf_dir):
    own = docs(spark, sf_dir).join(b.table(spark, sf_dir, "labels"), "doc_id").select(F.when(F.col("quality") == 1, "a").otherwise("b").alias("side"), "text")
    return rounded(metrics.token_l2(own, []), "token_l2")


@query("WITH st AS (SELECT 'a' AS side, text FROM documents UNION ALL SELECT 'b', text FROM benchmark)" + _l2("st", "") + "SELECT token_l2, vocab_size FROM l2")
def token_l2_benchmark(spark, sf_dir):
    held = b.table(spark, sf_dir, "benchmark").select("text")
    return rounded(metrics.token_l2(sides(docs(spark, sf_dir).select("text"), held), []), "token_l2")


# --- discrepancy of vectors ---------------------------------------------------------------------


def vectors(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.lit(0).alias("g"), F.when(F.col("label") < 5, "a").otherwise("b").alias("side"), "vec_id", "embedding", "label")


_V = "WITH v AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS s, embedding::DOUBLE[] AS x FROM embeddings)"
_PAIR = """, d AS (SELECT p.s AS sa, q.s AS sb, greatest(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - q.x[i]) * (p.x[i] - q.x[i]))), 0) AS d2
  FROM v p JOIN v q ON p.id < q.id)"""
_BW = ", bw AS (SELECT sqrt(CASE WHEN median(d2) > 0 THEN median(d2) ELSE median(d2) FILTER (WHERE d2 > 0) END) AS sigma FROM d)"
_MMD = """, k AS (SELECT sum(exp(-d2 / (2 * sigma * sigma))) FILTER (WHERE sa = 'a' AND sb = 'a') AS aa, sum(exp(-d2 / (2 * sigma * sigma))) FILTER (WHERE sa = 'b' AND sb = 'b') AS bb,
  sum(exp(-d2 / (2 * sigma * sigma))) FILTER (WHERE sa <> sb) AS ab, any_value(sigma) AS sigma FROM d, bw),
n AS (SELECT count_if(s = 'a')::BIGINT AS n, count_if(s = 'b')::BIGINT AS m FROM v)
SELECT round(2 * aa / (n * (n - 1)) + 2 * bb / (m * (m - 1)) - 2 * ab / (n * m)::DOUBLE, 9) AS mmd2, round(sigma, 9) AS bandwidth, n, m FROM k, n"""


@query(_V + _PAIR + _BW + "SELECT round(sigma, 9) AS bandwidth FROM bw")
def mmd_bandwidth(spark, sf_dir):
    written = metrics.blocks(vectors(spark, sf_dir), "g", "side", "embedding")
    sigma = metrics.bandwidth(metrics.tiles(written), metrics.bracket(written))
    return spark.createDataFrame([(round(sigma, 9),)], "bandwidth double")


@query(_V + _PAIR + _BW + _MMD)
def mmd_unbiased(spark, sf_dir):
    return rounded(metrics.mmd2(vectors(spark, sf_dir), "g", "side", "embedding", "vec_id").drop("g"), "mmd2", "bandwidth")


@query(_V + _PAIR + ", bw AS (SELECT 1.25::DOUBLE AS sigma)" + _MMD)
def mmd_fixed_bandwidth(spark, sf_dir):
    return rounded(metrics.mmd2(vectors(spark, sf_dir), "g", "side", "embedding", "vec_id", sigma=1.25).drop("g"), "mmd2", "bandwidth")


@query("""WITH v AS (SELECT label, vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS s, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT p.label, p.s AS sa, q.s AS sb, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - q.x[i]) * (p.x[i] - q.x[i]))) AS d2 FROM v p JOIN v q ON p.label = q.label AND p.id < q.id),
k AS (SELECT label, sum(exp(-d2 / 2)) FILTER (WHERE sa = 'a' AND sb = 'a') AS aa, sum(exp(-d2 / 2)) FILTER (WHERE sa = 'b' AND sb = 'b') AS bb, sum(exp(-d2 / 2)) FILTER (WHERE sa <> sb) AS ab FROM d GROUP BY label),
n AS (SELECT label, count_if(s = 'a')::BIGINT AS n, count_if(s = 'b')::BIGINT AS m FROM v GROUP BY label)
SELECT label, round(2 * aa / (n * (n - 1)) + 2 * bb / (m * (m - 1)) - 2 * ab / (n * m)::DOUBLE, 9) AS mmd2, n, m FROM k JOIN n USING (label)""")
def mmd_by_label(spark, sf_dir):
    """Even against odd vectors of each label, a null check of the metric."""
    own = vectors(spark, sf_dir).where("label is not null").withColumn("side", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b"))
    return rounded(metrics.mmd2(own, "label", "side", "embedding", "vec_id", sigma=1.0).drop("bandwidth"), "mmd2")


@query("""SELECT label, count(*) AS n, count_if(embedding IS NULL OR len(embedding) = 0)::BIGINT AS empty,
  count_if(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0)::BIGINT AS not_finite, min(len(embedding))::INTEGER AS dim_min, max(len(embedding))::INTEGER AS dim_max FROM embeddings GROUP BY label""")
def vector_validity(spark, sf_dir):
    return metrics.vector_problems(b.table(spark, sf_dir, "embeddings"), "label")


# --- detectors ----------------------------------------------------------------------------------

_DET = """, ds AS (SELECT CASE WHEN k = 0 THEN 'draft' ELSE 'rewrite-k1' END AS set_id, CASE WHEN k = 0 THEN 'instruct_draft' ELSE 'rewrite' END AS role, pair_id, text,
  ('0x' || substr(md5(text), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS p FROM rounds WHERE k <= 1)
"""


def detector_rows(spark, sf_dir):
    r = b.rounds(spark, sf_dir).where("k <= 1")
    return detection.checked(r.select(
        F.when(F.col("k") == 0, "draft").otherwise("rewrite-k1").alias("set_id"), F.when(F.col("k") == 0, "instruct_draft").otherwise("rewrite").alias("role"), "pair_id", "text",
        detection.stub_probability().alias("human_prob"),
    ))


@query(_DET + "SELECT set_id, pair_id, sha256(text) AS text_sha, p AS human_prob FROM ds", views=True)
def detector_scores(spark, sf_dir):
    return detector_rows(spark, sf_dir).select("set_id", "pair_id", tx.content_sha256("text").alias("text_sha"), "human_prob")


_SUMMARY = "count(*) AS n, round(avg({0}), 9) AS mean, round(median({0}), 9) AS median, round(stddev_pop({0}), 9) AS stdev, round(min({0}), 9) AS minimum, round(max({0}), 9) AS maximum"
_QUANT = ", ".join(f"round(quantile_cont({{0}}, {p / 100}), 9) AS p{p}" for p in (25, 50, 75, 90))
_STATS = ("mean", "median", "stdev", "minimum", "maximum", "p25", "p50", "p75", "p90")


@query(_DET + f"SELECT set_id, role, {_SUMMARY.format('p')}, {_QUANT.format('p')} FROM ds GROUP BY set_id, role", views=True)
def detector_summary(spark, sf_dir):
    return rounded(detection.summary(detector_rows(spark, sf_dir), ["set_id", "role"]), *_STATS)


@query(_DET + """, e AS (SELECT set_id, unnest(range(10)) AS bin FROM (SELECT DISTINCT set_id FROM ds)), c AS (SELECT set_id, greatest(0, least(9, floor(p * 10)))::BIGINT AS bin, count(*) AS n FROM ds GROUP BY ALL)
SELECT set_id, bin::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN c USING (set_id, bin)""", views=True)
def detector_histogram(spark, sf_dir):
    return detection.histogram(detector_rows(spark, sf_dir), ["set_id"])


@query(f"SELECT event_type, {_SUMMARY.format('value')}, {_QUANT.format('value')} FROM events GROUP BY event_type")
def event_quantiles(spark, sf_dir):
    return rounded(detection.summary(b.table(spark, sf_dir, "events"), ["event_type"], "value"), *_STATS)


@query(_DET + """, m AS (SELECT avg(p) FILTER (WHERE role = 'instruct_draft') AS d, avg(p) FILTER (WHERE role = 'rewrite') AS r FROM ds)
SELECT round(d, 9) AS draft_mean, round(r, 9) AS rewrite_mean, round(r - d, 9) AS delta, r - d >= 0.30 AS passed FROM m""", views=True)
def detector_rise(spark, sf_dir):
    return rounded(detection.rise(detection.summary(detector_rows(spark, sf_dir), ["set_id", "role"])), "draft_mean", "rewrite_mean", "delta")


@query("""SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN toxic / 10.0 END, 1 - toxic / 4.0)::DOUBLE AS either, (1 - toxic / 2.0)::DOUBLE AS generated FROM labels""")
def detector_fields(spark, sf_dir):
    t = b.table(spark, sf_dir, "labels")
    human = F.when(F.col("quality") == 1, F.col("toxic") / 10.0)
    return t.select("doc_id", tx.human_probability(human, F.col("toxic") / 4.0).alias("either"), tx.human_from_generated(F.col("toxic") / 2.0).alias("generated"))


@query(_DET + "SELECT set_id, role, pair_id, sha256(text) AS text_sha, p AS human_prob FROM ds", views=True)
def detector_live(spark, sf_dir):
    return detection.scored(detector_rows(spark, sf_dir), seams.stub_detector)


# --- cascade ------------------------------------------------------------------------------------

_CASCADE = ", rk AS (SELECT pair_id, k, text, lag(length(text)) OVER (PARTITION BY pair_id ORDER BY k) AS prior FROM rounds WHERE k <= 3), " + _runs("rk", "pair_id, k") + f""",
cm AS (SELECT rk.pair_id, rk.k, text, length({_STRIP}) = 0 AS blank, CASE WHEN prior > 0 THEN length(text) / prior::DOUBLE END AS ratio, {_NON_ASCII} AS fraction, coalesce(run, 0) AS run
  FROM rk LEFT JOIN runs ON runs.pair_id = rk.pair_id AND runs.k = rk.k),
cc AS (SELECT pair_id, k, text, {_CHECKS} FROM cm WHERE k > 0),
cf AS (SELECT *, min(CASE WHEN hard_tripped THEN k END) OVER (PARTITION BY pair_id) AS first_trip FROM cc),
ex AS (SELECT * FROM cf WHERE first_trip IS NULL OR k <= first_trip)
"""
REQUESTED = 3


@query(_CASCADE + "SELECT pair_id, k::INTEGER AS k, round(length_ratio, 9) AS length_ratio, round(non_ascii_fraction, 9) AS non_ascii_fraction, hard_tripped, flags FROM ex", views=True)
def cascade_rounds(spark, sf_dir):
    e = cascade.executed(b.rounds(spark, sf_dir), REQUESTED)
    return e.select(
        "pair_id", "k", F.round("report.length_ratio", 9).alias("length_ratio"), F.round("report.non_ascii_fraction", 9).alias("non_ascii_fraction"),
        F.col("report.hard_tripped").alias("hard_tripped"), F.array_join("report.flags", ",").alias("flags"),
    )


_FINAL = """, fo AS (SELECT d.pair_id, count(ex.k) AS executed, coalesce(max(first_trip) - 1, max(ex.k), 0)::INTEGER AS final_round, coalesce(arg_max(hard_tripped, ex.k), false) AS hard_tripped,
  coalesce(arg_max(flags, ex.k), '') AS flags FROM drafts d LEFT JOIN ex ON ex.pair_id = d.pair_id GROUP BY d.pair_id)
"""


@query(_CASCADE + _FINAL + "SELECT * FROM fo", views=True)
def cascade_final_round(spark, sf_dir):
    return cascade.outcomes(b.rounds(spark, sf_dir), REQUESTED)


@query(_CASCADE + "SELECT k::INTEGER AS k, pair_id, sha256(text) AS sha FROM ex WHERE NOT hard_tripped", views=True)
def cascade_round_sets(spark, sf_dir):
    return cascade.round_sets(b.rounds(spark, sf_dir), REQUESTED).select("k", "pair_id", tx.content_sha256("text").alias("sha"))


@query(_CASCADE + _FINAL + "SELECT count(*) AS pairs, 0::BIGINT AS already_done, count(*) AS rewritten, 0::BIGINT AS skipped_truncated, count_if(hard_tripped)::BIGINT AS flagged_degenerate FROM fo", views=True)
def cascade_summary(spark, sf_dir):
    return cascade.run_summary(b.rounds(spark, sf_dir), REQUESTED)


@query(", r1 AS (SELECT pair_id, 1 AS k, text || ' [r1]' AS text, length(text) AS prior FROM drafts), " + _runs("r1", "pair_id, k") + f""",
m1 AS (SELECT r1.pair_id, text, length({_STRIP}) = 0 AS blank, CASE WHEN prior > 0 THEN length(text) / prior::DOUBLE END AS ratio, {_NON_ASCII} AS fraction, coalesce(run, 0) AS run FROM r1 LEFT JOIN runs ON runs.pair_id = r1.pair_id),
c1 AS (SELECT pair_id, text, {_CHECKS} FROM m1),
r2 AS (SELECT pair_id, text || ' [r2]' AS text, length(text) AS prior FROM c1 WHERE NOT hard_tripped),
m2 AS (SELECT pair_id, text, false AS blank, CASE WHEN prior > 0 THEN length(text) / prior::DOUBLE END AS ratio, {_NON_ASCII} AS fraction, 0 AS run FROM r2),
c2 AS (SELECT pair_id, text, {_CHECKS} FROM m2)
SELECT pair_id, 0::INTEGER AS k, sha256(text) AS sha, NULL::BOOLEAN AS hard_tripped FROM drafts UNION ALL SELECT pair_id, 1, sha256(text), hard_tripped FROM c1 UNION ALL SELECT pair_id, 2, sha256(text), hard_tripped FROM c2""", views=True)
def cascade_live(spark, sf_dir):
    """Two batched rounds of the stand-in rewriter over the drafts."""
    from driftline.operators.seams import stub_rewriter

    out = cascade.run(b.drafts(spark, sf_dir), stub_rewriter, 2, lambda df, k: cut(df, f"rounds-k{k}"))
    return out.select("pair_id", "k", tx.content_sha256("text").alias("sha"), F.col("report.hard_tripped").alias("hard_tripped"))


_KINDS_OF_FILE = ("jsonl", "manifest.json", "tmp")


@query(f""", names AS (SELECT DISTINCT CASE WHEN k = 0 THEN 'draft' ELSE 'rewrite-k' || k END || '.' || unnest({list(_KINDS_OF_FILE)}) AS name FROM rounds)
SELECT name FROM names WHERE TRY_CAST(regexp_extract(name, '^rewrite-k(\\d+)\\.', 1) AS INTEGER) > 1""", views=True)
def cascade_stale(spark, sf_dir):
    """Files of the table's rounds that a run of one round leaves behind."""
    name = F.when(F.col("k") == 0, "draft").otherwise(F.concat(F.lit("rewrite-k"), F.col("k").cast("string")))
    kinds = F.explode(F.array(*[F.lit(x) for x in _KINDS_OF_FILE]))
    names = b.rounds(spark, sf_dir).select(name.alias("stem"), kinds.alias("kind")).distinct().select(F.concat_ws(".", "stem", "kind").alias("name"))
    return cascade.stale_rounds(names, 1)


#: BLAKE2b in SQL: its start values, and the order in which each of the ten permutations takes a block's words.
_B2_IV = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
_B2_ORDER = (
    "0123456789abcdef", "ea489fd61c02b753", "b8c052fdae367194", "7931dcbe265a40f8", "905724afe1bc683d",
    "2c6a0b834d75fe19", "c51fed4a0763928b", "db7ec13950f4862a", "6fe9b308c2d714a5", "a2847615fb9e3cd0",
)


def _pair_seeds(source: str) -> str:
    """``seeds`` (pair_id, seed) of ``source``: the 8-byte BLAKE2b of its short names behind the seed, step by step, as SQL has no such hash."""
    u = lambda xs: "[" + ", ".join(f"{x}::UBIGINT" for x in xs) + "]"
    each = lambda x: f"list_transform(range(1, 5), lambda j: {x})"
    add = lambda *xs: each(f"(({' + '.join(f'{x}::UHUGEINT' for x in xs)}) % 18446744073709551616::UHUGEINT)::UBIGINT")
    # turned right by n places: what falls out comes in on the left
    turn = lambda x, y, n: each(f"(xor({x}[j], {y}[j]) >> {n}) | (xor({x}[j], {y}[j]) % {1 << n}::UBIGINT) * {1 << (64 - n)}::UBIGINT")
    word = lambda odd: f"m[orders[i // 2 % 10 + 1][8 * (i % 2) + 2 * j - {1 - odd}] + 1]"
    mix = f"SELECT *, {add('a[j]', 'b[j]', word(0))} AS a1 FROM b2, b2_orders WHERE i < 24"
    for k, (made, x, y, n) in enumerate((("d1", "d", "a1", 32), ("c1", "c", "d1", 0), ("b1", "b", "c1", 24), ("a2", "a1", "b1", 0), ("d2", "d1", "a2", 16), ("c2", "c1", "d2", 0), ("b2", "b1", "c2", 63))):
        now = turn(x, y, n) if n else add(f"{x}[j]", f"{y}[j]", *([word(1)] if made == "a2" else []))
        mix = f"SELECT *, {now} AS {made} FROM ({mix})"
    # columns and diagonals take turns: the rows are shifted against each other, and back
    shifted = ", ".join(f"{each(f'{row}2[(j - 1 + CASE WHEN i % 2 = 0 THEN {by} ELSE {4 - by} END) % 4 + 1]')}" for row, by in (("b", 1), ("c", 2), ("d", 3)))
    start = [_B2_IV[0] ^ 0x01010008, *_B2_IV[1:]]
    orders = "[" + ", ".join("[" + ", ".join(str(int(x, 16)) for x in o) + "]" for o in _B2_ORDER) + "]"
    word64 = lambda i: "('0x' || " + " || ".join(f"substr(h, 16 * {i} + {2 * k + 1}, 2)" for k in range(7, -1, -1)) + ")::UBIGINT"
    return f"""b2_orders AS (SELECT {orders} AS orders),
b2_texts AS (SELECT pair_id, rpad(hex(encode('{SEED}:' || pair_id)), 256, '0') AS h, strlen('{SEED}:' || pair_id)::UBIGINT AS n FROM (SELECT DISTINCT pair_id FROM {source})),
b2 AS (SELECT pair_id, list_transform(range(0, 16), lambda i: {word64("i")}) AS m, 0 AS i, {u(start[:4])} AS a, {u(start[4:])} AS b, {u(_B2_IV[:4])} AS c,
  [xor({_B2_IV[4]}::UBIGINT, n), {_B2_IV[5]}::UBIGINT, {_B2_IV[6] ^ (2**64 - 1)}::UBIGINT, {_B2_IV[7]}::UBIGINT] AS d FROM b2_texts
  UNION ALL SELECT pair_id, m, i + 1, a2, {shifted} FROM ({mix})),
b2_ends AS (SELECT pair_id, printf('%016x', xor(xor({start[0]}::UBIGINT, a[1]), c[1])) AS h FROM b2 WHERE i = 24),
seeds AS (SELECT pair_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS seed FROM b2_ends)
"""


@query(b.SQL.replace("WITH", "WITH RECURSIVE", 1) + ", left_ AS (SELECT pair_id, prompt FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM drafts)), " + _pair_seeds("left_")
       + "SELECT pair_id, prompt || ' [draft ' || (seed % 1000) || ']' AS text, seed FROM left_ JOIN seeds USING (pair_id)")
def drafts_live(spark, sf_dir):
    """Drafts of the stand-in model for the pairs that have none, each with the pair's own seed."""
    return cascade.generated(b.pairs(spark, sf_dir), b.drafts(spark, sf_dir), seams.stub_drafter, SEED)


@query(", fo AS (SELECT count(*) AS pairs, count_if(substr(md5(pair_id), 1, 1) < '8')::BIGINT AS half FROM drafts) SELECT pairs, half AS first, half AS already_done, pairs - half AS second, 2 * pairs AS rows FROM fo", views=True)
def rewrite_resumed(spark, sf_dir):
    """A rewriting run over half of the drafts, then over all of them into the same place: the finished half is not rewritten again."""
    from driftline.operators import progress

    drafts, store, kind = b.drafts(spark, sf_dir), fresh_path(spark, "resumed"), "pair_id string, text string, k int"
    step = lambda rows: cascade.run(rows, seams.stub_rewriter, 2, lambda df, k: cut(df, f"rounds-k{k}")).select("pair_id", "text", "k")
    half = drafts.where(F.substring(F.md5(F.col("pair_id").cast("binary")), 1, 1) < "8")
    first = progress.append(half, store, kind, step, partition_by=["k"])
    second = progress.append(drafts, store, kind, step, partition_by=["k"])
    rows = spark.read.parquet(store).where("k < 2").count()
    return spark.createDataFrame([(second.planned, first.new, second.before, second.new, rows)], "pairs long, first long, already_done long, second long, rows long")


# --- reports ------------------------------------------------------------------------------------

_EMB = "[" + ", ".join(f"('0x' || substr(md5(text), {4 * k + 1}, 4))::BIGINT / 65536.0::DOUBLE" for k in range(8)) + "]"
_REPORTS = f""", rr AS (SELECT k, pair_id, rounds.text, reference_text FROM rounds JOIN pairs USING (pair_id) WHERE k <= 2),
st AS (SELECT k, 'a' AS side, pair_id, text FROM rr UNION ALL SELECT k, 'b', pair_id, reference_text FROM rr)
""" + _l2("st", "k") + f""", ev AS (SELECT k, side, side || pair_id AS id, {_EMB} AS x FROM st),
kd AS (SELECT p.k, p.side AS sa, q.side AS sb, exp(-list_sum(list_transform(range(1, 9), lambda i: (p.x[i] - q.x[i]) * (p.x[i] - q.x[i]))) / 2) AS kv FROM ev p JOIN ev q ON p.k = q.k AND p.id < q.id),
ks AS (SELECT k, sum(kv) FILTER (WHERE sa = 'a' AND sb = 'a') AS aa, sum(kv) FILTER (WHERE sa = 'b' AND sb = 'b') AS bb, sum(kv) FILTER (WHERE sa <> sb) AS ab FROM kd GROUP BY k),
kn AS (SELECT k, count(*) AS n FROM rr GROUP BY k),
mm AS (SELECT k, n, round(2 * aa / (n * (n - 1)) + 2 * bb / (n * (n - 1)) - 2 * ab / (n * n)::DOUBLE, 9) AS mmd FROM ks JOIN kn USING (k)),
vt AS (SELECT k, pair_id, {_ORDER} AS "order", {_REPLY.format(f"'{SEED}:' || k || ':' || pair_id || ':overall'")} AS raw FROM rr),
vc AS (SELECT *, {sub(_CHOICE, "raw")} AS choice FROM vt), vw AS (SELECT *, {_WON} AS won FROM vc),
jq AS (SELECT k, round(2 * count_if(won) / nullif(count(won), 0)::DOUBLE, 9) AS jmq FROM vw GROUP BY k),
reports AS (SELECT CASE WHEN k = 0 THEN 'draft' ELSE 'rewrite-k' || k END AS report_id, k, n, mmd, token_l2, jmq FROM mm JOIN l2 USING (k) JOIN jq USING (k))
"""


def round_reports(spark, sf_dir):
    """(report_id, k, n, mmd, token_l2, jmq): rounds 0 to 2 against the references of the pairs they share, in one pass a metric."""
    r = b.rounds(spark, sf_dir).where("k <= 2").join(b.pairs(spark, sf_dir).select("pair_id", "reference_text"), "pair_id")
    both = sides(r.select("k", "pair_id", "text"), r.select("k", "pair_id", F.col("reference_text").alias("text")))
    l2 = rounded(metrics.token_l2(both, ["k"]), "token_l2").select("k", "token_l2")
    emb = both.select("k", "side", F.concat("side", "pair_id").alias("id"), seams.stub_embedding().alias("v"))
    mmd = rounded(metrics.mmd2(emb, "k", "side", "v", "id", sigma=1.0), "mmd2").select("k", "n", F.col("mmd2").alias("mmd"))
    tasks = r.select("k", "pair_id").withColumn("order", tx.order_by_hash("pair_id", SEED)).withColumn("dimension", F.lit("overall"))
    v = judging.verdicts(tasks, judging.stub_reply(SEED, "k", "pair_id", "dimension"))
    jmq = rounded(judging.scores(v, ["k"]).where("dimension = 'overall'"), "score").select("k", F.col("score").alias("jmq"))
    out = mmd.join(l2, "k").join(jmq, "k")
    name = F.when(F.col("k") == 0, "draft").otherwise(F.concat(F.lit("rewrite-k"), F.col("k").cast("string")))
    return out.select(name.alias("report_id"), "k", "n", "mmd", "token_l2", "jmq")


@query(_REPORTS + "SELECT * FROM reports", views=True)
def metric_report(spark, sf_dir):
    return round_reports(spark, sf_dir)


@query(_REPORTS + """SELECT report_id, array_to_string(list_filter([CASE WHEN n < 30 THEN 'small_n' END, 'mmd_bandwidth_comparability', CASE WHEN k > 0 THEN 'non_default_judge' END], lambda x: x IS NOT NULL), ',') AS caveats
FROM reports""", views=True)
def report_caveats(spark, sf_dir):
    r = round_reports(spark, sf_dir)
    judge = F.when(F.col("k") > 0, "another-judge").otherwise(judging.DEFAULT_JUDGE)
    return r.select("report_id", F.array_join(rp.caveats(F.col("n"), F.lit(True), F.lit(True), judge), ",").alias("caveats"))


@query(_REPORTS + """, u AS (UNPIVOT (SELECT report_id, mmd, token_l2, jmq FROM reports) ON mmd, token_l2, jmq INTO NAME metric VALUE value),
x AS (SELECT r.report_id, r.metric, d.value AS draft, r.value AS rewrite, r.value - d.value AS delta FROM u r LEFT JOIN u d ON d.metric = r.metric AND d.report_id = 'draft' WHERE r.report_id <> 'draft')
SELECT report_id, metric, draft, rewrite, round(delta, 9) AS delta, delta IS NOT NULL AS comparable,
  CASE WHEN delta = 0 THEN 'unchanged' WHEN delta IS NULL THEN NULL WHEN (delta > 0) = (metric = 'jmq') THEN 'improved' ELSE 'regressed' END AS status,
  CASE WHEN delta <> 0 THEN (delta > 0) = (metric = 'jmq') END AS improved FROM x""", views=True)
def comparison_deltas(spark, sf_dir):
    r = round_reports(spark, sf_dir)
    return rounded(rp.deltas(r.where("k = 0"), r.where("k > 0")), "delta")


@query(_REPORTS + "SELECT report_id, k AS round, (row_number() OVER (ORDER BY k) - 1)::INTEGER AS place FROM reports WHERE k > 0", views=True)
def trajectory(spark, sf_dir):
    r = rp.trajectory(round_reports(spark, sf_dir).where("k > 0").select("report_id", F.col("k").alias("round"), F.lit(0).alias("input_index")))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.col("round").asc_nulls_last(), "input_index")) - 1).select("report_id", "round", "place")


@query(_REPORTS + """SELECT report_id AS model, mmd, jmq, token_l2, false AS published FROM reports
UNION ALL SELECT *, true FROM (VALUES ('14B SFT superbaseline', 0.037::DOUBLE, 0.49::DOUBLE, 0.0039::DOUBLE), ('14B DFT', 0.018, 0.80, 0.0036), ('8B DFT', 0.023, 0.56, 0.0031), ('4B DFT', 0.025, 0.40, 0.0042)) t(model, mmd, jmq, token_l2)""", views=True)
def benchmark_rows(spark, sf_dir):
    """Measured rounds and the published rows in one table."""
    own = round_reports(spark, sf_dir).select(F.col("report_id").alias("model"), "mmd", "jmq", "token_l2", F.lit(False).alias("published"))
    return own.unionByName(rp.published(spark).withColumn("published", F.lit(True)))


_TAGGED = "CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < '4' THEN lang WHEN substr(md5(doc_id::VARCHAR), 1, 1) < '6' THEN '' END"
_CANDIDATE = "CASE WHEN substr(md5(doc_id::VARCHAR), 2, 1) < '4' THEN 'personal-' ELSE 'web-' END || doc_id"


@query(f"SELECT doc_id, coalesce(nullif({_TAGGED}, ''), CASE WHEN starts_with({_CANDIDATE}, 'personal-') THEN 'personal' END) AS corpus FROM documents")
def report_corpus_tags(spark, sf_dir):
    """The corpus that a report is on, from its tag or its sets' names; a document each stands for a report."""
    digit = lambda k: F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), k, 1)
    tag = F.when(digit(1) < "4", F.col("lang")).when(digit(1) < "6", "")
    candidate = F.concat(F.when(digit(2) < "4", "personal-").otherwise("web-"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", tx.report_corpus(tag, candidate, F.lit("reference")).alias("corpus"))


# --- self-check ---------------------------------------------------------------------------------

_SPLIT = f""", rk AS (SELECT pair_id, text, row_number() OVER (ORDER BY md5('{SEED}:' || pair_id), pair_id) - 1 AS pos, count(*) OVER () // 2 AS half FROM refs),
sp AS (SELECT pair_id, text, CASE WHEN pos < half THEN 'a' WHEN pos < 2 * half THEN 'b' END AS side, (CASE WHEN pos >= half AND pos < 2 * half THEN pos - half ELSE pos END)::INTEGER AS place FROM rk)
"""


def split(spark, sf_dir):
    return sampling.half_split_by_hash(b.references(spark, sf_dir), SEED)


@query(_SPLIT + "SELECT pair_id, side AS half, place FROM sp", views=True)
def self_check_split_hash(spark, sf_dir):
    return split(spark, sf_dir)


@query()
def self_check_split_mersenne(spark, sf_dir):
    return sampling.half_split_by_generator(b.references(spark, sf_dir), SEED)[0]


@query(_SPLIT + ", st AS (SELECT side, text FROM sp WHERE side IS NOT NULL)" + _l2("st", "") + "SELECT token_l2, vocab_size FROM l2", views=True)
def self_check_token_l2(spark, sf_dir):
    own = split(spark, sf_dir).where("half is not null").join(b.references(spark, sf_dir), "pair_id").select(F.col("half").alias("side"), "text")
    return rounded(metrics.token_l2(own, []), "token_l2")


@query(_SPLIT + "SELECT 'sc-' || a.place AS pair_id, sha256(a.text) AS model_sha, sha256(b.text) AS human_sha FROM sp a JOIN sp b ON a.side = 'a' AND b.side = 'b' AND a.place = b.place", views=True)
def self_check_pairs(spark, sf_dir):
    p = sampling.split_pairs(split(spark, sf_dir), b.references(spark, sf_dir))
    return p.select("pair_id", tx.content_sha256("model_text").alias("model_sha"), tx.content_sha256("human_text").alias("human_sha"))


@query("SELECT source, n, round(greatest(0, 0.5 - 3 * sqrt(0.25 / n)), 9) AS lo, round(least(1, 0.5 + 3 * sqrt(0.25 / n)), 9) AS hi FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def self_check_window(spark, sf_dir):
    """Win rates that chance allows a set as large as each source."""
    lo, hi = rp.window(F.col("n"))
    sizes = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return rounded(sizes.select("source", "n", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


#: Fixed value: splits of the envelope.
_SEEDS = 24


@query(f""", rk AS (SELECT seed, pair_id, text, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || pair_id), pair_id) - 1 AS pos, count(*) OVER (PARTITION BY seed) // 2 AS half
  FROM refs, (SELECT unnest(range({_SEEDS})) AS seed)), st AS (SELECT seed, pair_id, CASE WHEN pos < half THEN 'a' ELSE 'b' END AS side, text FROM rk WHERE pos < 2 * half)""" + _l2("st", "seed")
       + f""", ev AS (SELECT seed, side, pair_id AS id, {_EMB} AS x FROM st),
kd AS (SELECT p.seed, p.side AS sa, q.side AS sb, exp(-list_sum(list_transform(range(1, 9), lambda i: (p.x[i] - q.x[i]) * (p.x[i] - q.x[i]))) / 2) AS kv FROM ev p JOIN ev q ON p.seed = q.seed AND p.id < q.id),
ks AS (SELECT seed, sum(kv) FILTER (WHERE sa = 'a' AND sb = 'a') AS aa, sum(kv) FILTER (WHERE sa = 'b' AND sb = 'b') AS bb, sum(kv) FILTER (WHERE sa <> sb) AS ab FROM kd GROUP BY seed),
kn AS (SELECT seed, count_if(side = 'a') AS n FROM st GROUP BY seed),
mm AS (SELECT seed, round(2 * aa / (n * (n - 1)) + 2 * bb / (n * (n - 1)) - 2 * ab / (n * n)::DOUBLE, 9) AS mmd2 FROM ks JOIN kn USING (seed))
SELECT min(token_l2) AS lowest_l2, max(token_l2) AS highest_l2, min(mmd2) AS lowest_mmd, max(mmd2) AS highest_mmd, max(abs(mmd2)) AS largest_mmd, count(*) AS seeds FROM l2 JOIN mm USING (seed)""", views=True)
def noise_envelope(spark, sf_dir):
    """Both distances of half against half over several splits: a row says which half it is in in each, so texts and kernel values are made once for all."""
    refs = b.references(spark, sf_dir)
    ids = refs.select("pair_id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(_SEEDS - 1))))
    marks = metrics.split_marks(sampling.half_split_by_hash(ids, SEED, by=["seed"]), _SEEDS, "seed", "pair_id")
    own = cut(refs.join(marks, "pair_id").select("text", "marks", seams.stub_embedding().alias("v")), "splits")
    l2 = rounded(metrics.token_l2_of_splits(own, _SEEDS), "token_l2")
    mmd = rounded(metrics.mmd2_of_splits(own, "v", _SEEDS, 1.0), "mmd2").select("split", "mmd2")
    return l2.join(mmd, "split").agg(
        F.min("token_l2").alias("lowest_l2"), F.max("token_l2").alias("highest_l2"), F.min("mmd2").alias("lowest_mmd"), F.max("mmd2").alias("highest_mmd"),
        F.max(F.abs("mmd2")).alias("largest_mmd"), F.count("*").alias("seeds"),
    )


@query(""", c AS (SELECT 'documents' AS what, count(*) AS calls, 0.0005::DOUBLE AS each FROM pairs UNION ALL SELECT 'judge', 6 * count(*), 0.0005 FROM drafts UNION ALL SELECT 'detector', count(*), 0.01 FROM rounds WHERE k <= 1)
SELECT what, calls, round(calls * each, 9) AS estimated_usd, calls * each > 1.0 AS gated FROM c""", views=True)
def cost_estimates(spark, sf_dir):
    rows = [
        b.pairs(spark, sf_dir).agg(F.count("*").alias("calls")).select(F.lit("documents").alias("what"), "calls", F.lit(rp.CALL_COST).alias("each")),
        b.drafts(spark, sf_dir).agg((6 * F.count("*")).alias("calls")).select(F.lit("judge").alias("what"), "calls", F.lit(rp.CALL_COST).alias("each")),
        b.rounds(spark, sf_dir).where("k <= 1").agg(F.count("*").alias("calls")).select(F.lit("detector").alias("what"), "calls", F.lit(rp.TEXT_COST).alias("each")),
    ]
    cost = F.col("calls") * F.col("each")
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("what", "calls", F.round(cost, 9).alias("estimated_usd"), (cost > rp.COST_GATE).alias("gated"))


# --- files and streams --------------------------------------------------------------------------


@query("SELECT pair_id, sha256(text) AS sha FROM refs", views=True)
def tolerant_read_last_wins(spark, sf_dir):
    """Texts written twice with broken lines between; the later record of a pair stands."""
    path = fresh_path(spark, "tolerant")
    t = b.references(spark, sf_dir).select("pair_id", "text")
    first = t.select(F.to_json(F.struct("pair_id", F.lit("old").alias("text"))).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string"))
    first.write.mode("overwrite").text(path + "/a")
    t.select(F.to_json(F.struct("pair_id", "text")).alias("value")).write.mode("overwrite").text(path + "/b")
    lines = records.numbered(spark, path + "/a").withColumn("line_no", F.col("line_no") - (1 << 60)).unionByName(records.numbered(spark, path + "/b"))
    good = records.last_wins(records.parsed(lines, "text").where("problem is null").select("record.*", "line_no"), "pair_id", "line_no")
    return good.select("pair_id", tx.content_sha256("text").alias("sha"))


_DEFECT = "substr(md5(pair_id), 1, 1)"


@query(f"""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN {_DEFECT} < '2' THEN 'json' WHEN {_DEFECT} < '6' THEN 'keys' END AS problem FROM refs WHERE {_DEFECT} >= '6' OR {_DEFECT} < '6' AND {_DEFECT} <> '5') GROUP BY problem""", views=True)
def strict_read_errors(spark, sf_dir):
    """Kinds of problems that a strict read refuses, of every reference's line, spoilt by the first digit of its name's MD5."""
    digit = F.substring(F.md5(F.col("pair_id").cast("binary")), 1, 1)
    whole = F.to_json(F.struct("pair_id", "text"))
    spoilt = (
        F.when(digit == "0", F.concat(F.lit("{"), whole)).when(digit == "1", F.concat(F.lit("["), whole, F.lit("]")))
        .when(digit == "2", F.to_json(F.struct("pair_id"))).when(digit == "3", F.to_json(F.struct("text"))).when(digit == "4", F.to_json(F.struct("pair_id", "text", F.lit(1).alias("more"))))
        .when(digit == "5", F.lit("   ")).otherwise(whole)
    )
    path = fresh_path(spark, "spoilt")
    b.references(spark, sf_dir).select(spoilt.alias("value")).write.text(path)
    return records.parsed(records.numbered(spark, path), "text").groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS first, 0::BIGINT AS second, count(*) AS rows FROM drafts", views=True)
def incremental_append(spark, sf_dir):
    """Two deliveries of all drafts into one sink: each pair once."""
    from driftline.streaming import incremental

    base = fresh_path(spark, "incremental")
    d = b.drafts(spark, sf_dir)
    d.write.mode("overwrite").parquet(base + "/in")
    first = incremental.append_new(incremental.documents(spark, base + "/in", d.schema), base + "/sink", base + "/state")
    d.write.mode("append").parquet(base + "/in")
    second = incremental.append_new(incremental.documents(spark, base + "/in", d.schema), base + "/sink", base + "/state")
    return spark.createDataFrame([(first, second, spark.read.parquet(base + "/sink").count())], "first long, second long, rows long")
