"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, chat, egojoin, langid, lm, merkle, minhash, mixing, phrases, secretscan, sharding, warc
from driftline.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = langid.train(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), names, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_pairs(chat.swapped_replies(table(spark, sf_dir, "conversations")))
    runs = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["chars"].cast("string"), F.when(r["trained"], "+").otherwise("-"))), "")
    return pairs.withColumns({"chosen_mask": runs("chosen_mask"), "rejected_mask": runs("rejected_mask")})


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, num=80, den=100)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood, "op2_bpe": op2_bpe, "op3_sharding": op3_sharding, "op4_language": op4_language, "op5_warc": op5_warc, "op6_embeddings": op6_embeddings,
    "op7_merkle": op7_merkle, "op8_chat": op8_chat, "op9_minhash": op9_minhash, "op10_mixing": op10_mixing, "op11_phrases": op11_phrases, "op12_secrets": op12_secrets,
}
ORACLE: dict[str, str] = {}

ORACLE["op5_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN w.winner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes = w.payload_bytes
"""

ORACLE["op6_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

_ROLE, _TEXT = "replace(replace(t.role, '<|', '< |'), chr(10), ' ')", "replace(t.txt, '<|', '< |')"
_RENDER = f"list_reduce(list_prepend('', list_transform({{0}}, lambda t: '<|im_start|>' || {_ROLE} || chr(10) || {_TEXT} || '<|im_end|>' || chr(10))), lambda a, b: a || b)"
_MASK = (
    f"list_reduce(list_prepend('', list_transform({{0}}, lambda t: (length({_ROLE}) + 13) || '-' || (length({_TEXT}) + 10) || "
    "(CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END) || '1-')), lambda a, b: a || b)"
)
ORACLE["op8_chat"] = f"""
WITH t AS (
  SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'txt': coalesce(text, '')}} ORDER BY turn, role, text) AS l,
         max(turn) FILTER (WHERE role = 'assistant') AS last_turn
  FROM conversations GROUP BY conv_id
), c AS (
  SELECT conv_id, last_turn, list_transform(list_filter(l, lambda x: last_turn IS NULL OR x.turn <= last_turn), lambda x: {{'role': x.role, 'txt': x.txt}}) AS a FROM t
), r AS (
  SELECT conv_id, a[len(a)].txt AS reply FROM c WHERE last_turn IS NOT NULL
), n AS (
  SELECT conv_id, coalesce(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS reply FROM r
), p AS (
  SELECT c.conv_id, a, CASE WHEN n.conv_id IS NULL THEN a ELSE list_append(a[1:len(a) - 1], {{'role': 'assistant', 'txt': n.reply}}) END AS b
  FROM c LEFT JOIN n ON n.conv_id = c.conv_id
), k AS (
  SELECT conv_id, a, b, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS k FROM p
)
SELECT conv_id, k::INTEGER AS common_turns, {_RENDER.format("a[1:k]")} AS prompt, {_RENDER.format("a[k + 1:]")} AS chosen, {_MASK.format("a[k + 1:]")} AS chosen_mask,
       {_RENDER.format("b[k + 1:]")} AS rejected, {_MASK.format("b[k + 1:]")} AS rejected_mask
FROM k
"""

#: The next document by one window over all; fingerprints of the text, the edited text and the next text by the same cuts.
ORACLE["op7_merkle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt
  FROM documents WINDOW w AS (ORDER BY doc_id NULLS FIRST, coalesce(text, ''))
), e AS (
  SELECT *, row_number() OVER () AS r, left(body, length(body) - length(body) // 4) || left(nxt, length(body) // 4) AS edited FROM d
), t AS (
  SELECT r, 'a' AS what, body AS x FROM e UNION ALL SELECT r, 'b', edited FROM e UNION ALL SELECT r, 'c', nxt FROM e
), p AS (
  SELECT r, what, sha256(x) AS whole, list_transform(list_transform(string_split(x, chr(10)), lambda l: array_to_string(list_transform(
    string_split(regexp_replace(l, '([.!?,;:dn] |[^ ]{48})', '\1' || chr(1), 'g'), chr(1)), lambda y: substr(md5(y), 1, 8)), ' ')),
    lambda q: substr(md5(q), 1, 12) || '(' || q || ')') AS p FROM t
), j AS (
  SELECT r, what, whole, array_to_string(list_transform(p, lambda q: q || CASE WHEN starts_with(q, '0') OR starts_with(q, substr(md5(substr(md5(''), 1, 8)), 1, 12)) THEN '|' ELSE ';' END), '') AS j FROM p
), h AS (
  SELECT r, what, whole, array_to_string(list_transform(string_split(left(j, length(j) - 1), '|'), lambda s: substr(md5(s), 1, 12) || ':' || s), '|') AS h FROM j
), f AS (
  SELECT r, max(f) FILTER (WHERE what = 'a') AS a, max(f) FILTER (WHERE what = 'b') AS b, max(f) FILTER (WHERE what = 'c') AS c
  FROM (SELECT r, what, sha256(whole || '|' || h) || '|' || h AS f FROM h) GROUP BY r
), l AS (
  SELECT r, a, b, c, list_distinct(regexp_extract_all(a, '[( ]([0-9a-f]+)', 1)) AS la, list_distinct(regexp_extract_all(b, '[( ]([0-9a-f]+)', 1)) AS lb,
         list_distinct(regexp_extract_all(c, '[( ]([0-9a-f]+)', 1)) AS lc, string_split(a, '|')[2:] AS sa, string_split(b, '|')[2:] AS sb FROM f
), k AS (
  SELECT *, list_transform(sa, lambda s: string_split(s, ':')[1]) AS ka, flatten(list_transform(sa, lambda s: list_transform(string_split(string_split(s, ':')[2], ';'), lambda q: string_split(q, '(')[1]))) AS pa FROM l
)
SELECT e.doc_id, length(body)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CASE WHEN a[1:64] = b[1:64] THEN 1.0 ELSE 2.0 * len(list_intersect(la, lb)) / (len(la) + len(lb)) END::DOUBLE AS near_edited,
  CASE WHEN a[1:64] = c[1:64] THEN 1.0 ELSE 2.0 * len(list_intersect(la, lc)) / (len(la) + len(lc)) END::DOUBLE AS near_next,
  CASE WHEN a[1:64] = b[1:64] THEN 0 ELSE coalesce(list_sum(list_transform(sb, lambda s: CASE WHEN list_contains(ka, string_split(s, ':')[1]) THEN 0
    ELSE len(list_filter(string_split(string_split(s, ':')[2], ';'), lambda q: NOT list_contains(pa, string_split(q, '(')[1]))) END)), 0) END::BIGINT AS edited_paragraphs
FROM e JOIN k USING (r)
"""

#: All pairs that share a shingle, then reachability.
ORACLE["op9_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM s),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM met WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM met WHERE 100 * k >= 80 * (na + nb - k)
), reach(a, b) AS (
  SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON c.a = s.doc_id
"""

#: All phrases of all pieces, all cuts of the candidates, all their shorter parts.
ORACLE["op11_phrases"] = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), u AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE m >= 2),
k AS (SELECT *, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT k.lang, k.m, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = k.lp JOIN g y ON y.lang = k.lang AND y.phrase = k.rp
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT lang, a, m, ws, unnest(range(2, m)) AS len FROM c WHERE m > 2),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[j:j + len - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - len + 2)) AS j FROM q)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN u USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)
QUALIFY rank <= 2000
"""

_NAME = "(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_PATTERNS = {
    "assign": _NAME + r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "run": "[A-Za-z0-9+/_.=-]+",
}


def _matches(kind: str) -> str:
    """All matches of a pattern with their places: what is matched and what lies between alternate."""
    p = _PATTERNS[kind]
    return f"""SELECT rid, '{kind}' AS kind, m, (sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS place FROM (
    SELECT rid, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_split_to_array(text, '{p}')) AS gap, generate_subscripts(regexp_split_to_array(text, '{p}'), 1) AS i FROM d)
  WHERE m IS NOT NULL WINDOW w AS (PARTITION BY rid ORDER BY i)"""


_VALUE = "regexp_extract(m, '^" + _NAME + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)"""
#: Matches with their places, the owners of every value, and what is left of the bare ones.
ORACLE["op12_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT rid, kind, place AS a, place + length(m) AS b, trim(CASE WHEN kind = 'assign' THEN {_VALUE} ELSE m END, '+/_.=-') AS v, false AS mixed
  FROM ({_matches("assign")} UNION ALL {_matches("access")} UNION ALL {_matches("hex")})
  WHERE length(CASE WHEN kind = 'assign' THEN {_VALUE} ELSE m END) >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 ELSE 24 END
), runs AS (
  SELECT rid, place + length(m) - length(ltrim(m, '+/_.=-')) AS a, trim(m, '+/_.=-') AS v FROM ({_matches("run")}) WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
), bare AS (
  SELECT rid, 'owned' AS kind, a, a + length(v) AS b, v, length(v) >= 20 AND len(list_distinct(string_split(v, ''))) >= 10 AND lower(v) <> v AND upper(v) <> v AS mixed
  FROM runs r WHERE length(v) >= 8 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = r.rid AND x.a < r.a + length(r.v) AND x.b > r.a)
), found AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owners AS (SELECT v, count(DISTINCT {{'s': source}}) AS owners, bool_or(kind = 'assign') AS assigned FROM found JOIN d USING (rid) GROUP BY v),
s AS (
  SELECT rid, kind, list_position(['assign', 'access', 'hex', 'owned'], kind) AS k, a, b, owners FROM found JOIN owners USING (v) WHERE kind <> 'owned' OR (owners < 3 AND (assigned OR mixed))
), t AS (
  SELECT rid, count_if(kind = 'assign')::BIGINT AS n_assign, count_if(kind = 'access')::BIGINT AS n_access, count_if(kind = 'hex')::BIGINT AS n_hex, count_if(kind = 'owned')::BIGINT AS n_owned,
         count_if(owners < 3)::BIGINT AS n_live, count_if(owners >= 3)::BIGINT AS n_example,
         coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE kind <> 'owned'), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN t USING (rid)
"""
