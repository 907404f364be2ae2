"""Secrets in texts, told from widely copied examples by who else has them.

One scan finds the base spans (assignments, access keys, runs of hexadecimal digits) and, besides
them, bare values: runs of token characters with a letter and a digit in them that no base span
covers.  Every value is hashed, and over the whole corpus each hash's distinct repositories and owners
are counted, in three aggregations that combine before they shuffle.  A value that many owners have is
an example that was copied; one that stays with few is specific to them and looks live.  A bare value
becomes a span of its own (``owned``) if it is owner-specific and either somebody assigns it to a
secret's name somewhere, or it is as mixed as generated credentials are.  Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, joined, text_or_empty, trim

#: Kinds in the order in which spans of one start are listed, and the least lengths.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Fixed value: an assignment; names are looked for in a text whose A-Z are in lower case, which keeps all places.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
#: Characters of bare values, and those that are none at their ends.
TOKEN, EDGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", "+/_.=-"
_FROM_DIGIT = re.compile(r"[0-9][A-Za-z0-9+/_.=-]*")
#: What stands before a value's first digit is looked for in a window that doubles from this size.
BACK = 64
#: A bare value has so many characters at least; one that nobody assigns has more, of so many different ones.
BARE_LEAST, MIXED_LEAST, MIXED_KINDS = 8, 20, 10
#: With so many owners a value is an example that was copied.
EXAMPLE_OWNERS = 3

FOUND = "array<struct<kind:string,start:int,end:int,value:binary,mixed:boolean>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("mixed", pa.bool_())]))


def _hash(value: str) -> bytes:
    """Of a value without what belongs to the sentence around it."""
    return hashlib.blake2b(value.strip(EDGE).encode(), digest_size=16).digest()


def _bare(text: str, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of bare values that meet none of the base spans, which come in order."""
    starts, stops = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in _FROM_DIGIT.finditer(text):
        a, b, back = m.start(), m.end(), BACK
        if b - a < BARE_LEAST and (not a or text[a - 1] not in TOKEN):
            continue
        while (head := text[max(0, a - back) : a]) and not head.rstrip(TOKEN) and back < a:
            back *= 2
        start = a - len(head) + len(head.rstrip(TOKEN))
        own = text[start:b]
        a, b = b - len(own.lstrip(EDGE)), start + len(own.rstrip(EDGE))
        if b - a < BARE_LEAST or not any(c.isalpha() for c in text[a:b]):
            continue
        before = bisect_left(starts, b)
        if not before or stops[before - 1] <= a:
            yield a, b


def spans_of(text: str, low: str) -> list[tuple[str, int, int, bytes, bool]]:
    """(kind, start, end, hash of the value, whether it is mixed) of a text; ``low`` is the text with A-Z in lower case."""
    out = [("assign", m.start(), m.end(), _hash(text[m.start(1) : m.end(1)]), False) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end(), _hash(m[0]), False) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), _hash(m[0]), False) for m in HEX.finditer(text)]
    for a, b in _bare(text, sorted((x[1], x[2]) for x in out)):
        v = text[a:b]
        mixed = b - a >= MIXED_LEAST and len(set(v)) >= MIXED_KINDS and v.lower() != v and v.upper() != v
        out.append(("owned", a, b, _hash(v), mixed))
    return out


def scanned(docs: DataFrame, key: str, text: str, repo: Column, owner: Column) -> DataFrame:
    """(key, repo, owner, found): candidates of each text, base ones and bare ones."""
    own = docs.select(F.col(key).alias("key"), repo.alias("repo"), owner.alias("owner"), text_or_empty(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                t = batch.column(3)[k].as_py()
                found.append([dict(zip(("kind", "start", "end", "value", "mixed"), s, strict=True)) for s in spans_of(t, _lowered(t))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, _KIND)], ["key", "repo", "owner", "found"])
        trim()

    kind = dict(own.dtypes)
    return own.mapInArrow(run, f"key {kind['key']}, repo {kind['repo']}, owner {kind['owner']}, found {FOUND}")


_AZ = {c: c + 32 for c in range(65, 91)}


def _lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_AZ)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n, repos, owners, assigned) of candidates (value, repo, owner, kind): occurrences, distinct repositories and owners; a null one counts as one."""
    a = candidates.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"), F.max(F.col("kind") == "assign").alias("assigned"))
    b = a.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.max("assigned").alias("assigned"))
    return b.groupBy("value").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.max("assigned").alias("assigned"))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str | None = None, owner: str = "source", examples: int = EXAMPLE_OWNERS) -> DataFrame:
    """(row, key, spans): a row of ``docs`` each, spans in order of start and kind as (start, order, end, kind, verdict, repos, owners).

    ``repo`` names a document's repository, by default the document's key; ``owner`` who it belongs to.
    The verdict is ``example`` for values with ``examples`` owners or more, else ``live``.  A null or
    empty text has no spans.  Rows with a null or repeated key are rows of their own, but repositories
    and owners are told by value: null ones are one.  A text goes through one task whole, so a very long
    one needs memory for itself and its copy in lower case.  Other columns are not looked at.
    """
    base = scanned(docs, key, text, F.col(repo or key), F.col(owner)).withColumn("row", F.monotonically_increasing_id())
    rows = cut(base, "secret-candidates")
    each = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    counted = cut(ownership(each), "secret-owners")
    told = joined(each.select("row", "value", "kind", "start", "end", "mixed"), counted, "value", each.count())
    live = F.col("owners") < examples
    kept = told.where((F.col("kind") != "owned") | (live & (F.col("assigned") | F.col("mixed"))))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "end", "kind", F.when(live, "live").otherwise("example").alias("verdict"), "repos", "owners")
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return rows.select("row", F.col("key").alias(key)).join(per_row, "row", "left").withColumn("spans", F.coalesce("spans", none))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example) a row of ``docs``."""
    found = findings(docs, key, **how)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    base = F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "owned")), 256)
    return found.select(
        key, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), base.alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        n("owned").alias("n_owned"), said("live").alias("n_live"), said("example").alias("n_example"),
    )
