"""Merkle fingerprints of documents over paragraphs and sections, by column expressions only.

A text is cut into lines; a line is a paragraph, and its clauses are the leaves.  Sections are
runs of paragraphs: a section ends at an empty line, or after a paragraph whose hash says so, which
keeps sections where they are when text before them is edited.  Every node's hash covers its
children's; the root covers the sections'.  Equal texts have equal roots, and where roots differ
only the branches that differ have to be looked at to locate an edit.

A fingerprint is a string: root, then one part a section: ``root|s:p(l l);p(l)|s:...`` with hashes in
hexadecimal digits.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import cut

#: Hexadecimal digits of a leaf's, and of a paragraph's or section's hash.
LEAF_HEX, NODE_HEX = 8, 12
#: A paragraph ends its section when its hash starts with this digit: one in sixteen.
SECTION_END = "0"
#: A leaf ends behind this: a mark or a word's last d or n before a space, or a long run without one.
LEAF_END = r"([.!?,;:dn] |[^ ]{48})"
#: Bytes of a stretch in key order, about; quantiles of the key that stretches are made from; rows that a stretch's quantile is taken from.
STRETCH, QUANTILES, TAKEN = 1_000_000, 4096, 64
#: A key that holds so many stretches is divided by the order of its rows, into so many parts.
HOT, HOT_PARTS = 4, 256


def _leaf(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, LEAF_HEX)


def _node(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, NODE_HEX)


def leaf_strings(line: Column) -> Column:
    """Clauses of a paragraph.  The cuts depend on what stands there only and lose nothing: joined together, the clauses are the paragraph."""
    return F.split(F.regexp_replace(line, LEAF_END, "$1\u0000"), "\u0000")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty.  Covers every character, line ends among them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # a paragraph: p(l l l); U+0000 within a text is a cut like the clauses' own
    leaves = F.transform(lines, lambda line: F.array_join(F.transform(leaf_strings(line), _leaf), " "))
    paragraphs = F.transform(leaves, lambda x: F.concat(_node(x), F.lit("("), x, F.lit(")")))
    empty = _node(_leaf(F.lit("")))
    # the character behind a paragraph ends its section or goes on
    joined = F.array_join(
        F.transform(paragraphs, lambda p: F.concat(p, F.when(p.startswith(SECTION_END) | p.startswith(empty), "|").otherwise(";"))), ""
    )
    sections = F.split(F.regexp_replace(joined, r"[|;]$", ""), r"\|")
    with_hash = F.array_join(F.transform(sections, lambda s: F.concat(_node(s), F.lit(":"), s)), "|")
    # the hashes that are shown are cut short, so the root covers the whole text's as well
    full = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return F.concat(F.sha2(F.concat(full, F.lit("|"), with_hash).cast("binary"), 256), F.lit("|"), with_hash)


def root(fp: Column) -> Column:
    """Equal for equal texts, and only for these up to collisions of SHA-256."""
    return F.substring_index(fp, "|", 1)


def sections(fp: Column) -> Column:
    return F.slice(F.split(fp, r"\|"), 2, 1 << 30)


def leaves(fp: Column) -> Column:
    """Distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"[( ]([0-9a-f]+)"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves in common, 0 to 1: twice the common distinct leaves over the sum of both numbers; 1 for equal roots."""
    x, y = leaves(a), leaves(b)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def locate(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``b`` that an edit of ``a`` touched, going down differing branches only.

    Sections of ``b`` whose hash ``a`` has are skipped whole; of the others the paragraphs that ``a``
    lacks are listed.  Equal roots: none.
    """
    known = F.transform(sections(a), lambda s: F.substring_index(s, ":", 1))
    old = F.transform(F.flatten(F.transform(sections(a), lambda s: F.split(F.substring_index(s, ":", -1), ";"))), lambda p: F.substring_index(p, "(", 1))
    marked = F.flatten(
        F.transform(
            sections(b),
            lambda s: F.transform(
                F.split(F.substring_index(s, ":", -1), ";"),
                lambda p: ~F.array_contains(known, F.substring_index(s, ":", 1)) & ~F.array_contains(old, F.substring_index(p, "(", 1)),
            ),
        )
    )
    at = F.transform(marked, lambda hit, k: F.when(hit, k))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(at, lambda k: k.isNotNull()))


def above(at: Column, edges: Column, heads: Column | None = None) -> Column:
    """How many of the sorted edges are no larger than ``at``; with every 64th edge in ``heads``, by few comparisons."""
    if heads is None:
        return F.size(F.filter(edges, lambda e: e <= at))
    i = F.greatest(F.size(F.filter(heads, lambda e: e <= at)), F.lit(1)) - 1
    return i * 64 + F.size(F.filter(F.slice(edges, i * 64 + 1, F.lit(64)), lambda e: e <= at))


def beginning(c: Column) -> Column:
    """The first seven bytes of a string as a number, in the strings' order as far as these tell."""
    return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def with_next(rows: DataFrame, key: str, order: list[str], cols: list[str], stretch: int = STRETCH, made: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with next_<col> of the row that follows in order of the whole-number ``key`` and then ``order``; the first follows the last.

    ``made`` are columns to make from the rows' own and to give of the next row too; they are made once a
    row, behind the shuffle, which doesn't carry them.  ``rows`` must not have columns named quantile_no,
    stretch, after or next_<col>.

    Null keys come first.  Rows are dealt into stretches of about ``stretch`` bytes, by quantiles of the
    keys weighted by bytes and even parts of these, and a key that holds several stretches by the first
    bytes of its rows' first ``order`` column, which must be a string.  Each stretch is ordered by itself;
    its last row takes the first row of the next stretch that has any, of which there is one a stretch.
    The rows are shuffled once.  What stays together whatever its size is rows of one key whose order
    begins with the same seven bytes.
    """
    at = F.col(key)
    weight = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in cols]) + 100
    first = F.col(order[0]) if order else F.lit(None).cast("string")
    narrow = cut(rows.select(at.cast("long").alias("at"), weight.cast("long").alias("weight"), beginning(F.coalesce(first, F.lit(""))).alias("begins")), "next-weights")
    total = narrow.agg(F.sum("weight")).first()[0] or 0
    parts = max(1, -(-total // stretch))
    coarse = min(parts, QUANTILES)
    # so many rows a stretch, each drawn by its weight
    unit = max(1, total // (coarse * TAKEN))
    chance = F.pmod(F.xxhash64("at", "weight", "begins"), F.lit(unit)) < F.col("weight") % unit
    times = (F.floor(F.col("weight") / unit) + F.when(chance, 1).otherwise(0)).cast("int")
    drawn = narrow.withColumn("times", times).where("times > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    got = drawn.agg(F.percentile_approx("at", [k / coarse for k in range(coarse + 1)], 100_000), F.count_if(F.col("at").isNull()) / F.greatest(F.count("*"), F.lit(1)) * coarse).first()
    found = Counter(got[0] or [0])
    edges = sorted(found)
    hot = [k for k, n in found.items() if n > HOT] if order else []
    nulls = order and (got[1] or 0) > HOT
    fine = max(-(-parts // coarse), HOT_PARTS + 1)
    every = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    lits, k = every(edges), F.col("quantile_no")
    low, high = F.element_at(lits, k), F.element_at(lits, F.least(k + 1, F.lit(len(edges))))
    spread = -(-parts // coarse)
    inside = F.least(F.lit(spread - 1), F.greatest(F.lit(0), F.floor((at - low) * F.lit(float(spread)) / F.greatest(F.lit(1), high - low))))
    numbered = rows.withColumn("quantile_no", F.greatest(F.lit(1), above(at, lits, every(edges[::64]))))
    dealt = numbered.withColumn("stretch", F.when(at.isNull(), 0).otherwise(k * (2 * fine) + inside).cast("long")).drop("quantile_no")
    if hot or nulls:
        # a hot key is an edge, so its rows come before all others of its quantile, which keep behind its parts
        among = F.col("at").isin(hot) if hot else F.lit(False)
        wanted = narrow.where((among | F.col("at").isNull()) if nulls else among)
        # one row a hot key, of which there are at most QUANTILES / HOT and null
        tops = wanted.groupBy(F.col("at").alias("hot_at")).agg(F.percentile_approx("begins", [j / HOT_PARTS for j in range(1, HOT_PARTS)], 10_000).alias("begin_edges"))
        met = dealt.join(F.broadcast(tops), at.cast("long").eqNullSafe(F.col("hot_at")), "left")
        part = above(beginning(F.coalesce(first, F.lit(""))), F.array_sort(F.array_distinct("begin_edges")))
        behind = F.when(at.isNotNull(), F.lit(fine)).otherwise(0) if hot else F.lit(0)
        dealt = met.withColumn("stretch", F.when(F.col("begin_edges").isNotNull(), F.floor(F.col("stretch") / (2 * fine)) * (2 * fine) + part).otherwise(F.col("stretch") + behind)).drop("hot_at", "begin_edges")
    w = Window.partitionBy("stretch").orderBy(at.asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    cols = [*cols, *(made or {})]
    ahead = dealt.repartition("stretch").withColumns(made or {}).withColumns({f"next_{c}": F.lead(F.struct(c)).over(w) for c in cols})
    # the first row of each stretch: its key by a narrow aggregate, then its columns
    least = cut(dealt.groupBy("stretch").agg(F.min(F.struct(at.isNotNull().alias("known"), at.alias("low_key"))).alias("first")).select("stretch", "first.low_key"), "next-keys")
    few = dealt.join(least.select(F.col("stretch").alias("of"), "low_key"), at.eqNullSafe(F.col("low_key")) & (F.col("stretch") == F.col("of")))
    lead_cols = F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"{c}_known"), F.col(c))] or [F.lit(0)])
    firsts = cut(few.withColumns(made or {}).groupBy("stretch").agg(F.min_by(F.struct(*cols), lead_cols).alias("first")), "next-firsts")
    # the stretch behind: within a quantile's, else the first of the next quantile that has any, of which there are QUANTILES at most
    quantile = F.floor(F.col("stretch") / (2 * fine))
    own = least.select("stretch", quantile.alias("q")).withColumn("on", F.lead("stretch").over(Window.partitionBy("q").orderBy("stretch")))
    heads = own.groupBy("q").agg(F.min("stretch").alias("head"))
    after = Window.orderBy("q")
    heads = heads.select("q", F.lead("head").over(after).alias("next_head"), F.first("head").over(after).alias("wrap"))
    follow = own.join(heads, "q").select("stretch", F.coalesce("on", "next_head", "wrap").alias("on"))
    step = follow.select(F.col("stretch").alias("s"), F.col("on").alias("stretch")).join(firsts, "stretch").select(F.col("s").alias("stretch"), F.col("first").alias("after"))
    out = ahead.join(step, "stretch")
    return out.select(*rows.columns, *(made or {}), *[F.when(F.col(f"next_{c}").isNotNull(), F.col(f"next_{c}")[c]).otherwise(F.col("after")[c]).alias(f"next_{c}") for c in cols])


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs) per row.

    The edited text has the last floor(n_chars / 4) code points of the text replaced by the first as
    many, or all, of the next row's, in order of key and then text; the first row follows the last.
    near_edited and near_next are the likeness of the text's fingerprint with the edited text's and
    with the next row's.  Null texts count as empty; rows with one key follow each other by text, so
    repeated rows are each other's next.  A single row is its own next.  No rows: an empty frame.
    edited_paragraphs numbers the lines of the edited text that differ.  Other columns aren't read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    both = with_next(rows, "key", ["body"], ["body"], made={"fp": fingerprint(F.col("body"))})
    n = F.char_length("body")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - q), F.substring(F.col("next_body"), F.lit(1), q))
    made = both.select(
        "key", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"), F.col("next_fp").alias("next_fingerprint"),
    )
    return made.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.size(locate(F.col("fingerprint"), F.col("edited_fingerprint"))).cast("long").alias("edited_paragraphs"),
    )
