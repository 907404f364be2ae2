"""Scalar text and value expressions.  Every function takes Columns (or names) and gives a Column."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str methods and \s see it, as the inside of a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
SPACES = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())
#: Fixed value: line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Phrases of navigation and legal lines, in lower case.
BOILERPLATE = (
    "cookie", "privacy policy", "all rights reserved", "subscribe", "sign in", "sign up", "terms of service", "©", "copyright", "read more", "click here",
)
#: Instructions that prompts are made with, dealt out in turn.
PROMPT_VARIANTS = (
    "Write the single instruction a writer was given that would produce the text below. Reply with only the instruction.",
    "Reconstruct the writing prompt this passage answers. Output just the prompt, one or two sentences, no preamble.",
    "What task or question was this piece written to address? Give only the task as a direct instruction.",
    "Infer the assignment behind this text and state it as a prompt. Return the prompt alone, nothing else.",
)
#: Limits of the checks.
WORDS_MIN, WORDS_MAX = 150, 1200
ENGLISH_NON_ASCII, BOILERPLATE_SHARE = 0.10, 0.30
RATIO_MIN, RATIO_MAX, BURST, REPEATED_STARTS = 0.5, 2.0, 0.05, 3

DEGENERATION = (
    "struct<empty:boolean,length_ratio:double,length_ratio_tripped:boolean,repetition_flagged:boolean,"
    "non_ascii_fraction:double,non_ascii_burst_tripped:boolean,hard_tripped:boolean,flags:array<string>>"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in which branches ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def words(c: Column | str) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_extract_all(col(c), F.lit(f"([^{SPACE}]+)"), F.lit(1))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(f"[^{SPACE}]+")).cast("long")


def non_ascii_fraction(c: Column | str) -> Column:
    """Share of code points above U+007F; null for an empty text."""
    n = F.char_length(col(c))
    return F.when(n > 0, F.char_length(F.regexp_replace(col(c), r"[\x00-\x7F]+", "")) / n)


def looks_english(c: Column | str) -> Column:
    return F.coalesce(non_ascii_fraction(c) <= ENGLISH_NON_ASCII, F.lit(False))


def boilerplate_fraction(c: Column | str) -> Column:
    """Share of non-blank lines that hold a navigation or legal phrase; null without such a line.

    Lines are counted, not cut out, and looked through only in texts that hold a phrase at all.
    """
    ends = LINE_END.partition("|")[2][1:-1]

    def share(low: Column) -> Column:
        any_phrase = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in BOILERPLATE])
        hits = F.regexp_count(low, F.lit(f"(?<![^{ends}])[^{ends}]*?(?:{'|'.join(BOILERPLATE)})"))
        return let(F.regexp_count(low, F.lit(f"[^{SPACE}][^{ends}]*")), lambda lines: F.when(lines > 0, F.when(any_phrase, hits).otherwise(0) / lines))

    return let(F.lower(col(c)), share)


def boilerplate_heavy(c: Column | str) -> Column:
    return F.coalesce(boilerplate_fraction(c) > BOILERPLATE_SHARE, F.lit(True))


def language_ok(label: Column | str, text: Column | str) -> Column:
    """A label must be ``en``; without one the text must look English."""
    return F.when(col(label).isNotNull(), col(label) == "en").otherwise(looks_english(text))


def provenance(dataset: str, config: str, ident: Column, url: Column, index: Column) -> Column:
    """(dataset, config, doc_id): the id, else the URL, else the position; empty ones fall through."""
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    where = F.coalesce(blank(ident), blank(url), F.concat(F.lit("index-"), index.cast("string")))
    return F.struct(F.lit(dataset).alias("dataset"), F.lit(config).alias("config"), where.alias("doc_id"))


def register(url: Column | str) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(col(url), F.lit(""))), F.lit("news")), "news").otherwise("blog")


def prompt_variant(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in PROMPT_VARIANTS]), (position % len(PROMPT_VARIANTS) + 1).cast("int"))


def content_sha256(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def render_prompt(template: Column, prompt: Column, a: Column, b: Column) -> Column:
    """Fills the three places one after the other, so a mark inside the prompt is filled later on."""
    out = F.replace(template, F.lit("{prompt}"), prompt)
    return F.replace(F.replace(out, F.lit("{candidate_a}"), a), F.lit("{candidate_b}"), b)


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the joined parts: the first 32 bits of their MD5."""
    joined = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def order_by_hash(pair_id: Column | str, seed: int) -> Column:
    return F.when(hash_unit(str(seed), col(pair_id)) < 0.5, "model_first").otherwise("human_first")


def _vectorised(fn, kind: T.DataType):
    """A pandas UDF from a function of one value."""

    @F.pandas_udf(kind)
    def udf(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return udf


def order_by_mersenne(pair_id: Column | str, seed: int) -> Column:
    """As the seeded generator of Python's random module assigns it."""
    fn = lambda p: "model_first" if random.Random(f"{seed}:{p}").random() < 0.5 else "human_first"  # noqa: E731, S311
    return _vectorised(fn, T.StringType())(col(pair_id))


def pair_seed(pair_id: Column | str, base: int) -> Column:
    """32-bit seed of a pair: low half of its 64-bit BLAKE2b, read big-endian."""
    fn = lambda p: int.from_bytes(hashlib.blake2b(f"{base}:{p}".encode(), digest_size=8).digest(), "big") & 0xFFFFFFFF
    return _vectorised(fn, T.LongType())(col(pair_id))


def parse_choice(reply: Column | str) -> Column:
    """A or B if the reply is that letter, white space around it and full stops behind it aside; else invalid."""
    letter = F.regexp_extract(col(reply), f"^[{SPACE}]*([ABab])[{SPACE}]*\\.*[{SPACE}]*$", 1)
    return F.when(letter != "", F.upper(letter)).otherwise("invalid")


def model_won(choice: Column | str, order: Column | str) -> Column:
    c = col(choice)
    return F.when(c == "invalid", F.lit(None).cast("boolean")).when(col(order) == "model_first", c == "A").otherwise(c == "B")


def sentence_starts(c: Column | str) -> Column:
    """First word (letters and apostrophes, lower case) of each sentence that has one."""
    sentences = F.split(col(c), f"(?<=[.!?])[{SPACE}]+")
    return F.filter(F.transform(sentences, lambda s: F.lower(F.regexp_extract(s, "([A-Za-z']+)", 1))), lambda w: w != "")


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours in an array of strings."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda acc: acc["best"])


def repetition_run(c: Column | str) -> Column:
    return longest_run(sentence_starts(c))


def degeneration(text: Column | str, prior_length: Column) -> Column:
    """Checks of one rewrite as a struct; a blank text trips and leaves the other fields at their defaults."""
    t = col(text)
    empty = F.char_length(strip(t)) == 0
    ratio = F.when(prior_length > 0, F.char_length(t) / prior_length)
    ratio_trip = F.coalesce((ratio < RATIO_MIN) | (ratio > RATIO_MAX), F.lit(False))
    no, nothing = F.lit(False), F.lit(None).cast("double")

    def checked(fraction: Column, repeated: Column) -> Column:
        burst = fraction > BURST
        flags = F.filter(
            F.array(F.when(ratio_trip, "length_ratio"), F.when(burst, "non_ascii_burst"), F.when(repeated, "repetition")), lambda x: x.isNotNull()
        )
        return F.struct(no, ratio, ratio_trip, repeated, fraction, burst, ratio_trip | burst, flags).cast(DEGENERATION)

    blank = F.struct(F.lit(True), nothing, no, no, F.lit(0.0), no, F.lit(True), F.array(F.lit("empty"))).cast(DEGENERATION)
    full = let(non_ascii_fraction(t), lambda fraction: let(repetition_run(t) >= REPEATED_STARTS, lambda repeated: checked(fraction, repeated)))
    return F.when(empty, blank).otherwise(full)


def valid_probability(c: Column | str) -> Column:
    v = col(c)
    return v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0)


def human_probability(fraction_human: Column, fraction_ai: Column) -> Column:
    """Of a detector that reports either share."""
    return F.coalesce(fraction_human, 1 - fraction_ai)


def human_from_generated(completely_generated: Column) -> Column:
    return 1 - completely_generated


def corpus_of(pair_id: Column | str) -> Column:
    """What stands before the last dash; the whole id without one."""
    return F.regexp_replace(col(pair_id), "-[^-]*$", "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "_")


def report_corpus(tag: Column, candidate: Column, reference: Column) -> Column:
    """The tag, else ``personal`` for sets named so, else null."""
    own = candidate.startswith("personal-") | reference.startswith("personal-")
    return F.coalesce(F.nullif(tag, F.lit("")), F.when(own, "personal"))


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def round_of_artifact(name: Column | str) -> Column:
    """k of names like rewrite-k2.jsonl, else null."""
    return F.nullif(F.regexp_extract(col(name), r"^rewrite-k(\d+)(?:\..*)?$", 1), F.lit("")).cast("int")


def format_number(value: float | None) -> str:
    """Six significant digits; what wasn't run says so."""
    return "not run" if value is None or value != value else f"{value:.6g}"


def format_delta(delta: float | None, status: str | None) -> str:
    return "not comparable" if delta is None else f"{delta:+.6g} ({status})"
