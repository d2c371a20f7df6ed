"""Quality rules (operator 4): a rule bitmask ledger.

``measure`` evaluates every rule once over every whole text; ``ledger`` turns the measurements into a mask of failure
bits, one for each rule of ``RULES``. ``write_ledger`` stores both, without the texts, as a table. A policy is a versioned
set of bits (``POLICIES``): applying all of them (``verdicts``), or counting what would change without one of a policy's
rules (``ablation``), is bit arithmetic on the stored masks and reads no text again.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text is an empty one: it has no words and fails. Repeated rows are kept. An empty
table gives an empty result. Other columns are not read. Letters and capitals are those of every script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, table
from .textblocks import Words, blocks, span_hashes, text_bytes, windows

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines")

#: name -> fails, over the measurements; the place in this list is the bit.
RULES: list[tuple[str, Column | object]] = [
    ("too_few_words", lambda: F.col("n_words") < 50),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ("too_many_symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    ("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    ("capitals", lambda: 2 * F.col("n_upper") > F.col("n_letters")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: version -> the bits that reject a text
POLICIES = {"base": BASE, "v1": BASE | BIT["too_many_symbols"], "v2": sum(BIT.values())}
POLICY = "v2"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _by_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def _cased(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte begins a capital, and whether it begins a letter, of any script."""
    upper, letter = _UPPER[raw], _LETTER[raw]
    at = np.flatnonzero(raw >= 0xC0)
    if len(at):
        points, which = np.unique(np.frombuffer(raw[raw >= 0x80].tobytes().decode().encode("utf-32-le"), "<u4"), return_inverse=True)
        chars = [chr(p) for p in points]
        letter[at] = np.array([c.isalpha() for c in chars])[which]
        upper[at] = np.array([c.isalpha() and c.isupper() for c in chars])[which]
    return upper, letter


def _repeats(words: Words, k: int = 3) -> np.ndarray:
    """By text, the words in windows of ``k`` words that stand in the text twice or more."""
    w, at = windows(words.hashes(), words.per_text, k)
    real = words.counts >= k
    text_of = np.repeat(np.arange(len(words.counts)), np.diff(at))
    # a text's number goes into the key, so that one sort serves the whole block
    order = np.lexsort((w, text_of))
    ws, ts = w[order], text_of[order]
    same = np.zeros(len(ws) + 1, bool)
    same[1:-1] = (ws[1:] == ws[:-1]) & (ts[1:] == ts[:-1])
    twice = np.zeros(len(w), bool)
    twice[order] = (same[1:] | same[:-1]) & real[ts]
    covered = np.zeros(len(words.starts) + k, bool)
    first = (words.per_text[:-1] - at[:-1])[text_of] + np.arange(len(w))
    for j in range(k):
        covered[first[twice] + j] = True
    return _by_text(covered[: len(words.starts)], words.per_text)


def _lines(raw: np.ndarray, offs: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """By text, the lines (cut at line feeds), and those with a word that equal an earlier line."""
    feeds = np.flatnonzero(raw == 10)
    per = np.searchsorted(feeds, offs)
    counts = np.diff(per) + 1
    at = np.concatenate([[0], np.cumsum(counts)])
    # a text's first line begins with the text, and its last one ends with it
    starts, ends = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    starts[at[:-1]], starts[inner] = offs[:-1], feeds + 1
    inner[:] = True
    inner[at[1:] - 1] = False
    ends[at[1:] - 1], ends[inner] = offs[1:], feeds
    text_of = np.repeat(np.arange(len(counts)), counts)
    some = np.concatenate([[0], np.cumsum(words.inside)])
    lines = np.flatnonzero(some[ends] > some[starts])
    h, owner = span_hashes(raw, starts[lines], ends[lines]), text_of[lines]
    order = np.lexsort((h, owner))
    again = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return counts, np.bincount(owner[order][1:][again], minlength=len(counts))


def _measures(column: pa.Array) -> list[pa.Array]:
    raw, offs = text_bytes(column)
    words = Words(raw, offs)
    upper, letter = _cased(raw)
    lines, again = _lines(raw, offs, words)
    got = [words.counts, _by_text(words.inside & ((raw & 0xC0) != 0x80), offs), _by_text(_SYMBOL[raw], offs), again, _repeats(words), _by_text(upper, offs), _by_text(letter, offs), lines]
    return [pa.array(x.astype(np.int64)) for x in got]


def measure(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, whatever their names) and one long for each of ``MEASURES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.compute.struct_field(batch.column(0), "text").cast(pa.string()), pa.array(range(batch.num_rows), pa.int64())], ["text", "i"])
            for b in blocks(texts):
                at = b.column("i")[0].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, b.num_rows), *_measures(b.column("text"))], ["row", *MEASURES])

    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = T.StructType([*row.schema, *(T.StructField(n, T.LongType()) for n in MEASURES)])
    return row.mapInArrow(run, schema)


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failures``: the bits of the rules that fail."""
    bits = [F.when(fails(), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, fails in RULES]
    return measured.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def write_ledger(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored ledger of ``docs`` (doc_id, text): doc_id, one long for each of ``MEASURES``, failures."""
    book = ledger(measure(docs.select("doc_id", "text")))
    return scratch.keep(book.select("row.doc_id", *MEASURES, "failures"), "ledger")


def _passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``kept``: whether no bit of the policy is set."""
    return book.withColumn("kept", _passes(policy))


def verdicts(book: DataFrame) -> DataFrame:
    """Adds ``kept_<version>`` for each policy, all from one mask."""
    return book.withColumns({f"kept_{version}": _passes(version) for version in POLICIES})


def ablation(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """rule, failed, alone: rows that fail each rule of a policy, and rows that only this rule rejects."""
    hit = F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    masks = book.groupBy(hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & POLICIES[policy]]))
    one = masks.select("hit", "n", rules.alias("r")).where(F.col("hit").bitwiseAND(F.col("r.bit")) != 0)
    return one.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("failed"), F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"))


def keep_good(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of ``docs`` that a policy keeps."""
    return apply_policy(ledger(measure(docs)), policy).where("kept").select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = verdicts(apply_policy(write_ledger(table(spark, sf_dir, "documents"), Scratch(spark, "quality"))))
    failed = (F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed")
    return book.select("doc_id", *MEASURES[:5], failed, "kept", "failures", *[f"kept_{v}" for v in POLICIES])


_SPACES = r"\x09-\x0D\x20"
#: Words, lines and windows are cut anew; the rules are those of RULES.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{_SPACES}]+') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(3) AS s(j) GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[{_SPACES}]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(l, lambda x: regexp_matches(x, '[^{_SPACES}]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^{_SPACES}]')))) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters
  FROM w LEFT JOIN covered USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN {BIT["too_few_words"]} ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN {BIT["repeated_windows"]} ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN {BIT["too_many_symbols"]} ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN {BIT["short_words"]} ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN {BIT["long_words"]} ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN {BIT["repeated_lines"]} ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters THEN {BIT["capitals"]} ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {BASE} <> 0 AS base_failed, failures & {POLICIES[POLICY]} = 0 AS kept, failures,
       {", ".join(f"failures & {bits} = 0 AS kept_{v}" for v, bits in POLICIES.items())} FROM f
"""
