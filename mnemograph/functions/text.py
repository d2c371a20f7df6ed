"""Text: cleaning, tokens, sentences, extraction by rules, hashes."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name nothing.
STOP_WORDS = (
    "the and for are but not you all any can her was one our out day get has him his how man new now old see two way "
    "who its did that this with from they have will your what when which their said each she them then were been more "
    "these those such into than"
).split()

# Relation patterns, each a subject and an object.
RELATIONS = (
    ("is_a", r"([A-Za-z][\w\s-]{2,40}?)\s+is\s+(?:a|an|the)\s+([A-Za-z][\w\s-]{2,40})"),
    ("created_by", r"([A-Za-z][\w\s-]{2,40}?)\s+(?:was\s+)?(?:created|developed|written|founded|built)\s+by\s+([A-Z][\w\s-]{2,40})"),
    ("uses", r"([A-Za-z][\w\s-]{2,40}?)\s+(?:uses|supports|includes|contains|enables)\s+([A-Za-z][\w\s-]{2,40})"),
    ("released_in", r"([A-Za-z][\w\s-]{2,40}?)\s+(?:released|published|introduced)\s+(?:in|on)\s+([0-9]{4})"),
)

# Patterns of marks (and what takes their place), salient words, capitalised phrases, sentence ends and statements.
MARKDOWN = ((r"```[\w-]*\n?", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[#*_>`]{1,3}", ""))
SALIENT = r"([A-Za-z][A-Za-z0-9_-]{2,})"
CAPITALISED = r"\b([A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*)\b"
SENTENCE_END = r"(?<=[.!?])\s+"
PROPOSITION = r"(?is)^(.+?)\s+(?:is|was|are|=|:)\s+(.+)$"


def sanitize(x: Column) -> Column:
    """One kind of line end, no control characters but tab and line feed."""
    return F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def squeeze(x: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_markdown(x: Column) -> Column:
    """Without code fences, link targets and runs of up to three marks."""
    for pattern, put in MARKDOWN:
        x = F.regexp_replace(x, pattern, put)
    return x


_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def unescape(x: Column) -> Column:
    """Character references of HTML as their characters, in one pass: all named ones, and numbers; unknown ones stay.

    Names come from the table of the language's library. Numbers that are no character give the replacement character.
    """
    # a map is searched from its beginning, so the usual names come first, in one of their own
    usual = F.create_map(*[F.lit(y) for n in ("amp", "nbsp", "quot", "lt", "gt", "copy", "middot") for y in (n, html5[n + ";"])])
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def char(e: Column) -> Column:
        code = F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 6), 16, 10)).otherwise(F.conv(F.substring(e, 2, 7), 10, 10)).cast("long")
        good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        drawn = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0")), "UTF-32")
        return F.when(e.startswith("#"), drawn).otherwise(F.coalesce(F.try_element_at(usual, e), F.try_element_at(names, e), F.concat(F.lit("&"), e, F.lit(";"))))

    def whole(t: Column) -> Column:
        # side by side, so that neither is worked out again for each part
        pairs = F.arrays_zip(F.split(t, _ENTITY, -1).alias("t"), F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1)).alias("e"))
        parts = F.transform(pairs, lambda p: F.concat(p["t"], F.coalesce(F.when(p["e"].isNotNull(), char(p["e"])), F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    # bound to a name, so that what x is made of is worked out once
    return F.get(F.transform(F.array(x), whole), F.lit(0))


def html_text(x: Column, most: int = 100_000) -> Column:
    """What a page says: no scripts, styles and tags, character references as characters, squeezed, at most ``most`` characters."""
    x = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    x = unescape(F.regexp_replace(x, r"(?s)<[^>]+>", " "))
    return F.substring(squeeze(F.replace(x, F.lit("\u00a0"), F.lit(" "))), 1, most)


def words(x: Column, least: int = 1) -> Column:
    """Lower-case runs of ``[a-z0-9]`` of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(x), F.lit(rf"([a-z0-9]{{{least},}})"), F.lit(1))


def unicode_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def salient_words(x: Column) -> Column:
    """Lower-case words of letters, digits, _ and -, of three characters or more, that begin with a letter."""
    return F.transform(F.regexp_extract_all(x, F.lit(SALIENT), F.lit(1)), F.lower)


def pieces(x: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1))


def sentences(x: Column) -> Column:
    """Trimmed sentences, cut where white space follows . ! or ?"""
    # trim itself takes a second argument, for which transform would pass the place
    return F.filter(F.transform(F.split(F.trim(x), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def concepts(x: Column, most: int = 12) -> Column:
    """The first distinct words of four letters or more that are no stop words."""
    return F.slice(F.array_distinct(F.filter(salient_words(x), lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))), 1, most)


def capitalised(x: Column) -> Column:
    """Phrases of capitalised words, without stop words and those under three characters."""
    found = F.regexp_extract_all(x, F.lit(CAPITALISED), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda p: (F.length(p) > 2) & ~F.lower(p).isin(STOP_WORDS))


def entities(x: Column) -> Column:
    """The first eight distinct capitalised phrases, or else three concepts."""
    found = F.slice(F.array_distinct(capitalised(x)), 1, 8)
    return F.when(F.size(found) > 0, found).otherwise(concepts(x, 3))


def relations(x: Column, most: int = 6) -> Column:
    """(subject, relation, object) by the patterns of ``RELATIONS``, in their order; the first ``most``."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"[.,;]+$", "")

    def triple(name: str, pattern: str):
        # the long scan runs once, and its groups are read from the short matches
        return lambda m: F.struct(bare(F.regexp_extract(m, pattern, 1)).alias("subject"), F.lit(name).alias("relation"), bare(F.regexp_extract(m, pattern, 2)).alias("object"))

    parts = []
    for name, pattern in RELATIONS:
        verb = pattern[pattern.index(r"\s+") : pattern.rindex("(")]
        some = F.when(x.rlike(verb), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        parts.append(F.transform(some, triple(name, pattern)))
    found = F.filter(F.concat(*parts), lambda r: ~F.lower(r["subject"]).isin(STOP_WORDS) & ~F.lower(r["object"]).isin(STOP_WORDS))
    return F.slice(found, 1, most)


def lead(x: Column, n: int = 2) -> Column:
    """The first n sentences, or the first 200 characters of a text that has none."""
    s = sentences(x)
    return F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, n), " ")).otherwise(F.substring(x, 1, 200))


def proposition(x: Column) -> Column:
    """(subject, value), lower-case and trimmed, of "subject is value"; null where the text is none."""
    x = F.trim(x)
    subject = F.lower(F.trim(F.regexp_extract(x, PROPOSITION, 1)))
    return F.when(subject != "", F.struct(subject.alias("subject"), F.lower(F.trim(F.regexp_extract(x, PROPOSITION, 2))).alias("value")))


def cut_at_word(x: Column, most: int = 220) -> Column:
    """Squeezed; a longer text ends at its last blank before ``most`` with an ellipsis."""
    x = squeeze(F.coalesce(x, F.lit("")))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most), r" [^ ]*$", ""), F.lit("…")))


def piece_tokens(x: Column) -> Column:
    return F.size(pieces(x)).cast("long")


def quarter_tokens(x: Column) -> Column:
    """A token for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def relevance(sentence: Column, query_tokens: Column) -> Column:
    """How many distinct query tokens a sentence has."""
    return F.size(F.array_intersect(unicode_words(sentence), query_tokens)).cast("long")


def citation_errors(x: Column, units: Column) -> Column:
    """Marks [n] outside 1 to ``units``."""
    n = F.transform(F.regexp_extract_all(x, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda s: s.cast("int"))
    return F.size(F.filter(n, lambda i: (i < 1) | (i > units))).cast("long")


def degenerate(x: Column) -> Column:
    """Fewer than ten letters besides citation marks."""
    return F.length(F.regexp_replace(F.regexp_replace(x, r"\[[0-9]+\]", ""), r"[^\p{L}]", "")) < 10


def stable_hash(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def chain_key(x: Column) -> Column:
    return stable_hash(F.lower(F.trim(x)))


def canonical_title(x: Column) -> Column:
    """Lower-case, without what stands before the first ": "."""
    x = F.lower(x)
    return F.trim(F.when(F.instr(x, ": ") > 0, F.regexp_replace(x, r"(?s)^.*?: ", "")).otherwise(x))


# Which class of evidence a source is, by what its name holds; the first that fits.
EVIDENCE = (
    ("anumana", ("consolidat", "replay", "gist", "merge", "derived", "anuma", "rollback")),
    ("upamana", ("similar", "analogy", "analog", "compare", "upama")),
    ("shabda", ("web", "doc", "ingest", "url", "citation", "cited", "file", "pdf")),
    ("pratyaksa", ("chat", "user", "sdk", "direct", "manual")),
)
EVIDENCE_RANK = {"pratyaksa": 2, "shabda": 1, "upamana": 1, "anumana": 0}


def evidence_class(source: Column) -> Column:
    out = F.lit("shabda")
    for name, parts in reversed(EVIDENCE):
        out = F.when(F.lower(F.coalesce(source, F.lit(""))).rlike("|".join(parts)), F.lit(name)).otherwise(out)
    return out


def evidence_rank(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in EVIDENCE_RANK.items():
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


# Digits of romanised consonants; longer spellings are read first, all else is 0.
DIGITS = {
    "chh": "7", "jh": "9", "kh": "2", "gh": "4", "Th": "2", "Dh": "4", "th": "7", "dh": "9", "ph": "2", "bh": "4", "ch": "7", "sh": "5", "~n": "0", "~N": "5",
    "k": "1", "g": "3", "G": "5", "c": "6", "j": "8", "T": "1", "D": "3", "N": "5", "t": "6", "d": "8", "n": "0", "p": "1", "b": "3", "m": "5",
    "y": "1", "r": "2", "l": "3", "v": "4", "z": "5", "S": "6", "s": "7", "h": "8", "x": "0",
}


def syllable_digits(x: Column) -> Column:
    """One digit for each consonant spelling of a text, the longest first; white space is skipped, others give 0."""
    spellings = sorted(DIGITS, key=lambda s: -len(s))
    found = F.regexp_extract_all(F.trim(x), F.lit("(" + "|".join(spellings) + r"|(?s:\S))"), F.lit(1))
    table = F.create_map(*[y for k, v in DIGITS.items() for y in (F.lit(k), F.lit(v))])
    digits = F.transform(found, lambda s: F.coalesce(F.try_element_at(table, s), F.try_element_at(table, F.lower(s)), F.lit("0")))
    return F.when(F.size(digits) > 0, F.array_join(digits, "")).otherwise(F.lit("0"))


def hash_features(x: Column, dims: int = 384) -> Column:
    """(i, v) entries of the hashing embedder: character trigrams count 1, words 2, signed by an MD5 byte."""
    low = F.lower(x)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.struct(F.substring(low, i, F.lit(3)).alias("g"), F.lit(1.0).alias("w")))
    both = F.concat(grams, F.transform(pieces(low), lambda t: F.struct(t.alias("g"), F.lit(2.0).alias("w"))))

    def entry(e: Column) -> Column:
        d = F.md5(e["g"].cast("binary"))
        index = F.conv(F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2)), 16, 10).cast("int") % dims
        odd = F.conv(F.substring(d, 5, 2), 16, 10).cast("int") % 2
        return F.struct(index.alias("i"), F.when(odd == 0, e["w"]).otherwise(-e["w"]).alias("v"))

    return F.transform(both, entry)
