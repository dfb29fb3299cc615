"""Text functions as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters whose full case folding differs from lower case in letters a-z, and the folding; a combining
# mark in a folding counts as a space, as everything beyond a-z and 0-9 does.
FOLDED = {
    "ß": "ss", "ẞ": "ss", "ŉ": " n", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a ", "ſ": "s",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}

# Tokens before a period that do not end a sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "cf", "approx", "ca", "no", "nr", "dr", "mr", "mrs", "ms", "prof", "jr", "sr", "st",
    "inc", "ltd", "co", "corp", "u.s", "u.k", "a.m", "p.m", "min", "max", "sec", "fig", "vol", "dept", "est", "al",
    "z.b", "bzw", "ggf", "usw", "vgl", "str", "tel", "evtl", "u.a", "d.h", "z.t", "s.o", "s.u",
)

# The families of secrets, and what they look like.
SECRETS = {
    "api key": r"\b(sk-(ant-)?[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}"
    r"|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|hf_[A-Za-z0-9]{30,}|fw_[A-Za-z0-9]{20,}"
    r"|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}|[sr]k_live_[A-Za-z0-9]{20,}"
    r"|ya29\.[A-Za-z0-9_-]{20,}|xapp-\d-[A-Za-z0-9-]{20,}|ASIA[0-9A-Z]{16}|dop_v1_[a-f0-9]{64}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|shp(at|ss|ca|pa)_[a-fA-F0-9]{32})",
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{10,}",
    "bot token": r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b",
    "credential assignment": r"(?i)\b(password|passwort|passwd|pwd|secret|api[_ -]?key|bearer)\b\s*(is|=|:)\s*[\"']?[^\s\"']{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,4})?\b",
}

# Fixed value: what stands between two sentences: closing marks, white space, and before a capital or a digit perhaps an opening mark.
BOUNDARY = r"([.!?]+)(?U:\s+)(?=[\"'(\[]?[A-Z0-9ÄÖÜ])"

_MARK = "\uf8ff"


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized_name(c: Column) -> Column:
    """Case folded, every run of other than 0-9 and a-z one space, no space at the ends; "" for null."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    folded = lower
    for one, many in FOLDED.items():
        folded = F.replace(folded, F.lit(one), F.lit(many))
    ascii_only = F.length(lower) == F.octet_length(lower)
    return F.trim(F.regexp_replace(F.when(ascii_only, lower).otherwise(folded), "[^0-9a-z]+", " "))


def words(c: Column) -> Column:
    """Distinct words (Unicode letters, digits and underscores), lower case, in order of first appearance."""
    return F.array_distinct(tokens(c))


def tokens(c: Column) -> Column:
    """Runs of letters, numbers and underscores of any script, lower case; a combining mark is none of these."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def overlap_of_words(a: Column, b: Column) -> Column:
    """Jaccard of two word sets; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def word_overlap(a: Column, b: Column) -> Column:
    return overlap_of_words(words(a), words(b))


def sentences(c: Column) -> Column:
    """Sentences: a break is a run of .!? and white space before a capital or a digit (perhaps quoted), unless the token
    before the run is an abbreviation or a single initial. Runs of dots count as a space."""
    known = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
    # The look-ahead comes first, so that the long look-behind is tried at closing marks alone.
    kept = rf"(?=[.!?])(?<![.!?])(?<!(?<![A-Za-z.])(?i:{known}|[a-z]))"
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\.{2,}", " "), kept + BOUNDARY, f"$1{_MARK}")
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda s: s != "")


def is_atomic(c: Column) -> Column:
    """At most one sentence."""
    return F.size(sentences(c)) <= 1


def embed(c: Column, width: int = 64) -> Column:
    """A vector of a text without a model: its words hashed to places and signs, to length 1; null without words."""
    hashed = F.transform(tokens(c), lambda w: F.xxhash64(w))
    sign = lambda h: F.when(F.shiftrightunsigned(h, 32) % 2 == 0, 1.0).otherwise(-1.0)
    at = lambda i: F.aggregate(hashed, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(width)) == i, sign(h)).otherwise(0.0))
    v = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float")))


def secret_shapes(*texts: Column) -> Column:
    """Names of the secret families found in the texts, which are looked at line by line after each other."""
    joined = F.concat_ws("\n", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.array_compact(F.array(*[F.when(joined.rlike(p), F.lit(name)) for name, p in SECRETS.items()]))


def clean_query(c: Column) -> Column:
    """A question without tokens that are a lone underscore; null if nothing is left."""
    kept = F.filter(F.split(strip(c), r"(?U)\s+"), lambda t: (t != "_") & (t != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def correction_body(operation: Column, text: Column, valid_at: Column, created_at: Column, supersedes: Column) -> Column:
    """What an approved proposal says as an episode: the text of an assertion, else a dated correction."""
    day = F.substring(F.coalesce(F.when(valid_at != "", valid_at), created_at), 1, 10)
    return F.when(operation == "assert", text).otherwise(F.concat(F.lit("Correction as of "), day, F.lit(": "), text, F.lit(" This supersedes: "), supersedes))


def provenance_line(fact_type: Column, provenance: Column, source: Column, link: Column, learned_at: Column, said: Column, origin: str = "workspace") -> Column:
    """Where a proposal came from, in one line; empty parts are left out."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("; ", F.lit(origin), fact_type, F.coalesce(F.when(provenance != "", provenance), F.lit("unspecified")), part("source", source), part("link", link), part("learned_at", learned_at), part("said", said))
