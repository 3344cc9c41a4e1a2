"""Column builders for tokens, grams, identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Everything str.isspace() accepts, as a Java character class.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"

# Characters per token of the estimate, and the ranges counted as CJK (Han, extension A, compatibility,
# CJK punctuation, full-width forms).
CJK_CHARS_PER_TOKEN = 1.57
LATIN_CHARS_PER_TOKEN = 4.49
CJK_CLASS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim of all Unicode white space, not of spaces only."""
    return F.regexp_replace(text, rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), rf"{WHITESPACE}+", " ")


def chars(text: Column) -> Column:
    """The code points of a text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams without white space; a shorter text is its own gram, an empty or null one has none."""
    if n < 1:
        raise ValueError(f"n must be positive, got {n}")
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITESPACE}+", "")
    if n == 1:
        return chars(bare)
    # one code point is consumed at a time and looks ahead at its gram, or from the start at a whole shorter text
    return F.regexp_extract_all(bare, F.lit(rf"(?s)(?=(.{{{n}}}|\A.{{1,{n - 1}}}\z))."), F.lit(1))


def union_grams(text: Column, *analyzers) -> Column:
    """All analyzers' grams, with multiplicity."""
    return F.concat(*[a(text) for a in analyzers])


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK_CLASS))


def cjk_ratio(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(cjk_count(text) / F.length(text))


def estimate_tokens(text: Column) -> Column:
    """Estimated model tokens of a mixed text; half goes to even, a text that is not empty has one at least."""
    cjk = cjk_count(text)
    value = cjk / CJK_CHARS_PER_TOKEN + (F.length(text) - cjk) / LATIN_CHARS_PER_TOKEN
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), F.rint(value).cast("long"))
    )


def containment(query_grams: Column, text_grams: Column) -> Column:
    """Share of the distinct query grams that the text holds; 0 without query grams."""
    q = F.array_distinct(query_grams)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text_grams)) / F.size(q))


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / F.size(F.array_union(left, right)))


def framed(*fields: Column) -> Column:
    """Fields one after another, each behind its length in bytes as an unsigned 64-bit integer."""
    parts = []
    for f in fields:
        data = F.encode(f, "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data]
    return F.concat(*parts)


def framed_sha256(*fields: Column) -> Column:
    return F.sha2(framed(*fields), 256)


def document_id(text: Column) -> Column:
    """First 16 hex digits of the hash of the stripped text."""
    return F.substring(F.sha2(strip(text), 256), 1, 16)


def git_blob_sha1(content: Column) -> Column:
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def keyed_digest(schema: str, seed: str, *fields: Column) -> Column:
    """A digest that orders rows independently of their rank."""
    return framed_sha256(F.lit(schema), F.lit(seed), *fields)


def derived_seed(schema: str, seed: str, *names: Column) -> Column:
    """The first 8 bytes of the framed digest as an unsigned number."""
    return F.conv(F.substring(keyed_digest(schema, seed, *names), 1, 16), 16, 10).cast("decimal(20,0)")


def list_fingerprint(schema: str, items: Column) -> Column:
    """Digest of an ordered array of strings: a digest over the framed digests of its items."""
    return F.sha2(F.concat(framed(F.lit(schema)), F.encode(F.array_join(F.transform(items, lambda x: F.sha2(x, 256)), ""), "UTF-8")), 256)


def model_names_match(requested: Column, served: Column) -> Column:
    """Equal but for the case of ASCII letters; an empty or missing name matches nothing."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce((F.length(requested) > 0) & (lower(requested) == lower(served)), F.lit(False))


def safe_source_url(value: Column) -> Column:
    """The value if it is an http or https address with a host and without user, else null; white space, control
    characters, backslashes and more than 4,000 characters are refused."""
    fine = (F.length(value) <= 4000) & ~value.rlike(r"[\x00-\x20\\]") & value.rlike(r"(?i)^https?://[^/?#@:][^/?#@]*([/?#]|$)")
    return F.when(fine, value)


def rerank_tokens(query: Column, documents: Column, head: str, tail: str) -> Column:
    """Estimated tokens of an array of documents, each within the scaffold ``head + query + document + tail``."""
    whole = lambda d: estimate_tokens(F.concat(F.lit(head), query, d, F.lit(tail)))
    return F.aggregate(documents, F.lit(0).cast("long"), lambda s, d: s + whole(d).cast("long"))
