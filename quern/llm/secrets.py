"""Secret scan: fixed patterns, and tokens that one owner alone holds anywhere in the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Stages, read_table

#: kind: (pattern, group whose length counts, least length). Spans are those of the whole match.
KINDS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Tokens whose ownership is counted: long, with letters and digits, of many different characters.
TOKEN = r"[A-Za-z0-9_-]{20,}"
TOKEN_VARIETY = 10
OWNED = "owned"

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


PIECE = "array<struct<gap:int,size:int,counted:int,value:string>>"


def pieces(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: code points before each since the one before, its own, those that count, and its value."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    found = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"), counted.alias("c")), lambda x: F.struct(
        F.length(x["g"]).alias("gap"), F.length(x["h"]).alias("size"), F.length(x["c"]).alias("counted"), x["c"].alias("value")
    ))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(PIECE))


def is_token(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= TOKEN_VARIETY)


def find_spans(rows: DataFrame) -> DataFrame:
    """(_row, _span) of ``rows(_row, _p0, ...)``, a column of pieces for each kind: base spans, and tokens that touch none of them.

    Places are running sums over a text's pieces, and a token is compared with the furthest end of the base spans that
    begin before its own end: the work grows with the number of matches, not with its square.
    """
    kinds = [(k, least) for k, (_, _, least) in KINDS.items()] + [(OWNED, 20)]
    found = reduce(DataFrame.union, [
        rows.where(F.size(f"_p{rank}") > 0).select("_row", F.lit(rank).alias("rank"), F.posexplode(f"_p{rank}").alias("i", "x"))
        for rank in range(len(kinds))
    ])
    before = Window.partitionBy("_row", "rank").orderBy("i")
    named = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), F.col("rank") + 1)
    least = F.element_at(F.array(*[F.lit(n) for _, n in kinds]), F.col("rank") + 1)
    spans = found.withColumn("end", F.sum((F.col("x.gap") + F.col("x.size")).cast("long")).over(before)).where(F.col("x.counted") >= least)
    spans = spans.where((F.col("rank") < len(KINDS)) | is_token(F.col("x.value"))).select(
        "_row", F.struct((F.col("end") - F.col("x.size")).alias("start"), "rank", "end", named.alias("kind"), F.col("x.value").alias("value")).alias("_span")
    )
    base = F.col("_span.rank") < len(KINDS)
    order = Window.partitionBy("_row").orderBy(F.when(base, F.col("_span.start")).otherwise(F.col("_span.end")), base)
    reach = F.max(F.when(base, F.col("_span.end"))).over(order)
    return spans.withColumn("_reach", reach).where(base | F.col("_reach").isNull() | (F.col("_reach") <= F.col("_span.start"))).drop("_reach")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str | None = None, max_repositories: int | None = None) -> DataFrame:
    """Base and owner-specific spans of every row of ``docs``.

    Each whole text is scanned once for the fixed patterns and for candidate tokens. Values of both are hashed and
    counted over the corpus: distinct owners and distinct repositories. A repository is a different text, or a value of the
    column ``repository``: copies of a text are one. A candidate token that one owner alone holds is live-looking and
    becomes a span of kind ``owned``, however many rows of the owner repeat it (with ``max_repositories``: if it lies in
    at most so many of the owner's repositories); a value that several owners hold is a copied example. Returns the columns
    of ``docs`` without text, plus ``base`` and ``owned`` (arrays of start, rank, end, kind, value) and ``live`` (values of
    base spans that one owner alone holds).

    Null and empty text: no spans. Texts of any length are scanned whole. A null owner is an owner of its own. Repeated rows
    each get their spans. An empty table gives no rows. Other columns pass through, but input columns named ``base``,
    ``owned`` or ``live`` give way to the result's. Counting is map-side combined per (value, owner, repository), so a
    common value is a few rows per task; the join back is on the value's hash.
    """
    stages = Stages(docs.sparkSession, "secrets")
    keep = [c for c in docs.columns if c not in ("text", "base", "owned", "live")]
    value = F.coalesce("text", F.lit(""))
    patterns = [(p, g) for p, g, _ in KINDS.values()] + [(TOKEN, 0)]
    scanned = stages.table(docs.select(
        F.struct(*keep).alias("_doc"), F.struct(F.col(owner)).alias("_owner"), F.struct(F.col(repository) if repository else F.xxhash64("text")).alias("_repo"),
        F.monotonically_increasing_id().alias("_row"), *[pieces(value, p, g).alias(f"_p{i}") for i, (p, g) in enumerate(patterns)],
    ))
    found = stages.table(find_spans(scanned.select("_row", *[f"_p{i}" for i in range(len(patterns))])))
    hashed = (
        found.join(scanned.select("_row", "_owner", "_repo"), "_row").withColumn("_h", F.sha2(F.col("_span.value"), 256))
    )
    owners = (
        hashed.groupBy("_h", "_owner", "_repo").agg(F.lit(1).alias("x"))
        .groupBy("_h", "_owner").agg(F.count("*").alias("repos"))
        .groupBy("_h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
        .where((F.col("owners") == 1) & (F.lit(max_repositories is None) | (F.col("repos") <= (max_repositories or 0))))
        .select("_h")
    )
    marked = hashed.join(owners.withColumn("_alone", F.lit(True)), "_h", "left").where((F.col("_span.rank") < len(KINDS)) | F.col("_alone"))
    grouped = marked.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("_span.rank") < len(KINDS), F.col("_span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("_span.rank") >= len(KINDS), F.col("_span")))).alias("owned"),
        F.sort_array(F.collect_list(F.when((F.col("_span.rank") < len(KINDS)) & F.col("_alone"), F.col("_span")))).alias("alone"),
    )
    none = F.array().cast(SPAN)
    return scanned.select("_row", "_doc").join(grouped, "_row", "left").select(
        "_doc.*", F.coalesce("base", none).alias("base"), F.coalesce("owned", none).alias("owned"),
        F.transform(F.coalesce("alone", none), lambda s: s["value"]).alias("live"),
    )


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "owned"))).alias("spans"),
    )


def _spans_sql(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    """Spans of one kind: gaps and matches alternate, so a match begins after the lengths before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT id, source, '{kind}' AS kind, {rank} AS rank, c[i] AS value,
       CAST(list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(h[i]) AS n
FROM (SELECT id, source, g, h, c, unnest(range(1, len(h) + 1)) AS i FROM (
  SELECT id, source, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS h, regexp_extract_all(text, {p}, {group}) AS c FROM d WHERE regexp_matches(text, {p})))
WHERE length(c[i]) >= {least}"""


OP7_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),\nb AS ("
    + "\nUNION ALL".join(_spans_sql(k, *KINDS[k], rank) for rank, k in enumerate(KINDS))
    + "),\nt AS (" + _spans_sql(OWNED, TOKEN, 0, 20, len(KINDS)) + rf"""
), o AS (
  SELECT * FROM t WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {TOKEN_VARIETY}
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = t.id AND b.a < t.a + t.n AND t.a < b.a + b.n)
), v AS (SELECT value FROM (SELECT * FROM b UNION ALL SELECT * FROM o) z JOIN d USING (id) GROUP BY value
         HAVING count(DISTINCT coalesce('x' || d.source, '')) = 1
), y AS (SELECT *, kind || ':' || a || ':' || (a + n) AS s FROM (SELECT * FROM b UNION ALL SELECT * FROM o WHERE value IN (SELECT value FROM v))),
j AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(s, ',' ORDER BY a, rank) FILTER (kind <> '{OWNED}') AS base, string_agg(s, ',' ORDER BY a, rank) AS spans FROM y GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON j.id = d.id
"""
)
