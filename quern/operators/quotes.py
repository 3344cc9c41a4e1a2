"""Quotes found in texts: many patterns at once over normalised texts, with places in the original."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Links keep their text, shortcodes and tags go, and so do white space and the signs of markup.
_KEPT = (r"\[([^\]]*)\]\([^)]*\)", r"\{\{<[^}]{0,80}>\}\}", r"<[^<>\n]{1,80}>")
_GONE = r"[\s*`_>#|\-\[\]+()]+"

_FORMS = [re.compile(x) for x in _KEPT]
_SIGNS = re.compile(_GONE)
#: Bytes of quotes whose automaton is broadcast at once; the texts are read once for each block of quotes.
BLOCK_BYTES = 8 << 20


def normalised(text: str) -> tuple[str, list[int]]:
    """The text without markup and white space, case-folded, and the place in the original of each of its characters."""
    places = list(range(len(text)))
    for form in _FORMS:
        parts, kept, at = [], [], 0
        for m in form.finditer(text):
            inner = m.span(1) if form.groups else (m.end(), m.end())
            for a, b in ((at, m.start()), inner):
                parts.append(text[a:b])
                kept += places[a:b]
            at = m.end()
        text, places = "".join([*parts, text[at:]]), kept + places[at:]
    out, kept = [], []
    at = 0
    for m in [*_SIGNS.finditer(text), None]:
        for i in range(at, m.start() if m else len(text)):
            folded = text[i].casefold()
            out.append(folded)
            kept += [places[i]] * len(folded)
        at = m.end() if m else 0
    return "".join(out), kept


def automaton(quotes: dict[str, list]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for quote, ids in quotes.items():
        out.add_word(quote, (len(quote), ids))
    out.make_automaton()
    return out


def quote_places(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, start, end) of every place of ``quotes(quote_id, quote)`` in ``docs(doc_id, text)``, overlapping ones too.

    Both are compared as ``normalised`` has them; places are code points of the original text, from the first character of the
    quote to behind its last. The quotes of a block make one automaton, built in each task from a broadcast of at most
    BLOCK_BYTES (of one quote, if that is longer); a text is read once a block, however many quotes there are. A quote of
    nothing but markup, a null quote and a null text are found nowhere.
    """
    spark = docs.sparkSession
    size = quotes.agg(F.sum(F.octet_length("quote"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    kinds = [next(f.dataType for f in df.schema if f.name == c) for df, c in ((quotes, "quote_id"), (docs, "doc_id"))]
    types = [*(to_arrow_type(k) for k in kinds), pa.int64(), pa.int64()]
    schema = f"quote_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, start long, end long"

    def block(number: int) -> DataFrame:
        wanted: dict[str, list] = {}
        some = quotes.where(F.col("quote").isNotNull() & (F.pmod(F.xxhash64("quote"), F.lit(blocks)) == number))
        for r in some.select("quote_id", "quote").collect():  # BLOCK_BYTES on average
            if found := normalised(r["quote"])[0]:
                wanted.setdefault(found, []).append(r["quote_id"])
        sent = spark.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = automaton(sent.value) if sent.value else None
            for batch in batches if search else []:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if (text := text.as_py()) is None:
                        continue
                    plain, places = normalised(text)
                    for last, (length, ids) in search.iter(plain):
                        rows += [(q, doc, places[last - length + 1], places[last] + 1) for q in ids]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["quote_id", "doc_id", "start", "end"])

        return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)

    return reduce(DataFrame.union, [block(i) for i in range(blocks)])


DRAFT_FAULTS = ("unknown_source", "no_sources", "one_source", "quote_of_unknown_source", "quote_not_found", "source_without_quote")


def draft_faults(drafts: DataFrame, quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(task_id, fault, detail) of ``drafts(task_id, category, expected_status, sources array)`` whose ``quotes(task_id, n, source,
    quote)`` should stand in ``docs(doc_id, text)``, doc_id being the source. Faults are DRAFT_FAULTS."""
    known = docs.select(F.col("doc_id").alias("source"), F.lit(True).alias("_known"))
    named = drafts.select("task_id", "expected_status", F.explode("sources").alias("source"))
    row = lambda df, fault, detail: df.select("task_id", F.lit(fault).alias("fault"), detail.cast("string").alias("detail"))
    answered = F.col("expected_status") == "answered"
    cited = quotes.select("task_id", "source").distinct()
    id_ = F.struct("task_id", "n")
    places = quote_places(docs, quotes.select(id_.alias("quote_id"), "quote")).select("quote_id.task_id", "quote_id.n", F.col("doc_id").alias("source")).distinct()
    listed = quotes.join(known, "source", "left")
    return reduce(DataFrame.unionByName, [
        row(named.join(known, "source", "left_anti"), "unknown_source", F.col("source")),
        row(drafts.where(answered & (F.size("sources") == 0)), "no_sources", F.lit("")),
        row(drafts.where((F.col("category") == "multi_document") & (F.size(F.array_distinct("sources")) < 2)), "one_source", F.lit("")),
        row(listed.where("_known is null"), "quote_of_unknown_source", F.col("n")),
        row(listed.where("_known").join(places, ["task_id", "n", "source"], "left_anti"), "quote_not_found", F.col("n")),
        row(named.where(answered).join(cited, ["task_id", "source"], "left_anti"), "source_without_quote", F.col("source")),
    ])
