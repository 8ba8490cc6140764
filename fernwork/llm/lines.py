"""Site-relative line deduplication, built from DataFrame functions alone.

Per host, a line's share is the number of the host's pages that hold it over the host's page total. Lines whose
share exceeds `ratio` are boilerplate and go from every page of the host; hosts of fewer than `pages` pages have
none. Lines are compared without white space at their ends, by 128 bits of hash; blank lines stay.

Counts are aggregated before they are shuffled, so a line on a third of all pages costs a row per task. A host
has at most (lines a page) / ratio boilerplate lines; pages meet their host's list in a join that is broadcast
when the lists are few, else shuffled, where adaptive execution splits a hot host.

Defined results: a null text stays null, with 0 lines; an empty text stays empty; null hosts are one host; rows
are kept one to one, repeated rows included, and each counts as a page; null ids stay null; a share equal to
the ratio is kept; texts of many megabytes are handled whole; an empty table gives an empty table; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import SPACES, let, small_join, stored

RATIO, PAGES = 0.1, 10


def keys(text: Column) -> Column:
    """For each line of a text the hash of the line, null for blank ones."""
    clean = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)))
    return F.transform(clean, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """pages (host, text): a row per host that has boilerplate, with the array of its lines' hashes."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.filter(keys(F.col("text")), lambda x: x.isNotNull()))).alias("line")).select("host", "line.a", "line.b")
    counts = lines.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") > F.lit(least * ratio))  # none below exceeds the ratio on a host that counts
    totals = totals.where(F.col("pages") >= least).withColumnRenamed("host", "of")
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return over.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("bad"))


def cleaned(docs: DataFrame, ratio: float = RATIO, least: int = PAGES, text_col: str = "text", host: Column | str = "source") -> DataFrame:
    """(row, text, n_lines, n_dropped): row is the struct of the input's columns, text what is left."""
    host = docs[host] if isinstance(host, str) else host
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), host.cast("string").alias("host"), docs[text_col].cast("string").alias("text"))
    bad = stored(boilerplate(rows.select("host", "text"), ratio, least)).select(F.coalesce("host", F.lit("")).alias("k"), F.col("host").isNull().alias("none"), "bad")
    held = bad.agg(F.sum(F.size("bad"))).first()[0] or 0  # the lists' lines count, not the hosts
    met = small_join(rows.withColumn("k", F.coalesce("host", F.lit(""))).withColumn("none", F.col("host").isNull()), bad, ["k", "none"], "left", held)

    def kept(lines: Column) -> Column:
        return F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("bad"), F.struct(F.xxhash64(F.trim(x, F.lit(SPACES))).alias("a"), F.xxhash64(F.lit(1), F.trim(x, F.lit(SPACES))).alias("b"))), F.lit(False)))

    whole = F.when(F.col("bad").isNull(), F.struct(F.col("text"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))).otherwise(
        let(F.split("text", "\n"), lambda a: let(kept(a), lambda b: F.struct(F.when(a.isNotNull(), F.array_join(b, "\n")).alias("text"), F.coalesce(F.greatest(F.size(a), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(a) - F.size(b), F.lit(0)).cast("long").alias("n_dropped"))))
    )
    return met.select("row", whole.alias("out")).select("row", "out.*")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, text without boilerplate lines, n_lines, n_dropped."""
    return cleaned(docs, **options).select(F.col("row")[id_col].alias(id_col), "text", "n_lines", "n_dropped")


def with_clean_text(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the cleaned text in place, and n_chars, if there is such a column, counted anew."""
    df = cleaned(docs, text_col=text_col, **options)
    new = {text_col: F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return df.select(*[(new[c] if new.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns])


#: DuckDB SQL of drop_boilerplate over documents, by source.
SQL = f"""
WITH l AS (SELECT doc_id, source, text, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line FROM documents),
bad AS (SELECT source, line FROM l GROUP BY source, line HAVING count(*) > {RATIO} * (SELECT count(*) FROM documents d WHERE d.source = l.source) AND (SELECT count(*) FROM documents d WHERE d.source = l.source) >= {PAGES}),
b AS (SELECT source, list(line) AS lines FROM bad GROUP BY source),
k AS (SELECT doc_id, string_split(text, chr(10)) AS a, coalesce(b.lines, []) AS lines FROM documents LEFT JOIN b USING (source)),
r AS (SELECT doc_id, a, list_filter(a, lambda x: NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept FROM k)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(len(a) AS BIGINT) AS n_lines, CAST(len(a) - len(kept) AS BIGINT) AS n_dropped FROM r
"""
