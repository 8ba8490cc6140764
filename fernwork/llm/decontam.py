"""Benchmark decontamination by a positional inverted index, built from DataFrame functions alone.

1. Texts are cut into lower-case words once, and the words stored.
2. The corpus counts of the test items' terms give every window of an item its RAREST rarest places.
3. The index is stored: postings (term, row, position) of the terms at such places.
4. Postings minus their place in the item are the offset-adjusted lists; a window's lists intersect where all
   of its rarest places meet at one start.
5. Starts that survive are compared with the text word by word: exact phrase matches.
6. Proximity matches: lists intersect within `slop` words of one start, by overlapping buckets of starts; every start
   of a bucket where all rarest places meet is then tried on the text, with all words of the window.

The test side is broadcast only when its counted rows are few, else joined through a shuffle whose hot terms
adaptive execution splits. Postings are grouped by row, item and start, so a passage that a third of all
documents hold is spread like any other; a group has at most as many postings as its item has words.

Defined results: a null, empty or wordless text has no words and no hits; an item without words has no window, one
with fewer words than a window is one window; items with equal text each count; rows are kept one to one,
repeated rows included; null ids of documents stay null; the passages of an item with a null id count as hits and make a
row contaminated, but the item isn't counted or listed among the items; texts of many megabytes are indexed whole; empty
tables give an empty table or no hits; other columns are ignored, also those named like results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernwork.llm.common import ascii_lower, small, small_join, stored

#: Characters between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for an item without an id; the others are marked with a sign before theirs.
NAMELESS = "-"
#: Rarest places of a window whose postings must meet before it is compared word by word.
RAREST = 3


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(c.cast("string"), F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, n: int) -> DataFrame:
    """items (item, words): (item, first, words of the window)."""
    size = F.size("words")
    return items.where(size > 0).select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))).alias("first")).select("item", "first", F.expr(f"slice(words, first + 1, {n})").alias("window"))


class Index:
    """The stored words of documents and the postings that a set of items needs."""

    def __init__(self, docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text: str):
        text = docs[text_col].cast("string")
        self.rows = stored(docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), tokens(text).alias("words")).withColumn("n_words", F.size("words").cast("long")))
        parts = stored(windows(items.select(F.coalesce(F.concat(F.lit("="), items[item_col].cast("string")), F.lit(NAMELESS)).alias("item"), tokens(items[item_text]).alias("words")), n).distinct())
        self.windows, self.n_windows = parts, parts.count()
        places = parts.select("item", "first", F.posexplode("window").alias("at", "term"))
        terms = stored(places.select("term").distinct())
        words = self.rows.select(F.explode("words").alias("term"))
        counts = stored(small_join(words, terms, ["term"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
        # a window with a term that the corpus lacks can't occur
        ranked = places.join(counts, "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("item", "first").orderBy(F.coalesce("n", F.lit(0)), "at")))
        possible = ranked.groupBy("item", "first").agg(F.count(F.lit(1)).alias("places"), F.count("n").alias("have")).where("places = have").select("item", "first")
        rare = ranked.where(F.col("r") <= RAREST).join(possible, ["item", "first"]).select("item", "first", (F.col("first") + F.col("at")).alias("place"), "term")
        self.needed = stored(rare.groupBy("item", "first").agg(F.collect_set("place").alias("places")))
        self.places = stored(rare.select("item", "place", "term").distinct())
        wanted = stored(self.places.select("term").distinct())
        spread = self.rows.select("id", "th", F.posexplode("words").alias("pos", "term"))
        self.postings = stored(small_join(spread, wanted, ["term"], "left_semi"))

    def lists(self) -> DataFrame:
        """(id, th, item, place, start): offset-adjusted postings; start is where the item would begin in the text."""
        return small_join(self.postings, self.places, ["term"]).select("id", "th", "item", "place", (F.col("pos") - F.col("place")).alias("start"))

    def met(self) -> DataFrame:
        """(id, th, item, start, first): windows all of whose rarest places meet."""
        # a bit for each place modulo 64: all of a window's bits are there if its lists meet (and rarely else; exact() tells)
        found = self.lists().groupBy("id", "th", "item", "start").agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("have"))
        needed = self.needed.select("item", "first", F.expr("aggregate(places, 0L, (x, place) -> x | shiftleft(1L, place % 64))").alias("bits"))
        return small_join(found, needed, ["item"]).where(F.col("have").bitwiseAND(F.col("bits")) == F.col("bits")).select("id", "th", "item", "start", "first")

    def near(self, slop: int) -> DataFrame:
        """(id, th, item, first): windows that have an occurrence of their first word from which every word of theirs
        stands within `slop` words of its place."""
        width = 2 * slop + 1
        # a start goes to the buckets of all starts within slop of it, so all near one start share that one's bucket
        spread = self.lists().withColumn("bucket", F.explode(F.array_distinct(F.array(*[F.floor((F.col("start") + d) / width) for d in (-slop, 0, slop)]))))
        some = spread.groupBy("id", "th", "item", "bucket").agg(F.collect_set("place").alias("have"))
        met = small_join(some, self.needed, ["item"]).where(F.size(F.array_except("places", "have")) == 0)

        def fits(words: Column, x: Column) -> Column:
            def at(begin: Column) -> Column:
                word = lambda k: F.array_contains(F.slice(words, F.greatest(begin + k - slop, F.lit(0)) + 1, F.greatest(begin + k + slop - F.greatest(begin + k - slop, F.lit(0)) + 1, F.lit(0))), F.get(x["window"], k))
                return (begin >= 0) & F.coalesce(F.get(words, begin) == F.get(x["window"], F.lit(0)), F.lit(False)) & F.forall(F.sequence(F.lit(0), F.size(x["window"]) - 1), word)

            first = (x["bucket"] * width + x["first"]).cast("int")
            return F.exists(F.sequence(first, first + width - 1), at)

        return self.confirmed(met.select("id", "th", "item", "first", "bucket"), fits)

    def exact(self) -> DataFrame:
        """(id, th, item, first, at, window): the windows' exact matches."""
        return self.confirmed(self.met().withColumn("at", F.col("start") + F.col("first")).where("at >= 0").drop("start"), lambda words, x: F.slice(words, x["at"] + 1, F.size(x["window"])) == x["window"])

    def confirmed(self, met: DataFrame, fits: Callable[[Column, Column], Column]) -> DataFrame:
        """Candidates (id, th, item, first, ..) that fit the row's words, as an array hits per row (id, th) that has any.

        Only the rows with candidates are shuffled to meet them; their keys are few, or else shuffled as well."""
        met = small_join(stored(met), self.windows, ["item", "first"])
        parts = [c for c in met.columns if c not in ("id", "th")]
        some = stored(met.groupBy(F.col("id").alias("k"), F.col("th").alias("h")).agg(F.collect_set(F.struct(*parts)).alias("c")))
        keys = some.select("k", "h")
        same = lambda a, b: a["id"].eqNullSafe(b["k"]) & a["th"].eqNullSafe(b["h"])
        rows = self.rows.select("id", "th", "words")
        rows = rows.join(F.broadcast(keys) if small(keys) else keys, same(rows, keys), "left_semi")
        both = rows.join(some, same(rows, some)).dropDuplicates(["id", "th"])
        return both.select("id", "th", F.filter("c", lambda x: fits(F.col("words"), x)).alias("hits")).where(F.size("hits") > 0)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0)."""
    index = Index(docs, items, n, id_col, text_col, item_col, item_text)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + F.size(x["window"]) - 1)))))
    names = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda x: x["item"] != NAMELESS), lambda x: F.substring(x["item"], 2, 2**31 - 1))))
    hits = index.exact().select(F.col("id").alias("k"), F.col("th").alias("h"), covered.alias("covered"), names.alias("names"))
    rows = index.rows.select("id", "th", "n_words")
    hits = stored(hits)
    out = rows.join(hits, rows["id"].eqNullSafe(hits["k"]) & rows["th"].eqNullSafe(hits["h"]), "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("covered", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("names", none), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row and item: n_windows, the item's windows whose words all stand within `slop` words of where the phrase has
    them, counted from an occurrence of its first word; exact phrases are among them. Rows without any aren't listed;
    rows that share id and text are one; a null item stays null."""
    near = Index(docs, items, n, id_col, text_col, item_col, item_text).near(slop)
    near = near.select("id", "th", F.explode("hits").alias("x")).select("id", "th", "x.item", "x.first").distinct()
    found = near.groupBy("id", "th", "item").agg(F.count(F.lit(1)).alias("n_windows"))
    item = F.when(F.col("item") != NAMELESS, F.substring("item", 2, 2**31 - 1))
    return found.select(F.col("id").alias(id_col), item.alias("item_id"), "n_windows")


def clean(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no window of an item, with all their columns."""
    hits = stored(Index(docs, items, n, id_col, text_col, options.get("item_col", "item_id"), options.get("item_text", "text")).exact().select(F.col("id").alias("__k"), F.col("th").alias("__h")))
    few = small(hits)
    same = docs[id_col].eqNullSafe(hits["__k"]) & F.xxhash64(docs[text_col].cast("string")).eqNullSafe(hits["__h"])
    return docs.join(F.broadcast(hits) if few else hits, same, "left_anti")


#: DuckDB SQL of contamination over documents and benchmark.
SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, bw.item, dw.i, dw.n FROM dw JOIN bw USING (win, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: DuckDB SQL of proximity over documents and benchmark (10 words, 3 words of slop).
NEAR_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item, i AS first, w[i:i + 9] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
bt AS (SELECT item, first, len(win) AS n, unnest(win) AS w, unnest(range(0, len(win))) AS k FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
dt AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS p FROM d),
u AS (SELECT item, first, count(DISTINCT w) AS u FROM bt GROUP BY ALL),
s AS (SELECT doc_id, item, first, n FROM (SELECT DISTINCT doc_id, w FROM dt) JOIN bt USING (w) JOIN u USING (item, first) GROUP BY doc_id, item, first, n, u HAVING count(DISTINCT w) = u),
c AS (SELECT s.*, dt.p AS c FROM s JOIN bt USING (item, first) JOIN dt USING (doc_id, w) WHERE bt.k = 0),
m AS (SELECT DISTINCT doc_id, item, first FROM (SELECT c.doc_id, c.item, c.first, c.c FROM c JOIN bt USING (item, first) JOIN dt ON dt.doc_id = c.doc_id AND dt.w = bt.w AND dt.p BETWEEN c.c + bt.k - 3 AND c.c + bt.k + 3 GROUP BY c.doc_id, c.item, c.first, c.c HAVING count(DISTINCT bt.k) = any_value(c.n)))
SELECT doc_id, item AS item_id, count(*) AS n_windows FROM m GROUP BY ALL
"""
