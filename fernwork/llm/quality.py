"""Quality rules whose cutoffs are risk controlled: built from DataFrame functions alone.

Each text gets counts (words, their characters, symbols, repeated lines, words in repeated 3-word windows).
A document fails the base rules if it has few words or mostly repeated ones. Beyond that each rule compares a
rate with a cutoff chosen from labelled documents. The cutoffs form one chain of filters, fixed beforehand: first the
loosest cutoff of every rule, then the second of every rule, and so on; a filter rejects what exceeds any cutoff up to
its step. Per stratum the filters are tested in that order, each on all labelled good documents of the stratum that
pass the base rules: a step is proved if the exact binomial tail P(Bin(n, risk) <= rejected) is at most miss / strata,
and the first step that isn't ends the chain. Testing a fixed sequence needs no correction for its length, and whole
filters are tested, so none for the number of rules; the division by the strata is Bonferroni's. So with probability
1 - miss no stratum loses more than the share `risk` of its good documents. A stratum with too few labels to prove
this (about 230 good ones without a rejection at the default risk and miss) gets no cutoff, and its documents are kept
unless they fail the base rules. All labelled documents are counted, whatever their number; a document's id is one
trial, which counts as rejected if any of the rows that share it is.

Windows are compared by 64-bit hashes inside one text.

Defined results: null text counts as no words (base_failed, not kept); blank and empty texts likewise; rows are
kept one to one, repeated rows included; null ids stay null; texts of many megabytes are measured whole; labels with a null id or quality are ignored, and
where labels of one id differ the lowest counts; a stratum that isn't listed, or null, is "other"; a value equal
to a cutoff is kept; empty tables give an empty result or no cutoffs; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import SPACES, let, small_join, words

#: Symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Cutoffs of each rule, from loose to strict.
RULES = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3),
    "repeated_line_share": (0.8, 0.6, 0.5, 0.4, 0.3),
    "repeated_word_share": (0.5, 0.45, 0.4, 0.35, 0.3),
    "word_length": (24.0, 20.0, 16.0, 14.0, 12.0),
    "marks_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.4),
}
STRATA = ("en", "fr", "de", "es")


def counts(t: Column, w: Column) -> Column:
    """Struct of the counts of text t with words w."""
    # 3-word windows with their places, sorted so that equal windows stand side by side
    windows = F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))), F.lit(0))

    def without(chars: str) -> Column:
        return F.length(F.translate(t, chars, ""))

    lines = let(F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""), lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("different")))
    return let(lines, lambda n: F.struct(
        F.size(w).cast("long").alias("n_words"), without(SPACES).cast("long").alias("word_chars"), (F.length(t) - without(SYMBOLS)).cast("long").alias("n_symbols"), (F.length(t) - without("!")).cast("long").alias("n_marks"),
        n["all"].cast("long").alias("n_lines"), (n["all"] - n["different"]).cast("long").alias("n_dup_lines"), let(windows, covered).cast("long").alias("n_repeat_words"),
    ))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata_col: str | None = "lang") -> DataFrame:
    """Per row: id, stratum and m, the struct of the counts."""
    stratum = docs[strata_col].cast("string") if strata_col and strata_col in docs.columns else F.lit("all")
    return docs.select(docs[id_col].alias(id_col), stratum.alias("stratum"), measure(docs[text_col]).alias("m"))


def measure(text: Column) -> Column:
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(words(t), lambda w: counts(t, w)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rates(m: Column) -> dict[str, Column]:
    """The rules' values; null where a text has no words."""
    per = lambda a, b: F.when(m[b] > 0, m[a] / m[b])
    return {"symbols_per_word": per("n_symbols", "n_words"), "repeated_line_share": per("n_dup_lines", "n_lines"), "repeated_word_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"), "marks_per_word": per("n_marks", "n_words")}


def chain() -> list[tuple[str, float]]:
    """The steps (rule, cutoff) in the order of testing."""
    return [(r, cs[k]) for k in range(max(map(len, RULES.values()))) for r, cs in RULES.items() if k < len(cs)]


def first_step(values: Column) -> Column:
    """The first step of the chain that rejects the rules' values (a struct); the number of steps if none does."""
    steps = chain()
    return F.least(*[F.when(values[r] > c, F.lit(k)).otherwise(F.lit(len(steps))) for k, (r, c) in enumerate(steps)])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
    return min(1.0, math.fsum(map(math.exp, logs)))


def proved(by_step: dict[int, int], risk: float, most: float) -> dict[str, float]:
    """The cutoffs proved by how many trials each step is the first to reject."""
    n, rejected, out = sum(by_step.values()), 0, {}
    for k, (r, c) in enumerate(chain()):
        rejected += by_step.get(k, 0)
        # above the mean the tail is a half at least
        if not n or rejected > n * risk or binomial_tail(rejected, n, risk) > most:
            break
        out[r] = c
    return out


def known(stratum: Column, strata: tuple[str, ...]) -> Column:
    return F.when(stratum.isin(*strata), stratum).otherwise("other") if strata else F.lit("all")


def cutoffs(docs: DataFrame, labels: DataFrame, risk: float = 0.02, miss: float = 0.05, strata: tuple[str, ...] = STRATA, id_col: str = "doc_id", text_col: str = "text", strata_col: str | None = "lang") -> dict[str, dict[str, float]]:
    """Per stratum the cutoff of each rule that could be proved. Collects a count per listed stratum and step."""
    good = labels.where(labels[id_col].isNotNull() & labels["quality"].isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    held = small_join(docs, good.where("quality = 1").select(id_col), [id_col], "left_semi")
    stratum = held[strata_col].cast("string") if strata_col and strata_col in held.columns else F.lit("all")
    # null where the base rules fail; a filter here would measure every text again
    step = let(measure(held[text_col]), lambda m: F.when(~base_failed(m), let(F.struct(*[v.alias(r) for r, v in rates(m).items()]), first_step)))
    trials = held.select(F.col(id_col).alias("id"), known(stratum, strata).alias("stratum"), step.alias("step")).groupBy("id", "stratum").agg(F.min("step").alias("step")).where("step IS NOT NULL")
    by: dict[str, dict[int, int]] = {}
    for row in trials.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        by.setdefault(row["stratum"], {})[row["step"]] = row["n"]
    return {s: proved(steps, risk, miss / (len(strata) + 1)) for s, steps in by.items()}


def verdict(m: Column, stratum: Column, chosen: dict[str, dict[str, float]]) -> Column:
    """Whether a text with counts m is kept."""
    over = F.lit(False)
    for s, rules in chosen.items():
        for r, c in rules.items():
            over = over | ((stratum == s) & F.coalesce(rates(m)[r] > c, F.lit(False)))
    return ~base_failed(m) & ~over


def score(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = STRATA, id_col: str = "doc_id", text_col: str = "text", strata_col: str | None = "lang", **options) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    chosen = cutoffs(docs, labels, strata=strata, id_col=id_col, text_col=text_col, strata_col=strata_col, **options)
    m, df = F.col("m"), measured(docs, id_col, text_col, strata_col)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(id_col, *(m[c].alias(c) for c in shown), base_failed(m).alias("base_failed"), verdict(m, known(F.col("stratum"), strata), chosen).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = STRATA, id_col: str = "doc_id", text_col: str = "text", strata_col: str | None = "lang", **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    chosen = cutoffs(docs, labels, strata=strata, id_col=id_col, text_col=text_col, strata_col=strata_col, **options)
    stratum = docs[strata_col].cast("string") if strata_col and strata_col in docs.columns else F.lit("all")
    return docs.where(let(measure(docs[text_col]), lambda m: verdict(m, known(stratum, strata), chosen)))


def sql(risk: float = 0.02, miss: float = 0.05) -> str:
    """DuckDB SQL of score over documents and labels."""
    cuts = ", ".join(f"('{r}', {k}, {c})" for k, (r, c) in enumerate(chain()))
    most = miss / (len(STRATA) + 1)
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN {STRATA} THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
a AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
v AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM a) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_marks, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM d LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
x AS (SELECT doc_id, stratum, base_failed, unnest(['symbols_per_word', 'repeated_line_share', 'repeated_word_share', 'word_length', 'marks_per_word']) AS r, unnest([n_symbols / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0), word_chars / nullif(n_words, 0), n_marks / nullif(n_words, 0)]) AS x FROM b),
c(r, k, c) AS (VALUES {cuts}),
y AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
t AS (SELECT b.doc_id, stratum, min(coalesce(k, {len(chain())})) AS step FROM b SEMI JOIN y USING (doc_id) LEFT JOIN (SELECT x.doc_id, min(k) AS k FROM x JOIN c USING (r) WHERE x > CAST(c AS DOUBLE) GROUP BY x.doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
n AS (SELECT stratum, count(*) AS n FROM t GROUP BY stratum),
q AS (SELECT stratum, k, r, c, n, (SELECT count(*) FROM t WHERE t.stratum = n.stratum AND step <= k) AS rejected FROM n, c),
z AS (SELECT *, list_sum(list_transform(range(0, rejected + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) <= {most} AS good FROM q),
o AS (SELECT stratum, r, min(c) AS c FROM (SELECT *, bool_and(good) OVER (PARTITION BY stratum ORDER BY k) AS proved FROM z) WHERE proved GROUP BY ALL),
f AS (SELECT DISTINCT doc_id FROM x JOIN o USING (stratum, r) WHERE x > CAST(c AS DOUBLE))
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept FROM b LEFT JOIN f USING (doc_id)
"""
