"""The registered queries over a whole small table: against DuckDB where there is SQL, else against the libraries."""

from collections import Counter

import duckdb
import public_tokenizers
import pytest

from fernwork.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").df()
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(map(tuple, want.astype(object).values.tolist()))


def test_token_counts(spark, duck):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = duck.sql("SELECT doc_id, text FROM documents").df()
    want = {i: len(sp.encode(t)) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, SF).collect()} == want


def test_packing(spark, duck):
    got = queries.op1_best_fit_packing(spark, SF).collect()
    by, total = {}, 0
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 4096
    assert len(by) <= -(-total // 4096) + 1
    assert {r["doc_id"] for r in got} == set(duck.sql("SELECT doc_id FROM documents").df()["doc_id"])


def test_extraction(spark, duck):
    """The pages' template has all of its text in one article."""
    import html
    import re

    pages = duck.sql("SELECT page_id, html FROM pages").df()
    want = {}
    for k, page in zip(pages["page_id"], pages["html"], strict=True):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[k] = "\n\n".join(x for x in blocks if x)
    assert {r["page_id"]: r["text"] for r in queries.op7_html_extraction(spark, SF).collect()} == want


def test_model_beats_frequencies(spark):
    held = [r for r in queries.op8_lm_scoring(spark, SF).collect() if r["held_out"]]
    gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)
    assert gain > 0.05  # log10 a token


def test_licences(spark, duck):
    got = queries.op9_license_scan(spark, SF)
    mit = duck.sql("SELECT doc_id FROM documents WHERE contains(text, 'Released under the MIT License.')").df()["doc_id"]
    assert got.count() == duck.sql("SELECT doc_id FROM documents").df().shape[0]
    assert {r["doc_id"] for r in got.where("licence = 'MIT' AND found = 'own'").collect()} == set(mit)
