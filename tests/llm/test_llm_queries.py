"""The registered queries on the smallest tables: DuckDB, the libraries, contracts."""

import hashlib
import os
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
from paravane.llm import bpe_tree, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def run(spark):
    found = entry.queries()
    return lambda name: found[name](spark, SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names and "flagship_summary" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(run, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, c = run(name), con.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in c.description]
    assert sorted(map(tuple, df.collect())) == sorted(c.fetchall())


def test_held_out_folds_and_scores(run, texts):
    for name, modulus, fold in (("op1_language_id", 3, 1), ("op2_quality", 4, 2), ("op9_toxicity", 4, 2)):
        rows = run(name).collect()
        assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold) for r in rows)
    assert dict(run("op9_toxicity").dtypes)["predicted"] == "int" and dict(run("op1_language_id").dtypes)["held_out"] == "boolean"


def test_token_queries(run, texts):
    ranks = bpe_tree.read_ranks(open(P.path(queries.RANKS), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run("op7_bpe_roundtrip").collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    tokenizer = Tokenizer.from_file(P.path(queries.TOKENIZER))
    for r in run("op8_token_counts").collect():
        t = texts[r["doc_id"]] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


def test_neighbours(spark, run):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in run("op3_nearest_neighbours").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        s = x @ x[ids == q][0]
        order = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        hits += len(set(order) & set(got))
    assert hits >= 0.9 * 20 * len(found)


def test_pages(run, spark):
    rows = run("op4_html_text").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum("&amp;" in r["text"] or "<p>" in r["text"] for r in rows) == 0


def test_passages_share_words(run, texts):
    for r in run("op5_passages").collect():
        words = lambda d: queries.passages.WORD.findall(texts[d])
        a = words(r["doc_id"])[r["start_word"] : r["start_word"] + r["n_words"]]
        b = words(r["source_id"])[r["source_start"] : r["source_start"] + r["source_words"]]
        low = lambda ws: {w.lower() for w in ws}
        assert r["source_id"] < r["doc_id"] and len(a) == r["n_words"] >= 50 and len(low(a) & low(b)) >= 0.6 * len(low(a))
