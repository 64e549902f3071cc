"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import re
import sys
from pathlib import Path

import pytest
from check_oracle import connect, run

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from tidefolio.llm import near_copies, queries  # noqa: E402
from tidefolio.llm.decontaminate import split_words, windows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    _, _, diff = run(spark, connect(SF), SF, name, queries.QUERIES[name], queries.SQL[name])
    assert diff == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_a_row_for_each_input(spark, name):
    source = "pages" if name == "op2_html_text" else "documents"
    got = queries.QUERIES[name](spark, SF)
    key = "page_id" if source == "pages" else "doc_id"
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())


def test_bpe_digests(spark):
    from tidefolio.llm import byte_bpe

    encoder = byte_bpe.Encoder(byte_bpe.public_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_byte_bpe"](spark, SF).collect():
        ids = encoder.encode(texts[r["doc_id"]]).tolist()
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    """Language aside, which the operator's own tests hold against labels."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")]
    best = {}
    for d in docs:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"])
        best[key] = max(best.get(key, d["doc_id"]), d["doc_id"])
    docs = [d for d in docs if d["doc_id"] in set(best.values())]
    sets = {d["doc_id"]: near_copies.shingles(d["text"].encode()) for d in docs}
    linked = [(i, j) for i in sets for j in sets if i < j and near_copies.similarity(sets[i], sets[j]) >= 0.8]
    least = {i: i for i in sets}
    for _ in sets:  # until nothing changes
        before = dict(least)
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    docs = [d for d in docs if least[d["doc_id"]] == d["doc_id"]]
    bench = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        bench |= windows(split_words(r["text"].encode()))
    docs = [d for d in docs if not bench & windows(split_words(d["text"].encode()))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs)
    assert all(r["whole"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_take_edge_rows_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "the text of one", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "the text of all", "en", "s", 1), (4, "!! 12", "en", "s", 1), (1, "the text of one", "en", "s", 3)]
    for data, n in ((rows, 3), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
            if name != "byte_bpe":
                assert docs.columns == schema.names
        assert docs.count() == n


def test_a_corpus_without_languages_is_kept(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["one text", "été", "12 !", "", None])]
    kept = corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1] and kept.columns == schema.names


def test_first_stages_keep_columns_of_any_name(spark):
    rows = [(1, "one text here", "en", 5, "a", "b", 7), (2, "one text here", "en", 6, "a", "b", 8), (3, "another text", None, 4, "a", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row int, lang_pred string, fp string, first int")
    for stage in (corpus_pipeline.keep_languages, corpus_pipeline.drop_near_copies):
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "_row", "lang_pred", "fp", "first"]
    assert sorted(map(tuple, docs.collect())) == [rows[0], rows[2]]
