"""Classifiers, decontamination and tokenizer on small fixtures."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidefolio.llm import byte_bpe, decontaminate, language_id, quality
from tidefolio.llm.words import word_hashes

SF = "/root/testdata/sf0.01"
ODD = [
    "",
    " ",
    "don't we'll I'M 123,456  \t\n\n x",
    "日本語のテキスト " * 20,
    "\x1c\x1d a\x85 b\u3000c",
    "<|endoftext|>",
    "a" * 5000,
    "é" * 3000 + "🙂" * 50,
    "".join(chr(i) for i in range(0x20, 0x3000)),
]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.public_vocabulary()


def test_perfect_hash_is_minimal(vocabulary):
    assert sorted(vocabulary.ids.tolist()) == list(range(len(vocabulary.tokens)))
    encoder = byte_bpe.Encoder(vocabulary)
    assert all(encoder.whole(t) == i for i, t in enumerate(vocabulary.tokens))
    assert encoder.whole(b"no token at all") == -1


def test_bpe_equals_the_library(spark, vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(-1 - i, t) for i, t in enumerate(ODD)] + [(-100, None), (None, "x y"), (-101, "x"), (-101, "x")]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("IDS", F.lit("clash"))
    coded = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(coded) == 1000 + len(rows)
    for r in coded:
        text = r["text"] or ""
        assert list(r["ids"]) == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_one_worker_encodes_and_decodes(spark, vocabulary):
    """Two Python steps in a row would run two workers per task, each with a vocabulary and batches of its own."""
    import corpus_pipeline

    rows = [(i, "en", "s", t) for i, t in enumerate([*ODD, None, "", "x y"])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("Decoded", F.lit("clash"))
    want = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary)
    got = byte_bpe.encode_decode(docs, vocabulary)
    assert got.columns == want.columns and sorted(got.collect(), key=lambda r: r[0]) == sorted(want.collect(), key=lambda r: r[0])
    for one in (corpus_pipeline.tokenise(spark, docs, SF), byte_bpe.round_trip(docs, vocabulary)):
        assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_memo_is_bounded_and_changes_nothing(vocabulary):
    small, large = byte_bpe.Encoder(vocabulary, memo=3), byte_bpe.Encoder(vocabulary)
    for text in ("one two three four five six", "six five other words", "one two"):
        assert small.encode(text).tolist() == large.encode(text).tolist()
    assert len(small.known) <= 10


def test_vocabulary_without_a_byte_is_refused(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.read_vocabulary(str(tmp_path / "r"), public_tokenizers.PATTERN)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs, ~held)
    assert model.languages == ["de", "en", "es", "fr"]
    found = language_id.predict(docs.where(held).withColumn("Score", F.lit(1)), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(1, "der die das", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "123 !?", "en"), (5, "", None), (6, "the " * 200_000, None), (6, "the", None)],
        "doc_id long, text string, lang string",
    )
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.identify(docs, F.lit(True)).collect()}
    assert set(got) == {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en")}
    assert all(0 <= s <= 1 for s in got.values())
    empty = language_id.identify(docs.where("doc_id < 0"), F.lit(True))
    assert empty.collect() == []
    untrained = language_id.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in untrained} == {"und"}


def test_too_many_languages_are_refused(spark):
    docs = spark.range(5).select(F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="values of lang"):
        language_id.train(docs, F.lit(True), max_languages=4)


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "Ab cd! é" * 500
    whole = Counter(np.concatenate(list(language_id.ngram_buckets(text))).tolist())
    monkeypatch.setattr(language_id, "CHARS", 97)
    assert Counter(np.concatenate(list(language_id.ngram_buckets(text))).tolist()) == whole


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = quality.classify(docs, labels, "quality", ~held).where(held).join(labels, "doc_id")
    right = found.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text", 5), (2, "bad!! bad!!", 6), (3, None, 7), (4, "", 8), (5, "x" * 300_000, 9), (None, "y", 9)], "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, "quality", F.lit(True)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and all(0 <= s <= 1 for s in got.values())
    assert got[1] > got[2] and got[3] == got[4]
    assert quality.classify(docs.where("doc_id < 0"), labels, "quality", F.lit(True)).collect() == []
    assert len(quality.classify(docs, labels.where("doc_id < 0"), "quality", F.lit(True)).collect()) == 6


def test_word_hashes_do_not_depend_on_place_or_slices(monkeypatch):
    from tidefolio.llm import words

    data = b"  alpha beta\tgamma alpha " + b"z" * 300 + b" beta"
    h = word_hashes(data)
    assert len(h) == 6 and h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4
    assert word_hashes(b" \n").tolist() == [] and word_hashes(b"").tolist() == []
    whole = words.slices
    monkeypatch.setattr(words, "slices", lambda d: whole(d, 8))
    assert word_hashes(data).tolist() == h.tolist()


def test_slices_cut_no_word():
    from tidefolio.llm.words import slices

    data = b"aa bbb " * 50 + b"c" * 500 + b" dd"
    parts = list(slices(data, 64))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


BENCH = "item_id long, text string"
ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven"),
    (2, "short item"),
    (3, None),
    (4, "--- ..."),
    (5, "Éa b c d e f g h i j"),
    (10, "one two three four five six seven eight nine TEN"),
    (None, "nameless item here"),
]


def slow_hits(text, items, size=10):
    fold = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_hits_against_brute_force_in_any_number_of_blocks(spark):
    texts = [
        None,
        "",
        "x ONE, two three-four five six seven eight nine ten! eleven y",
        "two three four five six seven eight nine ten eleven",
        "a short item, a SHORT item short",
        "éa b c d e f g h i j and Éa b c d e f g h i j",
        "one two three four five six seven eight nine",
        "filler " * 50_000 + "short item",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")], "doc_id long, text string, Items string")
    items = [i for i in ITEMS if i[0] is not None]
    bench = spark.createDataFrame(items, BENCH)
    want = Counter((i, n, h, ",".join(f)) for i, t in [*enumerate(texts), (2, texts[2])] for n, h, f in [slow_hits(t, items)])
    for block in (200_000, 2):
        got = decontaminate.scan(docs, bench, block=block)
        assert got.columns == ["doc_id", "text", *decontaminate.FOUND]
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got.collect()) == want
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {0, 1, 6}


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Say: a short, ITEM! End."), (2, None), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, BENCH)
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: "Say: a ! End.", 2: None, 3: "clean"}
    empty = decontaminate.scan(docs, bench.where("item_id < 0")).collect()
    assert [r["n_hit"] for r in empty] == [0, 0, 0]
    assert decontaminate.scan(docs.where("doc_id < 0"), bench).collect() == []
