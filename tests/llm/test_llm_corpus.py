"""Collocations, sharding and token alignment against brute force on small tables."""

import hashlib
import json
import re
import zlib
from collections import Counter
from itertools import accumulate, product

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidefolio.llm import collocations, queries, sharding, token_align

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, words string, a string, links string, code string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


# collocations


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def mined(rows, least, top, share=80, scale=2_000_000):
    total, freq = Counter(), {}
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k, i in product(range(1, 5), range(len(words))):
                if i + k <= len(words):
                    freq.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in freq.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        taken = Counter()
        for p, a in cands.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    taken[p[i : i + n]] = max(taken[p[i : i + n]], a)
        rated = []
        for p, a in cands.items():
            if 100 * taken[p] < share * a:
                score, _, left, right = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


PHRASES = [
    (1, "New York City is a city. New York City!", "en", "s"),
    (1, "New York City is a city. New York City!", "en", "s"),
    (None, "a\tb  a b,a b\x0ba b \x0c a b a b a b", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, "s"),
    (4, "Ähre ähre Ähre ähre a.b.a b " * 3, None, None),
    (5, "x y z x y z x y z w " * 40, "xx", "s"),
    (6, "... ,, !", "en", "s"),
    (7, "b a b a b a b a " * 5, "und", "s"),
]


@pytest.mark.parametrize("bounds", [{}, {"words": 3, "phrases": 2}, {"phrases": 1}, {"words": 0, "phrases": 0}])
def test_collocations_by_brute_force(spark, bounds):
    """Also with so few words and phrases held that most are counted as texts."""
    got = collocations.collocations(documents(spark, PHRASES), top=5, least=2, **bounds)
    assert sorted(map(tuple, got.collect())) == mined(PHRASES, 2, 5)


def test_collocations_of_documents_beyond_the_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = collocations.collocations(docs, least=10, words=300, phrases=100)
    assert sorted(map(tuple, got.collect())) == mined(rows, 10, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0


def test_words_of_long_texts_are_cut_nowhere():
    text = b"Ab c,D e\tf. " * 300_000
    found = [w for part in collocations.tokens(text) for w in part]
    assert found == b"ab c . d e f .".split() * 300_000


def test_dense_tiles_and_sorted_coordinates_agree():
    import numpy as np

    draw = np.random.default_rng(1)
    near = draw.zipf(1.3, 600_000) % 3000 << collocations.BITS | draw.zipf(1.3, 600_000) % 5000
    got = Counter()
    for codes, n in collocations.tile_counts(near):
        assert (np.diff(codes) > 0).all()
        got.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    assert got == Counter(near.tolist())
    assert list(collocations.tile_counts(near[:0])) == []


def test_scores_past_64_bits(spark):
    big = 9 * 10**18
    rows = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    (got,) = collocations.score(spark.createDataFrame(rows, "lang string, size int, phrase string, c long")).collect()
    assert got["score"] == 2_000_000 * (big - 1) // (2 * big)


# sharding

COPIES = [(i % 7 or None, "one text", None, "hot" if i % 3 else None) for i in range(90)]
MIXED = [(i, f"text {i}", None, "abc"[i % 3] if i % 5 else f"own {i}") for i in range(400)]


@pytest.mark.parametrize("rows", [[], COPIES[:5], COPIES, MIXED, COPIES + MIXED])
def test_shards_by_rows(spark, rows):
    got = sharding.placements(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    for r in got:
        assert r["text_crc32"] in {zlib.crc32((t or "").encode()) for _, t, _, _ in rows} and r["size"] > 8
    shards = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in shards)
    assert sum(map(len, shards)) == len(rows)
    if rows:
        assert max(map(len, shards)) - min(map(len, shards)) <= 1


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, f"text {i}", None, "big" if i % 10 else "small" if i % 20 else f"own {i}") for i in range(4800)]
    got = sharding.placements(documents(spark, rows), shards=8).collect()
    for s in range(8):
        mix = Counter((r["source"] or "")[:3] for r in got if r["shard"] == s)
        # sources of one row fall at random, the others keep their proportion to each other
        assert 10 <= mix["own"] <= 50 and abs(mix["big"] - 18 * mix["sma"]) <= 20


def test_seed_shuffles_and_layout_does_not(spark):
    def at(df, **how):
        return sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.placements(df, **how).collect())

    docs = documents(spark, MIXED)
    assert at(docs) == at(docs.repartition(7, "n_chars", "doc_id"))
    assert at(docs) != at(docs, seed="other")


def test_written_shards_hold_slots_in_order(spark):
    rows = MIXED + [(None, None, None, None), (3, "", None, "abc")]
    path = sharding.write_shards(documents(spark, rows), shards=4, files=9)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(documents(spark, []).columns)
    want = sharding.shard_documents(documents(spark, rows), shards=4)
    assert sorted((r["shard"], r["slot"], r["doc_id"] or 0, r["text"] or "") for r in back.collect()) == sorted(
        (r["shard"], r["slot"], r["doc_id"] or 0, r["text"] or "") for r in want.collect()
    )


def test_sharding_stays_on_the_jvm(spark):
    plan = queries.QUERIES["op12_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# token alignment


@pytest.fixture(scope="module")
def files():
    return token_align.public_pair()


@pytest.fixture(scope="module")
def libraries():
    """The libraries' own tokenizers and the bytes of their tokens."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_align.byte_letters()
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if "<|" not in t}
    return a, b, a_bytes


def aligned(text, libraries):
    """Groups by common byte offsets, from the libraries."""
    a, b, a_bytes = libraries
    want = b" " + (text or "").encode()
    if not text:
        return []
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    pieces = [b.id_to_piece(i) for i in y]
    y_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    x_bytes = [a_bytes[i] for i in x]
    if b"".join(x_bytes) != want or b"".join(y_bytes) != want:
        return []
    ends_x, ends_y = list(accumulate(map(len, x_bytes))), list(accumulate(map(len, y_bytes)))
    groups, p, q = [], 0, 0
    for e in ends_x:
        if e in ends_y:
            i, j = ends_x.index(e) + 1, ends_y.index(e) + 1
            groups.append((x[p:i], y[q:j]))
            p, q = i, j
    return groups


TEXTS = [
    "The quick brown fox, don't stop!",
    "The quick brown fox, don't stop!",
    "",
    None,
    "▁ is no space",
    "  two  spaces\n\n\tand lines \r\n",
    "日本語のテキスト 한국어 \U0001f600\U0001f468‍\U0001f469 é é",
    "<s> <|endoftext|> </s> <unk> <0x41>",
    "\x00\x01 zero",
    "antidisestablishmentarianism " * 50,
    "x" * 5000,
]


def test_alignment_by_brute_force(spark, files, libraries):
    docs = documents(spark, [(i if i != 5 else None, t, None, None) for i, t in enumerate(TEXTS)])
    wanted = [aligned(t, libraries) for t in TEXTS]
    counts = Counter((g[0][-1], g[1][-1]) for groups in wanted for g in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for i, groups in enumerate(wanted):
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sizes = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links))
        want.append((i if i != 5 else -1, *sizes, sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest))
    for block in (token_align.BLOCK, 7):
        got = token_align.score_links(docs, files, block=block).fillna(-1, ["doc_id"])
        rows = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, rows)) == sorted(want)


def test_aligned_groups_keep_columns(spark, files, libraries):
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)]).withColumnRenamed("words", "a_ids")
    got = token_align.align(docs, files)
    assert sorted(got.columns) == sorted({*docs.columns, *token_align.FOUND})
    for r in got.collect():
        groups, p, q = [], 0, 0
        for i, j in zip(r["a_cuts"], r["b_cuts"], strict=True):
            groups.append((r["a_ids"][p:i], r["b_ids"][q:j]))
            p, q = i, j
        assert groups == aligned(r["text"], libraries)
    assert token_align.align(docs.limit(0), files).count() == 0
    assert token_align.score_links(docs.limit(0), files).count() == 0


def test_very_long_texts(files):
    pair = token_align.Pair.load(files)
    for text in ("a b " * 200_000, " " * 300_000, "ab" * 200_000, "\n" * 200_000 + "é!" * 50_000):
        a, b = pair.encode(text)
        assert b"".join(pair.a_bytes[i] for i in a) == b" " + text.encode()
        assert pair.cuts(a, b)[0][-1] == len(a)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encoding_is_the_libraries(files, libraries, text):
    pair, a = token_align.Pair.load(files), libraries[0]
    assert pair.a.encode_ordinary(" " + text) == a.encode(" " + text, add_special_tokens=False).ids


def test_cuts_take_few_steps_per_token():
    """Ends are looked up as arrays; tokens that never end together give no cut before the last."""
    pair = token_align.Pair(token_align.public_pair())
    assert isinstance(pair.a_size, np.ndarray) and pair.cuts([], []) == ([], [])
    for text in ("a", "Straße 12, ünïcode 中文", "word " * 50):
        a, b = pair.encode(text)
        ends = [set(np.cumsum([len(size[i]) for i in ids]).tolist()) for ids, size in ((a, pair.a_bytes), (b, pair.b_bytes))]
        x, y = pair.cuts(a, b)
        assert len(x) == len(y) == len(ends[0] & ends[1]) and (x[-1], y[-1]) == (len(a), len(b))
