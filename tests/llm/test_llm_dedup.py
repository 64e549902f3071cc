"""Exact, near and substring deduplication against brute force, with edge rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidefolio.llm import exact_dedup, simhash, substring_dedup
from tidefolio.llm.components import components
from tidefolio.llm.text import LOWER, UPPER

DOCS = "doc_id long, text string, lang string, keep_id string, fp string, places int"
FOLD = str.maketrans(UPPER, LOWER)


def edge_rows():
    base = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None, "en", "x", "x", 0),
        (2, "", None, None, None, None),
        (3, "Abc É", "en", "x", "x", 1),
        (4, "aBC É", "en", "x", "x", 1),
        (5, "abc é", "en", "x", "x", 1),
        (6, base, "en", None, "x", 1),
        (6, base, "en", None, "x", 1),  # a repeated row
        (7, "lead " + base + " tail", "en", None, "x", 1),
        (8, " ".join(["der"] * 90), "de", None, "x", 1),
        (None, base.upper(), "en", None, "x", 1),
        (None, "alone", "en", None, "x", 1),
        (9, "x" * 200_000, "en", None, "x", 1),
        (10, " ".join(f"long{i % 7001}" for i in range(30_000)), "en", None, "x", 1),
        (11, " \t\n ", "en", None, "x", 1),
    ]


def test_exact_verdicts(spark):
    rows = edge_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(FOLD)].append(r[0])
    want = Counter()
    for r in rows:
        text = (r[1] or "").translate(FOLD)
        ids = [i for i in groups[text] if i is not None]
        keep = max(ids) if ids else None
        want[(r[0], keep, len(groups[text]), r[0] == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_exact_dedup_keeps_all_columns_and_one_row_of_each_content(spark):
    docs = spark.createDataFrame([(1, "A b", "x"), (2, "a B", "y"), (3, "c", None), (3, "a b", "z")], "doc_id long, text string, digest string")
    got = {tuple(r) for r in exact_dedup.drop_duplicates(docs).collect()}
    assert got == {(3, "c", None), (3, "a b", "z")}


def test_exact_dedup_runs_no_python_and_groups_by_content(spark):
    docs = spark.createDataFrame(edge_rows(), DOCS)
    plan = exact_dedup.content_groups(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Aggregate [digest") == 3


@pytest.mark.parametrize("make", [exact_dedup.exact_duplicates, simhash.near_duplicates, substring_dedup.remove_repeats])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], DOCS)).collect() == []


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rows = [r for r in edge_rows() if r[0] != 9]
    words = [f"t{i}" for i in range(400)]
    for k in range(40):  # near copies of one text
        changed = list(words)
        changed[5 * k] = "other"
        rows.append((100 + k, " ".join(changed), "en", None, None, None))
    ids, fps = [r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                of[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = Counter((d, f"{fps[i]:016x}", least.get(root(i))) for i, d in enumerate(ids))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.fingerprint(("x " * 70_000 + "y").encode()) == simhash.fingerprint(("x\n" * 70_000 + "Y").encode())


NEAR = " ".join(f"t{i}" for i in range(400))
NEAR_DOCS = "doc_id long, text string, lang string"


def near_kept(spark, rows):
    assert (simhash.fingerprint(NEAR.encode()) ^ simhash.fingerprint((NEAR + " end").encode())).bit_count() <= 4
    docs = spark.createDataFrame(rows, NEAR_DOCS).repartition(3)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    return Counter(map(tuple, got.collect()))


def test_near_dedup_knows_rows_without_doc_id_apart(spark):
    alone = " ".join(f"a{i}" for i in range(300))
    rows = [(5, NEAR, "en"), (None, NEAR + " end", "en"), (None, alone, "de"), (None, "one more clean text", None)]
    assert near_kept(spark, rows) == Counter([rows[0], rows[2], rows[3]])


def test_near_dedup_knows_texts_under_one_id_apart(spark):
    alone = " ".join(f"a{i}" for i in range(300))
    rows = [(5, NEAR, "en"), (7, NEAR + " end", "en"), (7, alone, "de")]
    assert near_kept(spark, rows) == Counter([rows[0], rows[2]])


def test_near_dedup_leaves_one_document_of_tied_rows(spark):
    tied = near_kept(spark, [(5, NEAR, "en"), (5, NEAR + " end", "en"), (9, NEAR, "de")])
    assert tied.total() == 1 and next(iter(tied))[0] == 5
    assert near_kept(spark, [(None, NEAR, "en"), (None, NEAR + " end", "en"), (None, NEAR, "en")]).total() == 1
    repeated = [(5, NEAR, "en"), (5, NEAR, "en"), (6, NEAR, "en")]  # one document in two rows
    assert near_kept(spark, repeated) == Counter(repeated[:2])


def test_spark_hash_is_the_contracts_hash(spark):
    want = xxhash.xxh64_intdigest("a b é d".encode(), 42)
    assert spark.range(1).select(F.xxhash64(F.lit("a b é d"))).first()[0] % 2**64 == want


def test_golay_code_is_perfect_and_keys_meet():
    golay = simhash.Golay()
    assert sorted(set(golay.count.tolist())) == [1, 6]
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        keys, rows = simhash.fuzzy_keys(np.array([x, y], np.uint64), golay)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_distance_beyond_the_keys_is_an_error(spark):
    for find in (simhash.near_duplicates, simhash.drop_near_duplicates):
        with pytest.raises(ValueError, match="within 4 bits"):
            find(spark.createDataFrame([(1, NEAR, "en")], NEAR_DOCS), most=simhash.DISTANCE + 1)


def test_large_keys_are_dealt_in_blocks_with_the_same_result(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for x in rng.integers(0, 2**63, 20):
        for _ in range(8):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    one = {tuple(r) for r in components(simhash.fingerprint_links(frame)).collect()}
    assert one == {tuple(r) for r in components(simhash.fingerprint_links(frame, large=2)).collect()} and one


def test_links_in_runs_connect_what_is_close():
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([rng.integers(0, 2**20, 40), np.arange(60)]).astype(np.uint64))
    left, right = simhash.links_in_runs(np.zeros(len(fps), np.int64), fps, 2)
    assert len(left) < len(fps) and (np.bitwise_count(left ^ right) <= 2).all()

    def classes(pairs):
        of = {int(f): int(f) for f in fps}
        for _ in range(len(fps)):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    every = [(int(a), int(b)) for a in fps for b in fps if a < b and (int(a) ^ int(b)).bit_count() <= 2]
    assert classes([(int(a), int(b)) for a, b in zip(left, right, strict=True)]) == classes(every)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(100, 100), (101, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(50)}}


def slow_repeats(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        spans = tuple((a, next(b for b in range(a, len(w) + 1) if b not in gone)) for a in starts)
        out[(r[0], len(w), len(gone), spans, " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def found_repeats(frame):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], tuple((s["a"], s["b"]) for s in r["spans"]), r["kept"]) for r in frame.collect())


def test_substring_dedup_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = edge_rows()
    for k in range(40):  # passages of all lengths around the limit, in different surroundings
        start, size = int(rng.integers(0, 200)), int(rng.integers(30, 60))
        own = [f"u{k}_{i}" for i in range(40)]
        at = int(rng.integers(0, 40))
        rows.append((200 + k, " ".join(own[:at] + [f"p{i}" for i in range(start, start + size)] + own[at:]), None, None, None, None))
    rows.append((300, " ".join(f"q{i % 5}" for i in range(200)), None, None, None, None))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    assert found_repeats(got) == slow_repeats(rows, substring_dedup.LENGTH)


def test_one_id_for_two_texts(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, shared + " a"), (1, "b " * 50), (2, "c " + shared)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found_repeats(got) == slow_repeats(rows, substring_dedup.LENGTH)


def test_rows_without_doc_id_are_told_apart_by_more_than_a_few_bits(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    seen, pairs = {}, []
    for i in range(40_000):  # a text with a repeat and a short one that agree in 23 bits of their hash
        text = f"{shared} long{i}" if i % 2 else f"short{i}"
        bits = xxhash.xxh64_intdigest(text.encode(), 42) & (1 << 23) - 1
        other = seen.setdefault(bits, text)
        if (len(other) > 40) != (len(text) > 40):
            pairs.append((other, text))
    assert pairs
    rows = [(None, text) for text in pairs[0]] + [(1, "lead " + shared), (None, pairs[0][0]), (None, pairs[0][0])]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found_repeats(got) == slow_repeats(rows, substring_dedup.LENGTH)


def test_anchor_is_the_rightmost_least_gram():
    words = np.array([7, 7, 7, 9, 7, 7, 7, 9, 1, 2, 3, 4], np.uint64)
    value, place = substring_dedup.anchors(words, length=6, gram=3)
    grams, _ = substring_dedup.anchors(words, length=3, gram=3)
    for s in range(len(words) - 5):
        window = grams[s : s + 4].tolist()
        assert value[s] == min(window) and place[s] == s + max(i for i, g in enumerate(window) if g == min(window))


def test_words_that_defeat_polynomial_hashes_are_told_apart(spark):
    a = b = ""
    for i in range(1024):
        odd = i.bit_count() % 2
        a, b = a + "ab"[odd], b + "ba"[odd]
    words = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*words, a])), (2, " ".join([*words, b]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


@pytest.mark.parametrize("length", [300, 700])
def test_long_windows(spark, length):
    text = " ".join(f"w{i}" for i in range(length + 320))
    frame = spark.createDataFrame([(1, text), (2, text), (3, text[4:])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame, length=length).collect()}
    assert got == {1: length + 320, 2: length + 320, 3: length + 318}
    with pytest.raises(ValueError, match="windows of"):
        substring_dedup.remove_repeats(frame, length=5)
