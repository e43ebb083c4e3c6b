"""Exact and SimHash deduplication against brute force, and their odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import components, exact, jaccard, simhash
from gridspark.llm.common import with_row_key
from gridspark.llm.jaccard import near_rows
from gridspark.operators.joins import ensure_checkpoint_dir

ODD = [
    (1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (3, None, None), (4, "", "x"), (None, "", "x"),
    (5, "A  b\tc d", "x"), (6, "long " * 20000, "x"), (7, "é ü ß", None), (8, "one", "x"), (8, "two", "x"),
]
SCHEMA = "doc_id long, text string, h string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, budget=3):
    """(id, fp) pairs -> smallest id reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= budget:
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize(("capacity", "broadcast"), [(1_000_000, 1_000_000), (1, 0)])
def test_exact_groups(make, monkeypatch, capacity, broadcast):
    monkeypatch.setattr(exact, "BROADCAST_CHAINS", broadcast)
    got = sorted(map(tuple, exact.exact_groups(make(ODD, SCHEMA), capacity=capacity).collect()), key=str)
    by = {}
    for d, t, _ in ODD:
        by.setdefault(t or "", []).append(d)
    want, seen = [], set()
    for d, t, _ in ODD:
        ids = by[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        kept = d == top and (t or "") not in seen
        if kept:
            seen.add(t or "")
        want.append((d, top, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_directory_splits_overfull_buckets(make):
    entries = make([((i - 32) << 58,) for i in range(64)] + [(5,)] * 100, "h long")
    rows = exact.directory(entries, capacity=40, max_depth=6).collect()
    assert {r["local_depth"] for r in rows} == {1, 2, 3, 4, 5, 6}
    assert len({(r["bucket"], r["local_depth"]) for r in rows}) == len({r["bucket"] for r in rows})


def test_exact_drop_keeps_one_row_and_the_columns(make):
    docs = make(ODD, SCHEMA)
    out = exact.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted(
        {(2, "a b c d"), (4, ""), (5, "A  b\tc d"), (6, "long " * 20000), (7, "é ü ß"), (8, "one"), (8, "two")}
    )
    assert exact.drop_exact_copies(docs.limit(0)).count() == 0


def test_fingerprints_and_components(make):
    rng = random.Random(5)
    rows = list(ODD)
    for i in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        rows.append((100 + 2 * i, " ".join(base), "x"))
        base[rng.randrange(120)] = "changed"
        rows.append((101 + 2 * i, " ".join(base), "x"))
    got = simhash.near_groups(make(rows, SCHEMA)).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    fps = [(d, plain_fingerprint(t)) for d, t, _ in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_groups(make([], SCHEMA)).count() == 0


@pytest.mark.parametrize("group", [200_000, 3])
def test_near_links_equal_all_pairs(make, group):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0]
    fps = set(seeds)
    for s in seeds:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                s ^= 1 << b
            fps.add(s)
    fps = sorted(fps)
    links = simhash.near_links(make([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"), group=group)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = plain_components(list(zip(signed, fps, strict=True)))
    assert [roots.get(s, s) for s in signed] == want


def test_components_of_a_long_chain(make):
    links = make([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_near_drop_keeps_the_smallest_id(make):
    rows = [(1, "a b c d e", 1), (2, "a b c d e", 2), (3, "other words here", 3), (None, "a b c d e", 4), (1, "a b c d e", 5)]
    out = simhash.drop_near_copies(make(rows, "doc_id long, text string, u long"))
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]
    assert out.columns == ["doc_id", "text", "u"]


def test_pipeline_drops_by_fingerprints(make):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(5, " ".join(words)), (3, " ".join([*words[:-1], "z"])), (None, " ".join(words)), (8, "other words here"), (9, ""), (7, None), (3, "apart")]
    # a Jaccard similarity of 5 / 14, but near fingerprints
    short = [(20, " ".join(["a b c d e"] * 30 + ["x y"])), (21, " ".join(["a b c d e"] * 30 + ["u v w x y z q"]))]
    assert bin(simhash.fingerprint(short[0][1].encode()) ^ simhash.fingerprint(short[1][1].encode())).count("1") <= 3
    out = corpus_pipeline.near_dedup(None, make(rows + short, "doc_id long, text string"), "")
    assert {tuple(r) for r in out.collect()} == {rows[1], rows[2], rows[3], rows[5], rows[6], short[0]}


def test_near_drop_finds_all_pairs_of_similarity(make):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(i % 4):  # up to three words changed: from 0.77 to 1
            words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
        rows.append((2 * i + 1, " ".join(words)))

    def grams(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    want = {d for d, _ in rows}
    for (_, a), (d, b) in zip(rows[::2], rows[1::2], strict=True):
        if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)):
            want.discard(d)
    out = simhash.drop_near_copies(make(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == want


def test_near_drop_of_a_large_group_with_a_chain(make):
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 9):  # each step changes four words: neighbours are alike (0.82), the ends are not
        base = base[:]
        base[20 * i : 20 * i + 4] = [f"x{i}{j}" for j in range(4)]
        rows.append((i, " ".join(base)))
    out = simhash.drop_near_copies(make(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_near_drop_keeps_clean_texts_of_a_repeated_id(make):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more")]
    out = simhash.drop_near_copies(make(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, one), (1, two)]


def five_grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_classes(texts):
    """Smallest position reachable over pairs of similarity 0.8, by comparing all pairs."""
    sets, root = [five_grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    return root


def near_classes(make, texts, **more):
    docs = make(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = near_rows(with_row_key(docs, "f", "i"), "doc_id", **more).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r["root"], []).append(r["id"])
    least = {d: min(ids) for ids in classes.values() for d in ids}
    assert len(rows) == len(texts)
    return [least[i] for i in range(len(texts))]


def test_near_classes_equal_all_pairs(make):
    """Families of texts around the threshold, in chains, with copies, short and empty texts."""
    rng = random.Random(11)
    texts = [None, "", " \t", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, 8)):
            words = words[:]
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    assert near_classes(make, texts) == plain_classes(texts)


def test_open_bands_compare_no_pairs_of_boilerplate(make):
    """300 texts share 70 % of their words, no two are alike: they share bands, but no rare shingle."""
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(140)]
    texts = [" ".join([*shared, *(f"t{d}x{j}" for j in range(60))]) for d in range(300)]
    texts += [texts[0].replace("t0x5 ", "changed "), texts[1].replace("s7 ", "other ")]
    rng.shuffle(texts)
    sets = make([], "a int").sparkSession.createDataFrame(
        [(i, i, [int(x) for x in own.view("int64")]) for i, own in enumerate(jaccard.shingle_sets([t.encode().split() for t in texts]))], "node long, root long, s array<long>"
    )
    tokens = jaccard.prefix_tokens(sets, 0.8).withColumn("root", F.col("node"))
    pairs = jaccard.prefix_pairs(tokens, 0.8).collect()
    assert len(pairs) <= 10  # of 45,451
    classes = near_classes(make, texts)
    assert sum(c != i for i, c in enumerate(classes)) == 2


def test_prefix_pairs_leave_none_out(make):
    rng = random.Random(8)
    base = [rng.getrandbits(40) for _ in range(60)]
    sets = []
    for _ in range(80):
        own = set(rng.sample(base, rng.randrange(30, 60))) | {rng.getrandbits(40) for _ in range(rng.randrange(0, 8))}
        sets.append(sorted(own))
    tokens = jaccard.prefix_tokens(make(list(enumerate(sets)), "node long, s array<long>"), 0.8).withColumn("root", F.col("node"))
    got = {(r["u"], r["v"]) for r in jaccard.prefix_pairs(tokens, 0.8).collect()}
    assert 0 < jaccard.pivot_pairs(tokens, 0.8, 1).count() < jaccard.PIVOTS * tokens.count()
    for i in range(80):
        for j in range(i + 1, 80):
            both = len({*sets[i]} & {*sets[j]})
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got


def test_large_star_is_dealt_to_several_tasks(make, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARE", 3)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(60)]
    assert set(near_classes(make, texts)) == {0}


def test_same_letters_are_linked(make):
    texts = ["Order 17, paid!", "order 4 - PAID", "order", "7 8 9", "7 8 8", "Straße 5", "straße 77", "Strasse"]
    assert near_classes(make, texts, letters=True) == [0, 0, 2, 3, 4, 5, 5, 7]


def test_intermediate_tables_are_deleted(make):
    docs = make([(i, f"a b c d e {i % 3}") for i in range(30)], "doc_id long, text string")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    files = lambda: len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    before = files()
    near_rows(with_row_key(docs, "f", "i"), "doc_id")
    assert files() - before == 2  # the rows written first, and the result


def test_exact_drop_takes_null_and_empty_for_one_text(make):
    out = exact.drop_exact_copies(make([(5, None), (5, ""), (4, ""), (None, "a"), (None, "a"), (6, "b")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "a"), (5, ""), (6, "b")]
