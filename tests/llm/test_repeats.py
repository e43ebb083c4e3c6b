"""Substring deduplication, the Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common, merkle, queries, runs, substrings


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


# -- substrings ---------------------------------------------------------------------------


def plain_repeats(rows):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words, gone = words_of(text), set()
        for a in range(len(words) - 19):
            window = tuple(words[a : a + 20])
            if window in seen:
                gone.update(range(a, a + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), sha(kept), kept))
    return out


def passages_corpus(seed, n=250):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choice(passages)
            elif kind < 0.5:
                words += ["x"] * rng.randrange(1, 60)
            else:
                words += [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 40))]
        rows.append((d, " ".join(words)))
    rows += [(-5, rows[30][1]), (3, rows[3][1]), (None, rows[40][1]), (900, None), (901, ""), (902, " \t\n"), (903, "a b " * 3000), (904, "Ö ß c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [10_000, 3, 0])
def test_drop_repeats_equals_brute_force(make, group):
    """All prefixes in subtrees, some lengthened, all lengthened to the window."""
    rows = passages_corpus(group)
    docs = make([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, f int, stretches string").repartition(3)
    got = substrings.drop_repeats(docs, group=group)
    assert by_text(got.collect()) == by_text(plain_repeats(rows))


def test_drop_repeats_by_shuffle_and_on_files(make, monkeypatch, tmp_path):
    rows = passages_corpus(9)
    make(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = make([], "doc_id long, text string").sparkSession.read.parquet(str(tmp_path / "docs"))
    want = by_text(plain_repeats(rows))
    assert by_text(substrings.drop_repeats(docs).collect()) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert by_text(substrings.drop_repeats(docs, group=50).collect()) == want
    assert substrings.drop_repeats(docs.limit(0)).count() == 0


def test_subtrees_of_many_groups_at_once(make, monkeypatch):
    """A task refines whole groups, some at a time, whatever the size of its batches."""
    monkeypatch.setattr(substrings, "TOGETHER", 7)
    spark = make([], "a int").sparkSession
    rows = passages_corpus(4, 60)
    texts = [(1, i, d, (t or "").encode()) for i, (d, t) in enumerate(rows)]
    found = []
    for f, i, d, t in texts:
        words = t.split()
        at, h, first, end = substrings.anchors(substrings._CODES.of(words))
        assert [w for a, z in zip(first, end, strict=True) for w in range(a, z)] == list(range(max(0, len(words) - 19)))
        found += [(int(x.view("int64")), d, f, i, int(a), int(p - a), b" ".join(words[a : z + 19])) for p, x, a, z in zip(at, h, first, end, strict=True)]
    table = substrings.pa.Table.from_pylist([dict(zip(substrings._SUFFIX.names, r, strict=True)) for r in sorted(found, key=lambda r: r[0])], substrings._SUFFIX)
    got = {(r["i"], w) for b in substrings._subtrees(iter(table.to_batches(5))) for r in b.to_pylist() for w in range(r["a"], r["z"])}
    want, seen = set(), set()
    for _, i, _, t in sorted(texts, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        words = t.split()
        for a in range(len(words) - 19):
            window = tuple(words[a : a + 20])
            if window in seen:
                want.add((i, a))
            seen.add(window)
    assert got == want
    assert spark


# -- manifest -----------------------------------------------------------------------------


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r, r[1]) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    root, out = top[-1][0] if rows else None, []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = []
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    path.append((at % 8, level[at // 8 * 8 : at // 8 * 8 + 8]))
                    at //= 8
            text = r[1]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for at, run in path:
                folded = sha(*run[:at], folded, *run[at + 1 :])
            proof = sha(*[d for at, run in path for j, d in enumerate(run) if j != at])
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], root, proof, folded, folded == root))
    return out


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("n", "height"), [(0, 4), (1, 4), (9, 4), (65, 1), (700, 2), (5000, 4)])
def test_manifest_equals_plain_trees(make, n, height):
    """One to five sweeps up and down, of 1, 2 or 4 levels."""
    rng = random.Random(n)
    texts = [None, "", "Some Text Ö", "abc X", "long " * 5000]
    rows = [
        (i if rng.random() < 0.99 else None, rng.choice(texts), rng.choice([None, "", "en", "en", "en", "de", "é", "Z"]), rng.choice([None, "s"]), rng.choice([None, 3]))
        for i in range(n)
    ]
    rows += rows[:10]
    docs = make([(*r, 1, "y") for r in rows], DOC + ", idx int, digest string")
    got = merkle.manifest(docs, tampered=merkle.tamper(), levels=height)
    assert by_text(got.drop("proof").collect()) == by_text(plain_manifest(rows))
    calm = merkle.manifest(docs, levels=height)
    assert calm.filter(~F.col("verified")).count() == 0


def test_manifest_equals_its_sql(make, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "A b", "Ö X"]), rng.choice([None, "en", "de"]), rng.choice([None, "s"]), i) for i in range(600)]
    docs = make(rows, DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_merkle_manifest"](docs.sparkSession, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(queries.ORACLES["op12_merkle_manifest"])
    names = [d[0] for d in want.description]
    assert by_text(got.select(*names).collect()) == by_text(want.fetchall())


def test_queue_holds_one_run_per_level(monkeypatch):
    most = 0
    push = merkle.heapq.heappush

    def counted(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", counted)
    n = 8**4
    up = list(merkle.climb_block(((i, bytes([i % 256]) * 32) for i in range(n)), 4, n))
    assert most <= 8 * 4 and len(up) == 512 + 64 + 8 + 1
    nodes = [(min((i + 1) * 8**level, n) - 1, level, i, b"".join(kids)) for level, i, kids, _ in up] + [(i, 0, i, i) for i in range(n)]
    nodes.sort(key=lambda x: (-x[0], -x[1]))
    most = 0
    found = list(merkle.descend_block(iter(nodes), None, n))
    assert most <= 8 * 4 and [load for load, _ in found] == list(range(n))[::-1]
    assert all(merkle.fold_up(bytes([i % 256]) * 32, suffix) == up[-1][3] for i, suffix in found[::97])


# -- runs ---------------------------------------------------------------------------------


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_run_row(d, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(("" if d is None else str(d)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (d, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_text(rng, size):
    words = []
    while len(words) < size:
        part = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
        words += part * (rng.randrange(1, 9) if rng.random() < 0.5 else 1)
    return words


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = [[w.encode() for w in periodic_text(rng, rng.randrange(0, 120))] for _ in range(rng.randrange(1, 5))]
        assert runs.find_runs(*runs.number_words(texts)) == [plain_runs(t) for t in texts]


def test_run_digests(make):
    rng = random.Random(5)
    rows = [(i, " ".join(periodic_text(rng, rng.randrange(0, 90)))) for i in range(200)]
    rows += [(5, None), (6, ""), (None, "a b c d e f " * 9), (7, "z " * 1500), (7, "z " * 1500), (8, "x\ty\x0bz w ")]
    docs = make([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, runs int")
    got = runs.digests(runs.periodic_runs(docs, plant=True))
    assert by_text(got.collect()) == by_text(plain_run_row(d, t) for d, t in rows)
    assert runs.digests(runs.periodic_runs(docs.limit(0))).count() == 0
    kept = runs.periodic_runs(make([(1, "go a b a b a b a b stop")], "doc_id long, text string")).first()
    assert kept["collapsed"] == "go a b stop" and [tuple(r) for r in kept["runs"]] == [(1, 8, 2)]
