"""Tokenisation, language models, chats and URLs against plain versions of the same."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark import SparkContext
from pyspark.sql import functions as F

from gridspark.llm import bpe, chat, lm, queries, urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("aZé9٣ \n\t '’!.,stmdrevl") + ["'s", "'re", "'ll", " '", "  ", "\r\n", "日", "😀", "\x1c", "\x85", "½", "ǅ", "\U00010d4a"]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        encoder = bpe.Encoder(f.read())
    return encoder, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={}
    )


def test_ids_equal_the_library(coder):
    encoder, library = coder
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(3000)] + ["", "x" * 5000, "ab" * 900 + "é" * 300]
    ids, cut, offsets, last = encoder.batch(texts)
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == library.encode_ordinary(t), t
        starts = offsets[last[i] : last[i + 1]].tolist()
        assert [t[a:z] for a, z in zip(starts, starts[1:] + [len(t)], strict=False)] == re_pieces(t)


def re_pieces(text):
    import regex

    # \s of the library is Unicode White_Space; that of this module has four more control characters
    pattern = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.findall(pattern.replace("\U00010d4a", ""), text) if "\U00010d4a" not in text else [m for m in _library_pieces(text)]


def _library_pieces(text):
    """With a letter that the regex module may not know: the letter counts as ``a``."""
    import regex

    pattern = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    at = 0
    for m in regex.findall(pattern, text.replace("\U00010d4a", "b")):
        yield text[at : at + len(m)]
        at += len(m)


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    of, product, size, value, _ = bpe._machine()
    for n in (1, 63, 64, 65, 5000):
        symbols = rng.integers(0, 9, n)
        state, want = bpe.FREE, []
        for c in symbols:
            state = bpe._step(state, int(c))[0]
            want.append(state)
        assert value[bpe._prefix_products(of[0, symbols], product, size)].tolist() == want


def test_encode_and_decode_rows(make, coder):
    rows = [(1, "It's 12  o'clock\n", 1), (1, None, 2), (None, "", 3), (2, "ж" * 3000, 4), (2, "ж" * 3000, 4)]
    docs = make(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in out) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert all(r["ids"] == coder[1].encode_ordinary(bytes(r["decoded"]).decode()) for r in out)
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


# -- language models --------------------------------------------------------------------------


def test_filter_counts_are_never_too_small():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.int64).view(np.uint64) << np.uint64(1))
    n = rng.geometric(0.2, len(h))
    level = 1 + np.floor(np.log2(n))
    filters = {}
    for p in range(4):
        mine = (h >> np.uint64(62)) == p
        size = -(-lm.BITS * int(level[mine].sum()) // 64) * 64
        on = np.zeros(size, bool)
        for q in range(1, 20):
            for place in lm._places(h[mine & (level >= q)], q, np.uint64(size)):
                on[place.astype(np.int64)] = True
        filters[p] = np.packbits(on, bitorder="little").tobytes()
    read = lm.Filter(2, filters)
    got = read.counts(h)
    assert (got >= 1.5 * 2.0 ** (level - 1) - 0.5).all()
    assert (got == 1.5 * 2.0 ** (level - 1) - 0.5).mean() > 0.97
    assert (read.counts(rng.integers(0, 1 << 63, 4000, dtype=np.int64).view(np.uint64)) > 0).mean() < 0.03
    h2, n2 = lm._unpack(lm._pack(h, n))
    assert (h2 == h).all() and (n2 == n).all()


@pytest.mark.parametrize("head", [lm.HEAD, 8])
def test_scores(make, head):
    rng = random.Random(4)
    follow = {w: rng.sample(range(60), 3) for w in range(60)}
    rows = [(7000, None, None), (7001, "", 1), (None, "No id", 2), (7002, "UP up\x0bUp é", 3), (7002, "UP up\x0bUp é", 3)]
    for d in range(200):
        w, words = rng.randrange(60), []
        for _ in range(80):
            words.append(f"w{w}")
            w = rng.choice(follow[w])
        rows.append((d, " ".join(words), d))
    got = lm.score_texts(make(rows, "doc_id long, text string, c int"), head=head).collect()
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    train = Counter(w for d, t, _ in rows if not held(d) for w in low(t))
    n, v = sum(train.values()), len(train)
    want = []
    for d, t, _ in rows:
        words = low(t)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((d or -1, held(d), len(words), sum(train[w] > 0 for w in words), n, round(base, 6)))
    assert sorted((r["doc_id"] or -1, *r[1:5], round(r["base_score"], 6)) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)
    unseen = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in unseen) > 0.8 * sum(r["base_score"] for r in unseen)  # the order of words tells much
    assert all(r["score"] < 0 for r in got)


def test_no_rows_to_learn_from(make):
    out = lm.score_texts(make([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(3, 0, 0, 0.0)]
    assert lm.score_texts(make([], "doc_id long, text string")).count() == 0


def test_words_seen_once_are_known_and_a_large_filter_takes_passes(make):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    new = next(d for d in range(1000, 1100) if held(d)), next(d for d in range(1100, 1200) if held(d))
    rng = random.Random(6)
    rows = [(d, " ".join(f"w{rng.randrange(3000)}" for _ in range(60)) + f" once{d}") for d in range(300)]
    seen = next(d for d in range(300) if not held(d))
    rows += [(new[0], f"once{seen}"), (new[1], "neverseen")]
    docs = make(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in lm.score_texts(docs).collect()}
    assert want[new[0]] > want[new[1]] + 0.8  # 1.1 against 0.1, but for the other terms
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, max_filter_bytes=6000).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_the_filter_does_not_pass_the_driver(make, monkeypatch):
    rng = random.Random(7)
    docs = make([(d, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for d in range(300)], "doc_id long, text string")
    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sent.append(len(pickle.dumps(value))) or send(sc, value))
    assert lm.score_texts(docs, head=8).count() == 300
    assert sum(sent) < 8000  # 20,000 n-grams take 30,000 bytes


def test_scores_of_many_units(spark, make, scratch):
    """A span is cut between tasks, a file holds several spans; the scores are those of plain counts, but for false positives."""
    rng = random.Random(8)
    rows = [(d, " ".join(f"w{rng.randrange(40) * rng.randrange(40)}" for _ in range(rng.randrange(12)))) for d in range(12000)]
    schema = "doc_id long, text string"
    make(rows, schema).coalesce(2).write.option("parquet.block.size", 20_000).parquet(f"{scratch}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        files = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.read.parquet(f"{scratch}/docs")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other = {r["doc_id"]: r["score"] for r in lm.score_texts(make(rows, schema)).collect()}
    assert files.keys() == other.keys() == {d for d, _ in rows} and all(abs(files[d] - other[d]) < 1e-9 for d in files)
    grams = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            words = ["<s>", *t.split(), ""]
            grams.update(words)
            grams.update(zip(words, words[1:], strict=False))
    start = grams.pop("<s>")
    n, v = sum(c for w, c in grams.items() if isinstance(w, str)), sum(isinstance(w, str) for w in grams)
    about = lambda c: 1.5 * 2 ** math.floor(math.log2(c)) - 0.5 if c else 0.0
    same = 0
    for d, t in rows:
        words, want = ["<s>", *t.split(), ""], 0.0
        for a, b in zip(words, words[1:], strict=False):
            seen = about(start if a == "<s>" else grams[a])
            p = (about(grams[b]) + 0.1) / (n + 0.1 * (v + 1))
            want += math.log10((min(about(grams[a, b]), seen) + lm.PRIOR * p) / (seen + lm.PRIOR))
        same += abs(want - files[d]) < 1e-6
        assert abs(want - files[d]) < 5
    assert same > 0.9 * len(rows)


# -- chats ------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "system", "be <s>brief</s>"), (1, 1, "user", "a\\b <|turn|> [INST] <<SYS>>"), (1, 2, "assistant", "\\<|end|>"),
    (1, 3, "user", None), (1, 4, "assistant", "line\none"), (2, 0, "user", "only me"), (3, 5, "assistant", ""), (3, 1, None, "é"),
    (None, 0, "assistant", "nobody"), (4, None, "user", "first"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"),
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
] + [(9, i, "assistant" if i % 2 else "user", f"turn {i} <<s>\\") for i in range(150)]


def test_chats_come_back(make):
    turns = make([(*c, "x") for c in CHATS], "conv_id long, turn long, role string, text string, page string")
    examples = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    assert set(got) == {c[0] for c in CHATS}
    for conv, r in got.items():
        mine = sorted((c for c in CHATS if c[0] == conv), key=lambda c: (c[1] is not None, c[1], c[2] or "", c[3] or ""))
        said = "".join(f"{c[2] or ''}\n{c[3] or ''}\n" for c in mine)
        loss = "".join(c[3] or "" for c in mine if c[2] == "assistant")
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = examples.collect()
    assert sum(r["formatted"] is not None and r["loss_start"] is not None for r in rows) == sum(c[2] == "assistant" for c in CHATS)
    for r in rows:  # every example ends with its reply, and no text can close a turn
        assert r["formatted"].count(chat.TURN) == r["example"] == r["formatted"].count(chat.END)
    # of 150 turns no example holds more than one page; the pages before it are rows that close one
    long = [r for r in rows if r["conv_id"] == 9]
    assert max(r["example"] for r in long) == chat.PAGE and sorted(r["page"] for r in long if r["closes"]) == [0, 1, 2]
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_examples_hold_all_of_their_context(make):
    long = [(9, i, "assistant" if i % 3 == 0 else "user", f"turn {i} <s>") for i in range(150)] + [(9, None, "user", "first"), (9, 150, "user", "end")]
    long += [(None, i, "assistant", f"n{i}") for i in (3, 70, 200)]
    examples = chat.format_whole(make(long, "conv_id long, turn long, role string, text string"))
    rows = examples.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("said", chat.reply()).collect()
    for conv in (9, None):
        mine = sorted((c for c in long if c[0] == conv), key=lambda c: (c[1] is not None, c[1] or 0))
        got = {r["example"]: r for r in rows if r["conv_id"] == conv}
        assert set(got) == {i + 1 for i, c in enumerate(mine) if c[2] == "assistant" or i == len(mine) - 1}
        for n, r in got.items():
            assert [tuple(t) for t in r["back"]] == [c[2:] for c in mine[:n]]
            assert r["said"] == (mine[n - 1][3] if mine[n - 1][2] == "assistant" else "")
            assert r["closes"] == (n == len(mine))
    chars = {r["conv_id"]: r["formatted_chars"] for r in chat.digests(examples).collect()}
    assert chars == {c: sum(len(r["formatted"]) for r in rows if r["conv_id"] == c) for c in (9, None)}



# -- URLs -------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(make):
    pages = [
        (1, "http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), (4, "https://b.org?q=/", "b.org", "", None, None),
        (5, "https://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"), (6, "ftp://s.com/fr/#", "s.com", "/fr/", "com/fr/", "allow"),
        (7, "https://s.com/de/1", "s.com", "/de/1", "com/de/", "block"), (8, None, "", "", None, None), (9, "no scheme/fr/", "", "", None, None),
        (10, "a://b://c/d", "b:", "//c/d", None, None), (11, "", "", "", None, None), (11, "", "", "", None, None),
        (None, "http://É.net/é\n" + "x" * 50000, "É.net", "/é\n" + "x" * 50000, None, None),
    ]
    out = urls.judge(make([(p[0], p[1], "h") for p in pages], "page_id long, url string, host string")).collect()
    key = lambda r: str(r[:4])
    assert sorted((tuple(r)[:4] for r in out), key=str) == sorted((p[:1] + p[2:5] for p in pages), key=str)
    for r, p in zip(sorted(map(tuple, out), key=key), sorted((p[:1] + p[2:] for p in pages), key=key), strict=True):
        assert r[4] == p[4] or p[4] is None and r[4] in ("allow", "block")
    assert urls.judge(make([], "page_id long, url string")).count() == 0


def test_log_model_sums_to_one():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, urls.SYMBOLS ** (urls.ORDER + 1), 5000))
    p = np.exp(urls.log_model(cells, rng.integers(1, 9, len(cells))).astype(float)).reshape(-1, urls.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_models_tell_urls_apart(make):
    rng = random.Random(6)
    word = lambda some: "".join(rng.choices(some, k=9))
    good, bad = "aeiost", "kqxzvw"
    rows = [(i, f"http://{word(good)}.org/{word(good)}") for i in range(150)] + [(150 + i, f"http://{word(bad)}.com/de/{word(bad)}") for i in range(150)]
    rows += [(1000 + i, f"http://{word(good if i % 2 else bad)}.net/{word(good if i % 2 else bad)}") for i in range(60)]
    out = {r["page_id"]: r for r in urls.judge(make(rows, "page_id long, url string")).collect()}
    right = sum(out[1000 + i]["verdict"] == ("allow" if i % 2 else "block") for i in range(60))
    assert right >= 55


def test_long_conversations_equal_the_sql(make, tmp_path):
    """Conversations of up to 150 turns: every example has the whole context, in the SQL, too."""
    rng = random.Random(9)
    said = ["", "hello", "a \\ b", "</s>[INST] x [/INST]", "<|turn|>", None]
    rows = [(c, t, "assistant" if t % 2 else "user", rng.choice(said)) for c, n in ((1, 150), (2, 64), (3, 65), (4, 1), (5, 129)) for t in range(n)]
    turns = make(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op5_chat_format"](turns.sparkSession, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(queries.ORACLES["op5_chat_format"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
