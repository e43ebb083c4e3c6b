"""The registered queries of the training-data operators and the SQL that some must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, lm, merkle, packing, runs, secrets, simhash, substrings, topk, toxicity, urls
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k=5)


ORACLES["op1_topk_search"] = """
WITH part AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
good AS (SELECT vec_id FROM part GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x))),
q AS (SELECT vec_id, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM part WHERE vec_id IN (SELECT vec_id FROM good)),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM q a JOIN q b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    rank_file = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), rank_file)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), rank_file)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), near=True)


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_whole(turns))


def _escaped_chars(column: str) -> str:
    """SQL for the length of an escaped text: one more for each backslash and each control string."""
    more = [f"length({column}) - length(replace({column}, '\\', ''))"]
    more += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL]
    return f"(length({column}) + " + " + ".join(more) + ")"


ORACLES["op5_chat_format"] = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
s AS (SELECT *, {len(chat.TURN + chat.TEXT + chat.END)} + {_escaped_chars("role")} + {_escaped_chars("text")} AS n FROM t),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS closes FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR closes) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(read(spark, sf_dir, "documents"), with_text=False).drop("kept")


ORACLES["op11_substring_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 18)) AS s,
           unnest(list_transform(range(1, len(w) - 18), lambda s: array_to_string(w[s:s + 19], ' '))) AS words FROM t),
again AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again),
kept AS (
    SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS text, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t) a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i
    GROUP BY a.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=merkle.tamper()).drop("proof")


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text: bit by bit, from the reflected polynomial."""
    bits = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii({text}[i]) >> b) & 1)))"
    step = "lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || CAST({bits} AS BIGINT[]), {step}), 4294967295)"


def _leaf(text: str) -> str:
    parts = [*(f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")), text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


def _climbed(tree: str, leaves: str) -> str:
    """SQL of all nodes (g, level, i, d, n) of the trees over ``leaves(g, i, d, n)``."""
    return f"""{tree} AS (
    SELECT g, 0 AS level, i, d, n FROM {leaves}
    UNION ALL SELECT g, level + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 7) // 8 FROM {tree} WHERE n > 1 GROUP BY g, level, i // 8)"""


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(':' || lang, '-') AS g, {_leaf("text")} AS leaf,
           CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                ELSE {_leaf("text")} END AS found
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
leaves AS (SELECT g, i, leaf AS d, n FROM placed),
{_climbed("tree", "leaves")},
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
tops AS (SELECT '' AS g, i, d, n FROM subroots),
{_climbed("forest", "tops")},
root AS (SELECT d FROM forest WHERE n = 1),
stretch AS (
    SELECT g, level, i // 8 AS parent, list(d ORDER BY i) AS run FROM tree WHERE n > 1 GROUP BY ALL),
high AS (SELECT level, i // 8 AS parent, list(d ORDER BY i) AS run FROM forest WHERE n > 1 GROUP BY ALL),
steps AS (
    SELECT doc_id, level AS k, CAST(i // CAST(8 ** level AS BIGINT) % 8 AS INT) AS place, run
    FROM placed p JOIN stretch s ON s.g = p.g AND s.parent = p.i // CAST(8 ** (level + 1) AS BIGINT)
    UNION ALL
    SELECT doc_id, 100 + h.level, CAST(r.i // CAST(8 ** h.level AS BIGINT) % 8 AS INT), h.run
    FROM placed p JOIN subroots r ON r.g = p.g JOIN high h ON h.parent = r.i // CAST(8 ** (h.level + 1) AS BIGINT)),
path AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS step FROM steps),
proof AS (SELECT doc_id, string_agg(array_to_string(run[1:place] || run[place + 2:], ''), '' ORDER BY step) AS text FROM path GROUP BY doc_id),
fold AS (
    SELECT doc_id, 1 AS step, found AS d FROM placed
    UNION ALL SELECT f.doc_id, f.step + 1, sha256(array_to_string(run[1:place] || [f.d] || run[place + 2:], ''))
    FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.step = f.step),
folded AS (SELECT doc_id, arg_max(d, step) AS d FROM fold GROUP BY doc_id)
SELECT p.doc_id, p.leaf, r.d AS subroot, root.d AS root, sha256(coalesce(proof.text, '')) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM placed p JOIN subroots r ON r.g = p.g CROSS JOIN root JOIN folded f ON f.doc_id = p.doc_id LEFT JOIN proof ON proof.doc_id = p.doc_id
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(read(spark, sf_dir, "documents"), plant=True, with_text=False))
