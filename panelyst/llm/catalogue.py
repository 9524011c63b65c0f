"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelyst.llm import alignment, crf, fingerprints, langid, merkle, mixing, neardup, packing, pii, quality, repetition, tokens, urls, wavelet
from panelyst.llm.pii_examples import EXAMPLES
from panelyst.session import table_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def byte_encoder():
    """The encoder of the packing query, built on the executors."""
    path = public_tokenizers.path
    return packing.byte_encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_encoder)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return tokens.token_counts(table(spark, sf_dir, "documents"), path)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.languages(docs, langid.learn(docs, fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_switches")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of the url query.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _terms_sql(name: str, terms: tuple[str, ...]) -> str:
    each = [f"CAST(regexp_matches(u, '(^|[^a-z]){t}([^a-z]|$)') AS BIGINT)" for t in terms]
    return f"{' + '.join(each)} AS {name}"


OP5_SQL = f"""
WITH split AS (
    SELECT page_id, coalesce(url, '') AS url,
           translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u
    FROM pages),
parts AS (
    SELECT *, regexp_extract(u, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM split),
counted AS (
    SELECT *, {_terms_sql("n_strict", urls.STRICT)}, {_terms_sql("n_soft", urls.SOFT)},
        CASE WHEN NOT starts_with(path, '/') THEN NULL
             WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN host = 'com' OR host LIKE '%.com' THEN 'com/' END AS rule
    FROM parts)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_strict > 0 OR n_soft >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM counted
"""


def pii_model() -> crf.Model:
    return pii.train(map(pii.parse_example, EXAMPLES))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), pii_model())


#: Target weights of the sources; all others have 1.
TARGET = {"src0": 8, "src1": 4, "src2": 2}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGET)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """Fitted on labelled documents outside fold 2 of 4."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(quality.sample_labelled(docs, labels, fold("doc_id", 4) != 2))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


#: What a document's leaf holds, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; every third one is checked with an altered text."""
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    other = F.when(fold("doc_id", 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    claim = F.sha2(merkle.record(*LEAF[:-1], other), 256)
    made = merkle.manifest(docs, F.sha2(merkle.record(*LEAF), 256), "lang", "doc_id", {"claim": claim})
    root = F.lit(made.root).cast("string")
    return merkle.proofs(made).select(
        "doc_id", "leaf", "subroot", root.alias("root"), merkle.proof_digest().alias("proof_sha256"),
        merkle.folded("claim").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*LEAF[:-1], text)]
    return f"sha256({' || '.join(parts)})"


_CRC_STEP = "xor(a >> 1, 3988292384 * (a & 1))"
_RUNS_SQL = """
    SELECT {key}, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {table} WHERE n > 1
    GROUP BY {key}, level, i // 8, n
"""

OP11_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT *, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda a, k: {_CRC_STEP}, xor(c, b)), CAST(4294967295 AS BIGINT)) AS c
    FROM documents),
leaves AS (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql("text")} AS leaf,
        {_leaf_sql(f"CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS claim
    FROM docs),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
    FROM leaves),
nodes(tree, level, i, n, h) AS (
    SELECT tree, 0, i, n, leaf FROM placed UNION ALL {_RUNS_SQL.format(key="tree", table="nodes")}),
subroots AS (
    SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
over_nodes(one, level, i, n, h) AS (
    SELECT 1, 0, i, n, h FROM subroots UNION ALL {_RUNS_SQL.format(key="one", table="over_nodes")}),
up(doc_id, tree, level, leaf_at, n, i, proof, folded) AS (
    SELECT doc_id, tree, 0, i, n, i, '', claim FROM placed
    UNION ALL
    SELECT u.doc_id, u.tree, u.level + 1, u.leaf_at, (u.n + 7) // 8, u.i // 8,
        any_value(u.proof) || coalesce(string_agg(CASE WHEN x.i <> u.i THEN x.h END, '' ORDER BY x.i), ''),
        sha256(string_agg(CASE WHEN x.i = u.i THEN u.folded ELSE x.h END, '' ORDER BY x.i))
    FROM up u JOIN nodes x ON x.tree = u.tree AND x.level = u.level AND x.i // 8 = u.i // 8
    WHERE u.n > 1 GROUP BY u.doc_id, u.tree, u.level, u.leaf_at, u.n, u.i),
top(doc_id, tree, leaf_at, level, n, i, proof, folded) AS (
    SELECT u.doc_id, u.tree, u.leaf_at, 0, s.n, s.i, u.proof, u.folded FROM up u JOIN subroots s USING (tree) WHERE u.n = 1
    UNION ALL
    SELECT u.doc_id, u.tree, u.leaf_at, u.level + 1, (u.n + 7) // 8, u.i // 8,
        any_value(u.proof) || coalesce(string_agg(CASE WHEN x.i <> u.i THEN x.h END, '' ORDER BY x.i), ''),
        sha256(string_agg(CASE WHEN x.i = u.i THEN u.folded ELSE x.h END, '' ORDER BY x.i))
    FROM top u JOIN over_nodes x ON x.level = u.level AND x.i // 8 = u.i // 8
    WHERE u.n > 1 GROUP BY u.doc_id, u.tree, u.leaf_at, u.level, u.n, u.i)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root, t.folded = r.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN top t ON t.tree = p.tree AND t.leaf_at = p.i AND t.n = 1
CROSS JOIN (SELECT h FROM over_nodes WHERE n = 1) r
"""


def aligner() -> alignment.Aligner:
    """The two vocabularies of the alignment query, read on the executors."""
    path = public_tokenizers.path
    first = alignment.byte_level(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return alignment.Aligner(first, alignment.piece_level(path("piece_bpe_32k.model")))


#: Ids of the second vocabulary.
PIECES = 32_000


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), aligner, PIECES)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written into shards in the shared folder and read back from them."""
    folder = f"{table_folder(spark)}/shards"
    wavelet.write_shards(table(spark, sf_dir, "documents"), byte_encoder, folder)
    return wavelet.read_documents(spark, folder)


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_language": (op3_language, None),
    "op4_near_duplicates": (op4_near_duplicates, None),
    "op5_url_filter": (op5_url_filter, OP5_SQL),
    "op6_pii": (op6_pii, None),
    "op7_mixing": (op7_mixing, None),
    "op8_repetition": (op8_repetition, None),
    "op9_fingerprints": (op9_fingerprints, None),
    "op10_quality": (op10_quality, None),
    "op11_merkle": (op11_merkle, OP11_SQL),
    "op12_alignment": (op12_alignment, None),
    "op13_token_files": (op13_token_files, None),
}
