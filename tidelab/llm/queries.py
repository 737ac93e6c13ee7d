"""The registered queries of this subpackage: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelab.session import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.packing import pack_documents

    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op7_records")
def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.records import token_records

    return token_records(spark, read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.simhash import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"), words=3, radius=3)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.sharding import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.secrets import digest, find_secrets

    return digest(find_secrets(read_table(spark, sf_dir, "documents")))


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


@query(
    "op4_embeddings",
    """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, n.b FROM reach r JOIN near n ON n.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM near n WHERE n.a = e.vec_id) AS n_links, min(r.other) AS component_id,
       e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r ON r.vec_id = e.vec_id GROUP BY e.vec_id""",
)
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.embeddings import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.quality import score_quality, train

    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, read_table(spark, sf_dir, "labels")))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.toxicity import score_toxicity, train

    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.decontam import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op13_language_model")
def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.language_model import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"), order=2)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.alignment import align_documents

    docs = read_table(spark, sf_dir, "documents")
    return align_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))[0]


@query(
    "op11_collocations",
    r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.f AS l, r.f AS r, t.n, c.c,
         (1000::HUGEINT * c.a::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.k = c.c AND l.phrase = array_to_string(c.ws[1 : c.c], ' ')
  JOIN grams r ON r.lang = c.lang AND r.k = c.k - c.c AND r.phrase = array_to_string(c.ws[c.c + 1 : c.k], ' ')),
weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored) WHERE place = 1),
inner_parts AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, ws, k, a, unnest(range(1, k)) AS i FROM candidates), (VALUES (2), (3), (4)) s(m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
free AS (
  SELECT w.* FROM weakest w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE p.a IS NULL OR 100 * p.a < 100 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelab.llm.collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))
