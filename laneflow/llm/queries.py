"""The operators of this subpackage as queries over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from laneflow.llm import alignment, bpe, exact, hashing, jaccard, kdtree, language, packing, secrets, sharding, suffixes, trie, warc
from laneflow.llm.common import materialise, small_batches, table, utf8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Only what rests on no tokenizer, trained model, archive or automaton can be stated in SQL.
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards by rendezvous hashing of doc_id, and where a 25th would take them."""
    text = utf8("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    now = sharding.assign_shards(docs, "doc_id", dict.fromkeys(range(24), 1.0))
    grown = sharding.assign_shards(now, "doc_id", dict.fromkeys(range(25), 1.0), "grown_shard")
    return sharding.number_slots(grown, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op3_combined_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, found by one automaton for all rules."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kinds: list[str]) -> Column:
        return F.filter("secrets", lambda x: x["kind"].isin(kinds))

    kinds = [rule.kind for rule in secrets.BASE_RULES]
    base, counts = of(kinds), [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


@query
def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the ranked byte-level vocabulary and decoded again."""
    small_batches(spark)
    tokenizer = bpe.tokenizer_from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), tokenizer).alias("ids"))
    return encoded.withColumn("decoded", bpe.decode(F.col("ids"), tokenizer)).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens in windows of 2048, packed online by the sum-of-squares rule."""
    tokenizer = bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, "text", tokenizer, end_id=1).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op5_error_correcting_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language.train(docs.where(fold != 0), "text", "lang")
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query
def op4_zip_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back by range."""
    marked = warc.mark_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    packages = warc.write_packages(marked, warc.archive_folder(spark))
    return warc.read_packages(packages, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op9_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for every 20th vector, exact, against all others."""
    return kdtree.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


@query
def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every 100th vector, by binary codes and reranking."""
    return hashing.approximate_nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, k=10)


@query
def op8_vertical_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that a document with a smaller id holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffixes.remove_repeats(docs, "doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select(
        "doc_id", F.length(utf8("text")).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents; the largest id of each group stays."""
    digest = {"text_sha256": F.sha2(utf8("text"), 256)}
    found = exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "largest", digest)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with the first turns of its group's first conversation."""
    own = trie.conversation_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    own = materialise(own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5), "turns")
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    begun = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(trie.TURNS))
    rebuilt = own.join(heads, "base", "left").withColumn("turns", F.concat(begun, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))))
    return trie.prefix_trie(rebuilt)


# The checksum is stated bit by bit; a node is known by the hashes of its turns in a row.
ORACLES["op12_conversation_prefix_trie"] = """
WITH turns AS MATERIALIZED (
  SELECT conv_id, coalesce(text, '') AS body, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS hash,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS MATERIALIZED (
  SELECT c.conv_id, t.hash, t.body, row_number() OVER (PARTITION BY c.conv_id ORDER BY part, t.place) AS depth
  FROM (SELECT conv_id, base AS origin, 0 AS part, 1 AS low, h AS high FROM convs
        UNION ALL SELECT conv_id, conv_id, 1, h + 1, 9223372036854775807 FROM convs) c
  JOIN turns t ON t.conv_id = c.origin AND t.place BETWEEN c.low AND c.high
), paths AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM convs
  UNION ALL
  SELECT conv_id, depth, string_agg(hash, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), octet_length(encode(body)) FROM rebuilt
), lengths AS (SELECT conv_id, max(depth) AS ends FROM paths GROUP BY conv_id
), nodes AS MATERIALIZED (
  SELECT min(p.conv_id) AS conv_id, depth, path, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
         coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE depth = ends), '') AS members
  FROM paths p JOIN lengths l ON p.conv_id = l.conv_id GROUP BY depth, path
), children AS MATERIALIZED (
  SELECT depth - 1 AS depth, left(path, -32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), below AS MATERIALIZED (
  SELECT p.depth, p.path, CAST(sum(n.own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE c.path IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.path = c.path
  JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens, sha256(n.members) AS ends_sha256
FROM nodes n JOIN below b ON n.depth = b.depth AND n.path = b.path
LEFT JOIN children c ON n.depth = c.depth AND n.path = c.path
LEFT JOIN nodes above ON above.depth = n.depth - 1 AND above.path = left(n.path, -32) AND n.depth > 0
"""


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizers: groups of tokens that end together, and how usual their links are."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        pieces = file.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = alignment.build_index(docs, "doc_id", "text", bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), pieces)
    scores = materialise(index.pair_scores(), "pair-scores")
    return index.document_scores(scores).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
