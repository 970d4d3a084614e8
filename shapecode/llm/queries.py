"""The registered queries of this subpackage: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.llm import oracle
from shapecode.llm.common import table

SHARDS = 40
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_countmin_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier elsewhere removed; digests of what is kept, for every document."""
    from shapecode.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)


def op2_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units: (doc_id, item_ids, n_words, verbatim)."""
    from shapecode.llm.decontaminate import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces and packed into sequences of at most 2048 ids."""
    from shapecode.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through the trigram index."""
    from shapecode.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and spans that the trained classifier adds."""
    from shapecode.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of equal-label vectors of cosine 0.93 or more."""
    from shapecode.llm.embed_dedup import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op7_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by nearest-neighbour voting."""
    from shapecode.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op8_minhash_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and groups of documents whose five-word sets have a Jaccard similarity of 0.8 or more."""
    from shapecode.llm.ngram_join import link_texts

    return link_texts(table(spark, sf_dir, "documents")).drop("row_key")


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC, normalised to a member a record, and read back through the index."""
    from shapecode.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the Feistel permutation of its row number."""
    from shapecode.llm.sharding import shard_rows

    rows = shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op11_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its first positives."""
    from shapecode.llm.hard_negatives import mine

    label = F.col("label")
    return mine(table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 100 == 0,
                relabel=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold dropped, but for the largest document's; digests of what is kept."""
    from shapecode.llm.line_dedup import drop_repeated_lines

    return drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


def op13_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations with the totals of its subtree."""
    from shapecode.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py applied to all documents: the packed pieces."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


REGISTRY = {
    "op1_countmin_windows": (op1_countmin_windows, oracle.REPEATED_WINDOWS),
    "op2_template_windows": (op2_template_windows, None),
    "op3_minimum_bin_slack": (op3_minimum_bin_slack, None),
    "op4_trigram_index": (op4_trigram_index, None),
    "op5_weak_supervision": (op5_weak_supervision, None),
    "op6_collision_counting": (op6_collision_counting, oracle.VECTOR_LINKS),
    "op7_neighbour_voting": (op7_neighbour_voting, None),
    "op8_minhash_banding": (op8_minhash_banding, oracle.NGRAM_LINKS),
    "op9_warc_normaliser": (op9_warc_normaliser, oracle.WARC_ROUND_TRIP),
    "op10_feistel_shards": (op10_feistel_shards, oracle.feistel_shards(SHARDS)),
    "op11_shared_lists": (op11_shared_lists, oracle.HARD_NEGATIVES),
    "op12_bloom_lines": (op12_bloom_lines, oracle.SHARED_LINES),
    "op13_time_forward": (op13_time_forward, oracle.PREFIX_TRIE),
    "pipeline": (pipeline, None),
}
