"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowcheck.llm import (
    align,
    decontaminate,
    line_dedup,
    lm_scoring,
    minhash,
    mixing,
    quality,
    spelling,
    substring_dedup,
    token_ids,
    toxicity,
    url_filter,
    warc,
)
from stowcheck.llm.tables import read_table, ship_code, stored
from stowcheck.session import configure, work_path


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by rule, else by the model trained on the URLs that rules decide."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(pages), store=lambda df: stored(df, "url_features"))
    judged = url_filter.judge(pages, model)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word shingle sets of similarity 0.85 or more."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, minhash.Plan(shingle=3, percent=85))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc.doc_id", *quality.MEASURES, "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of repeated three-line windows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc.doc_id", "n_lines", "n_removed", "text")


MIN_SHARED = 100


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as response and revisit records, and read back from the archives.

    A page whose payload equals that of a smaller page_id, and has 100 bytes or more, revisits it. NULL ids
    come last; rows that share the smallest id and the payload are all responses.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    shared = pages.where(F.col("size") >= MIN_SHARED).groupBy("digest")
    shared = shared.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # stored, so that Spark knows its size when it plans the join with the payloads
    records = pages.join(stored(shared, "shared_payloads"), "digest", "left")
    again = ~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    header = F.map_filter(
        F.create_map(
            F.lit("X-Page-Id"), F.col("page_id").cast("string"),
            F.lit("X-Payload-Length"), F.col("size").cast("string"),
            F.lit("X-Refers-To-Page"), F.when(again, F.col("first").cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    records = records.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-31T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn("first")).alias("refers_to"),
        header.alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    path = work_path(spark, "pages.warc")
    warc.write_warc(records, path)
    responses = warc.read_warc(spark, path).where("record_type = 'response'")
    responses = responses.withColumn("size", F.octet_length("payload").cast("long")).withColumn("hash", F.sha2("payload", 256))
    revisits = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    revisits = revisits.withColumn("size", F.try_element_at("headers", F.lit("X-Payload-Length")).cast("long"))
    revisits = revisits.withColumn("hash", F.substring_index("payload_digest", ":", -1))
    id_type = pages.schema["page_id"].dataType
    return responses.unionByName(revisits).select(
        F.try_element_at("headers", F.lit("X-Page-Id")).cast(id_type).alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("hash").alias("payload_digest"),
        "record_type",
        F.try_element_at("headers", F.lit("X-Refers-To-Page")).cast(id_type).alias("refers_to"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 40 words or more that an earlier document has too, exactly or nearly."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeated_passages(docs)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and model score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5
    scored = lm_scoring.score(docs, fold("doc_id") != 1)
    return scored.select(
        "doc.doc_id", (fold("doc.doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark"), pass_rows=F.struct("doc_id"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "row.doc_id",
        "found.n_words",
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learned from documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    labels = read_table(spark, sf_dir, "labels").where(fold != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.join(labels, "doc_id"), store=lambda df: stored(df, "toxic_sample"))
    scored = toxicity.score(docs, model)
    held_out = (F.crc32(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 0
    return scored.select(
        "doc.doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % takes of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mix = mixing.mix(docs)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mix.select("doc.doc_id", "size", "source_size", "target", taken.alias("taken"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written in order of documents, and read back from the files."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = work_path(spark, "documents.tokens")
    token_ids.write_documents(docs, path, tokenizer_file("word_bpe_49k.json"))
    return token_ids.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups and links of two tokenizers in every document, and how common its links are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, two_tokenizers())


def two_tokenizers() -> tuple[str, str, str, str]:
    import public_tokenizers

    files = map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    ranks, vocabulary, pieces = files
    return ranks, public_tokenizers.PATTERN, vocabulary, pieces


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them misspelled by a rule, with their near words, forms and roots."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.grouped(spelling.word_counts(docs, spelling.misspelled))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_minhash_dedup, op3_quality_rules, op4_line_dedup, op5_warc, op6_substring_dedup, op7_lm_scoring,
        op8_decontamination, op9_toxicity, op10_mixing, op11_token_ids, op12_tokenizer_alignment,
        op13_spelling_variants,
    )
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def configured(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return build(configure(spark), sf_dir)

        return run

    return {name: configured(build) for name, build in QUERIES.items()}
