"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from . import collocations, conversations, exact, jaccard, language, licenses, lines, minhash, packing, pieces, quality, sql, urls, warc
from .registry import ORACLES, QUERIES, register  # noqa: F401
from .tables import table

URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


@register("op9_quality_forest")
def op9_quality_forest(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


@register("op5_ngram_jaccard")
def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@register("op8_language_ppm")
def op8_language_ppm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language.identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


@register("op2_cost_packing")
def op2_cost_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op3_cuckoo_dedup", sql.EXACT)
def op3_cuckoo_dedup(spark, sf_dir):
    rows = materialize(exact.digests(table(spark, sf_dir, "documents")), "digests")
    found = exact.resolve(rows, exact.build_index(rows))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op4_line_dedup", sql.LINES)
def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.bitmaps(docs), counts=True)
    return kept.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@register("op6_piece_chunks")
def op6_piece_chunks(spark, sf_dir):
    coded = pieces.encoded(F.col("text").cast("string"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", "c.*")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op7_warc_index", sql.WARC)
def op7_warc_index(spark, sf_dir):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, f"{folder}/archives")
    warc.build_index(spark, f"{folder}/archives", f"{folder}/index")
    asked = pages.select(warc.url_keys(F.col("url")).alias("key"))
    found = warc.read_records(warc.look_up(spark, f"{folder}/index", asked), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op1_licence_sentences", sql.LICENCES)
def op1_licence_sentences(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.transform("sentences", lambda x: x["id"].cast("string")), ",")
    return found.select(
        "doc_id", F.when(F.size("sentences") > 0, F.concat(F.lit(","), ids, F.lit(","))).otherwise(",").alias("sentence_ids"),
        F.array_join("rules", "|").alias("rules"), F.array_join("licences", "|").alias("licences"), F.array_join("expressions", "|").alias("expressions"),
    )


@register("op10_host_words")
def op10_host_words(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("tokens", " ").alias("tokens"), "score")


@register("op13_phrase_fm", sql.PHRASES)
def op13_phrase_fm(spark, sf_dir):
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@register("op12_minhash_hamming")
def op12_minhash_hamming(spark, sf_dir):
    found = minhash.classes(table(spark, sf_dir, "documents"), words=4, num=80, den=100)
    return found.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register("op11_turn_repair")
def op11_turn_repair(spark, sf_dir):
    rows = conversations.prepared(table(spark, sf_dir, "conversations"))
    return conversations.repair(conversations.damaged(rows))
