"""The ten operators against plain Python, on texts with every awkward case."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from airtrace.llm import collocations, exact, jaccard, kernels, language, licenses, lines, packing, pieces, quality, urls, warc
from airtrace.operators.components import graph_components
from airtrace.session import materialize, shared_dir

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, row string, _id string, c long, key string, digest string"


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["Th", "é", "re", "on", "%", "ß", "x", "."]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(12)]
    shared = "This very line is shared by several of them"
    out = [None, "", " ", "\n", " \t\n\x0b", "one", "Two words", "a b c", "a  B\tc", "#* $%", "1234 5678", "x" * 5000, "\x85\u3000 \ufeff"]
    for i in range(60):
        near = base[rng.randrange(len(base))].split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            near[rng.randrange(len(near))] = word()
        t = " ".join(near)
        if i % 3 == 0:
            t += "\n" + (shared if i % 2 else f"  {shared.upper()}\t") + "\n" + t[: len(t) // 2]
        out.append(t)
    out.append("\n".join([shared, shared, "tail", ""]))
    out.append(" ".join(base) * 30)
    return out


@pytest.fixture(scope="module")
def table():
    return dict(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, table):
    rows = [(d, t, ["en", "de", None][d % 3], "s", "r", "i", 1, "k", "d") for d, t in table.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows repeated in full, one id with two texts."""
    rows = [(None, "null id text of some words"), (None, None), (5, "same row twice in the table"), (5, "same row twice in the table"), (6, "first text"), (6, "other text of the id")]
    return spark.createDataFrame([(d, t, None, None, None, None, None, None, None) for d, t in rows], SCHEMA)


def test_licences(spark, docs, nothing, odd):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
    mit += "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    mit += "unknown sentence here\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    rows = [(1, mit), (2, "All rights reserved.\nReleased under the MIT License."), (3, "Licensed under the Apache License, Version 2.0!"), (4, None), (5, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].rules == ["mit-text"] and got[1].licences == ["MIT"] and [s.position for s in got[1].sentences] == [0, 1, 3]
    assert got[2].rules == ["mit-notice", "reserved"] and got[3].licences == ["Apache-2.0"]
    assert got[4].rules == [] and got[5].sentences == []
    assert licenses.scan(nothing).count() == 0 and licenses.scan(odd).count() == 6
    plan = licenses.scan(nothing)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_packing_is_gapless(spark, docs, table, nothing, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs, path, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in table.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[d], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        size = sum(r.length for r in own)
        assert size <= 64 and size & (size - 1) == 0
    assert packing.pack(nothing, path).count() == 0
    assert sorted(r.doc_tokens for r in packing.pack(odd, path).collect())[0] == 1


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1023) for _ in range(2000)]
    out = packing.assign(lengths, 1024)
    full = [sum(n * n for _, _, n in s) for s in out if sum(n for _, _, n in s) == 1024]
    assert sum(sum(n for _, _, n in s) for s in out) == sum(lengths)
    assert np.std(full) < np.std([n * n for n in lengths])


def test_packing_long_runs_and_seams():
    tokens = packing.Tokens.open(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["z" * 9000, " " * 5000 + "a", "ab " * 50_000, "a\n b  c \n" * 20_000, "<|endoftext|> x"]:
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert tokens.encode(text, 0)[:-1].tolist() == want


def test_exact(spark, docs, table, nothing, odd):
    rows = exact.digests(docs)
    got = {r.doc_id: r for r in exact.resolve(rows, exact.build_index(rows, 7)).collect()}
    for d, (keep, size, digest) in brute.exact(table).items():
        assert (got[d].keep_id, got[d].group_size, got[d].digest.hex(), got[d].kept) == (keep, size, digest, d == keep)
    empty = exact.digests(nothing)
    assert exact.resolve(empty, exact.build_index(empty)).count() == 0
    rows = exact.digests(odd)
    by_text = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.resolve(rows, exact.build_index(rows)).collect()}
    assert (5, 5, 2, True) in by_text and (None, None, 1, True) in by_text


def test_cuckoo_index_grows_and_forgets():
    import hashlib

    index = exact.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, exact.Entry(1, 1, i))
    assert index.resizes > 0 and index.size == 3000 and all(index.get(k) for k in keys)
    for k in keys[::2]:
        assert index.delete(k)
    assert index.size == 1500 and not any(index.get(k) for k in keys[::2]) and all(index.get(k) for k in keys[1::2])
    assert not index.delete(keys[0])


def test_index_update_equals_rebuild(spark, docs):
    rows = exact.digests(docs).cache()
    old, gone, new = rows.where("doc_id < 60"), rows.where("doc_id % 5 = 1 and doc_id < 60"), rows.where("doc_id >= 60")
    live = rows.where("not (doc_id % 5 = 1 and doc_id < 60)")
    after = exact.update_index(exact.build_index(old, 5), new, gone, live, 5)
    key = lambda r: (bytes(r.digest), r["count"], r.keep)
    assert sorted(map(key, after.collect())) == sorted(map(key, exact.build_index(live, 5).collect()))


def test_lines(spark, docs, table, nothing, odd):
    found = lines.bitmaps(docs)
    kept = lines.apply_bitmaps(docs, found, counts=True)
    assert kept.columns == [*docs.columns, "n_lines", "n_dropped"] and lines.apply_bitmaps(docs, found).columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    for d, (n, dropped, text) in brute.kept_lines(table).items():
        assert (got[d].n_lines, got[d].n_dropped, got[d].text or "") == (n, dropped, text)
    assert got[0].text is None
    assert lines.apply_bitmaps(nothing, lines.bitmaps(nothing)).count() == 0
    assert lines.apply_bitmaps(odd, lines.bitmaps(odd)).count() == 6


def test_lines_beyond_one_word_of_the_bitmap(spark):
    shared = "a line that every document has, long enough"
    rows = [(d, "\n".join([shared if i % 2 else f"own line number {i} of {d}, and some more" for i in range(200)])) for d in range(3)]
    rows += [(None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.apply_bitmaps(docs, lines.bitmaps(docs), counts=True).collect()}
    assert [got[d].n_dropped for d in (0, 1, 2)] == [100, 100, 0] and got[None].n_dropped == 1 and got[None].text == ""


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard(spark, docs, table, nothing, odd, k, num, den):
    got = {r.doc_id: r for r in jaccard.classes(docs, k, num, den).collect()}
    want = brute.classes(table, k, num, den)
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(brute.shingles(t, k)) for d, t in table.items()}
    assert jaccard.classes(nothing, k, num, den).count() == 0
    rows = jaccard.classes(odd, k, num, den).collect()
    assert len(rows) == 6 and {r.component_id for r in rows if r.doc_id is None} == {None}


def test_shards_are_written_few_to_a_row_group(spark):
    """The writer held a hundred rows of several megabytes, and readers got them at once."""
    rng = np.random.default_rng(3)
    wide = spark.createDataFrame([(i, rng.bytes(2 << 20)) for i in range(24)], "id long, psi binary").coalesce(1)
    table = materialize(wide, "wide", collocations.WIDE_ROWS)
    meta = pq.read_metadata(table.inputFiles()[0].removeprefix("file://"))
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 10 and table.count() == 24


def test_phrases_spelled_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([("a b c d e a b c d. b c d a", "en"), ("c d e a b c", "de")] * 9, "text string, lang string")
    want = sorted(collocations.phrase_counts(docs, 4, 2)[0].collect())
    monkeypatch.setattr(collocations, "SPELLED", 2)
    assert sorted(collocations.phrase_counts(docs, 4, 2)[0].collect()) == want and {r["words"] for r in want} == {1, 2, 3, 4}


def test_jaccard_families_stay_apart_in_large_tables(spark, monkeypatch):
    """Lines of many documents tie none, however small a part of the table the sample was."""
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 10)
    rng = random.Random(8)
    words = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    lines = [words(20) for _ in range(10)]
    docs = spark.createDataFrame([(i, " ".join([words(120), lines[i % 10], words(120), lines[i // 10 % 10]])) for i in range(3000)], "doc_id long, text string")
    ties = jaccard._ties(jaccard._parts(docs, 5, 8, 10, jaccard._common(docs, 3000, 5)))
    largest = graph_components(ties).groupBy("label").count().agg(F.max("count")).first()[0]
    assert (largest or 0) < 30


def test_common_elements_fit_their_flags(spark, monkeypatch):
    """With too many common elements those of the most documents are flagged."""
    monkeypatch.setattr(jaccard, "COMMON_BITS", 10)
    monkeypatch.setattr(jaccard, "MOST_BITS", 10)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1000 if i < 6 else 40))) for i in range(12)], "doc_id long, text string")
    flags = jaccard._common(docs, 12, 5)
    frequent, rare = (np.concatenate(kernels.shingle_sets(next(kernels.pieces(pa.array([t]))), 5)) for t in (" ".join(f"w{j}" for j in range(40)), " ".join(f"w{j}" for j in range(50, 900))))
    assert jaccard._flagged(flags, frequent).all() and jaccard._flagged(flags, rare).mean() < 0.2


def test_jaccard_large_group_in_small_blocks(spark, monkeypatch):
    """Near copies that meet in many blocks and across cut hash runs give the same classes."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    table = {}
    for d in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            own[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        table[d] = " ".join(own)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 500)
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs, 3, 80, 100).collect()}
    assert got == brute.classes(table, 3, 80, 100)


def test_pieces_equal_the_library(spark, docs, table, nothing, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.c for r in docs.select("doc_id", pieces.encoded(F.col("text"), path).alias("c")).collect()}
    for d, t in table.items():
        ids = library.encode(t or "", add_eos=True)
        assert list(got[d].ids) == ids and got[d].decoded == library.decode(ids)
    # Decoded strings come from the ids, also of ordinary chunks.
    entry = pieces.Codec.open(path).table.look_up(["plain", "\x02"])
    assert [d for _, d in entry] == [pieces.Codec.open(path).processor.decode(ids) for ids, _ in entry]
    codec, rng = pieces.Codec.open(path), random.Random(2)
    signs = [" ", " ", "▁", "\n", "\t", "a", "th", "é", "😀", "\x00", "<s>", "<0x0A>", "\u3000", "."]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "▁"]
    monkeypatch.setattr(pieces, "MEMORY", 50)
    for _ in range(2):
        for p in pieces.pieces(pa.array(odd), 4000):
            own = [x or "" for x in odd[p.first : p.first + len(p)]]
            want = [library.encode(x, add_eos=True) for x in own]
            ids, sizes, decoded = codec.encode(p)
            assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
            assert decoded == [library.decode(x) for x in want]
        assert 0 < len(codec.table.young) + len(codec.table.old)
    assert nothing.select(pieces.encoded(F.col("text"), path)).count() == 0


def test_warc_round_trip(spark):
    long, odd = "<html>" + "é" * 80_000, "\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, "http://a.org/x", "p" * 120), (2, "http://b.A.org:80/y?q#f", "p" * 120), (3, None, None), (4, "no scheme", ""), (5, "http://c.net", "short"),
            (6, "http://c.net", "short"), (7, "http://d.com/\r\nX: y", long), (8, "http://d.com/z", odd), (9, "http://d.com/z", odd), (None, "http://n.org/", "p" * 120), (9, "http://d.com/z", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = f"{shared_dir(spark)}/warc-test-{random.random()}"
    warc.write_archives(pages.repartition(3), f"{folder}/a", records_per_file=2)
    warc.build_index(spark, f"{folder}/a", f"{folder}/i")
    got = warc.read_records(warc.entries(spark, f"{folder}/i")).collect()
    key = lambda r: (r[0] is None, r[0])
    assert [(r.page_id, r.record_type, r.refers_to) for r in sorted(got, key=key)] == [
        (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
        (7, "response", None), (8, "response", None), (9, "revisit", 8), (9, "revisit", 8), (None, "revisit", 1)]
    html = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == (html[r.page_id] if r.record_type == "response" else b"") for r in got)
    assert all(r.payload_bytes == len(html[r.page_id]) for r in got)
    asked = warc.entries(spark, f"{folder}/i", ["org,a,b:80)/y?q#f", "net,c)/", "none"]).collect()
    table = spark.createDataFrame([("org,a,b:80)/y?q#f",), ("net,c)/",), ("none",), (None,), ("net,c)/",)], "key string")
    assert sorted(warc.look_up(spark, f"{folder}/i", table).collect()) == sorted(asked)
    everything = pages.select(warc.url_keys(F.col("url")).alias("key"))
    assert sorted(warc.look_up(spark, f"{folder}/i", everything).collect()) == sorted(warc.entries(spark, f"{folder}/i").collect())
    assert sorted(r.key for r in asked) == ["net,c)/", "net,c)/", "org,a,b:80)/y?q#f"]
    empty = pages.limit(0)
    # The directory decides what is found: keys that it places elsewhere are lost.
    directory = spark.read.parquet(f"{folder}/i/directory")
    spark.read.parquet(f"{folder}/i/blocks").write.parquet(f"{folder}/broken/blocks")
    directory.withColumns({"first_key": F.lit("~"), "last_key": F.lit("~")}).write.parquet(f"{folder}/broken/directory")
    assert warc.look_up(spark, f"{folder}/broken", everything).count() == 0
    warc.write_archives(empty, f"{folder}/e")
    warc.build_index(spark, f"{folder}/e", f"{folder}/ei")
    assert warc.read_records(warc.entries(spark, f"{folder}/ei")).count() == 0


def test_language_tables_are_code_lengths():
    counts = np.zeros(language.CLASSES**4, np.int64)
    rng = np.random.default_rng(0)
    seen = rng.integers(0, language.CLASSES**4, 5000)
    np.add.at(counts, seen, 1)
    bits = np.empty(len(counts), np.float32)
    language.tabulate(counts, bits)
    bits = bits.reshape(-1, language.CLASSES)
    total = (2.0 ** -bits.astype(float)).sum(1)
    assert total.max() <= 1 + 1e-4  # no context promises more than it has


def test_language_on_held_out_rows(spark, nothing, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = language.identify(docs, docs.where(~held)).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    signs = spark.createDataFrame([(1, None), (2, ""), (3, "12 .,"), (4, "é"), (5, "x" * 300_000)], "doc_id long, text string")
    out = {r.doc_id: r.lang_pred for r in language.identify(signs, docs).collect()}
    assert [out[i] for i in (1, 2, 3)] == ["und"] * 3 and "und" not in (out[4], out[5])
    assert language.identify(nothing, docs).count() == 0
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.filter_language(odd).count() == 0 and language.filter_language(nothing).count() == 0


def test_quality_counts_and_verdicts(spark, docs, table, nothing, odd):
    labels = spark.createDataFrame([(d, d % 2, 0, "x") for d in table], "doc_id long, quality int, toxic int, n_words string")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for d, t in table.items():
        want = brute.rule_counts(t)
        assert tuple(got[d][c] for c in quality.COUNTS) == want
        assert got[d].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[d].base_failed and got[d].kept)
    none = labels.limit(0)
    assert all(r.kept != r.base_failed for r in quality.judge(docs, none).collect())
    assert quality.judge(nothing, labels).count() == 0 and quality.judge(odd, labels).count() == 6
    passed = quality.filter_quality(docs, none)
    assert passed.columns == docs.columns and passed.count() == sum(not r.base_failed for r in got.values())


def test_quality_finds_labelled_junk(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_rules_and_words(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "http://": ("", "", None), "HTTP://WWW.Example.COM/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/"),
        "http://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "http://a.net/es/?": ("a.net", "/es/", "net/es/"), "http://a.net/en": ("a.net", "/en", None), "http://a.com": ("a.com", "", None), "http://É.org?a://b/c": ("É.org", "", None),
    }
    rows = [(i, u, "the cheap pills and spam farm casino words words", "h") for i, u in enumerate(cases)] + [(99, "http://cheappills.org/en/1", None, "h"), (98, "http://words.org/", "", "h")]
    rows += [(100 + i, f"http://words.{('a.com', 'b.net/es')[i % 2]}/{i}.html", None, "h") for i in range(200)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), RULES).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    assert [got[i].verdict for i in (0, 1, 3, 4, 5, 6)] == ["allow", "allow", "allow", "block", "allow", "block"]
    assert "host:cheap" in got[99].tokens and "host:pills" in got[99].tokens and got[99].verdict == got[98].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_segmentation_is_the_likeliest():
    counts = {"the": 50, "there": 20, "in": 40, "rein": 1, "re": 30}
    segmenter = urls.Segmenter(counts)

    def all_splits(name):
        if not name:
            return [[]]
        return [[name[:i], *rest] for i in range(1, len(name) + 1) for rest in all_splits(name[i:])]

    def cost(words):
        return sum(segmenter.cost.get(w, segmenter.unknown * len(w)) for w in words)

    for name in ["therein", "there", "inthe", "thezin"]:
        assert cost(segmenter.split(name)) == pytest.approx(min(map(cost, all_splits(name))))


def test_crc_of_ids_matches_zlib(spark, docs):
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("ids", F.crc32("ids").alias("crc")).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.crc for r in rows)


#: Canonical notices, hard-wrapped as published; the names of rules and licences that they must give.
NOTICES = {
    "apache": ('''Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.''', ["apache-header"], ["Apache-2.0"]),
    "mit": ('''MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.''', ["mit-text"], ["MIT"]),
    "gpl": ('''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.''', ["gpl-header"], ["GPL"]),
    "lgpl": ('''This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.''', ["lgpl-header"], ["LGPL"]),
    "bsd": ('''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
''', ["bsd2-text"], ["BSD-2-Clause"]),
    "isc": ('''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.''', ["isc-text"], ["ISC"]),
    "mpl": ('''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.''', ["mpl-header"], ["MPL-2.0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain.", ["unlicense-text"], ["Unlicense"]),
}


#: More notices, hard-wrapped; the rule, the licence and its version.
VERSIONS = {
    "agpl": ('''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU Affero General Public License for more details.''', "agpl-header", "AGPL", "AGPL-3.0-or-later"),
    "gpl2": ('''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.''', "gpl-short-header", "GPL", "GPL-2.0-or-later"),
    "gpl2 alone": ('''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.''', "gpl2-only-short-header", "GPL", "GPL-2.0-only"),
    "boost": ('''Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)''', "boost-notice", "BSL-1.0", "BSL-1.0"),
    "zlib": ('''This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.''', "zlib-text", "Zlib", "Zlib"),
    "cc": ('''This work is licensed under a Creative Commons
Attribution-NonCommercial 4.0 International License.''', "cc-by-nc-notice", "CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    "apache": ('''                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION''', "apache-text", "Apache-2.0", "Apache-2.0"),
    "gpl3": ('''                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007
''', "gpl3-title", "GPL-3.0", "GPL-3.0"),
}
TAG_LINES = {
    "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0+ */": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: Unheard-Of-1.0": None, "the SPDX-License-Identifier: MIT is a line": None,
}


def test_licences_with_versions_and_tags(spark):
    rows, want = [], []
    for text, rule, name, version in VERSIONS.values():
        for form in (text, text.replace("\n", "\r\n"), "#!/bin/sh\n" + "\n".join(f" * {x}".rstrip() for x in text.split("\n"))):
            rows.append((len(rows), form))
            want.append(([rule], [name], [version]))
    for line, name in TAG_LINES.items():
        rows.append((len(rows), f"first line\n{line}\nint main() {{}}"))
        want.append(([f"tag-{name.lower()}"], [name], [name]) if name else ([], [], []))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].rules, got[i].licences, got[i].expressions) for i in range(len(want))] == want


def test_a_tree_of_words_is_the_alternation():
    import re

    known = {"a b c": 1, "a b": 2, "a d": 3, "e": 4, "e f g h": 5}
    tree = re.compile(licenses.wordings(known))
    for text in ("a b c", "a  b\nc", "a b", "a d", "e", "e f g h"):
        assert tree.fullmatch(text)
    for text in ("a", "a b d", "e f", "e f g", ""):
        assert not tree.fullmatch(text)
    assert tree.match("a b c d").group() == "a b c" and tree.match("e f g x").group() == "e"


def test_licences_of_canonical_notices(spark):
    """As published, on one line, with Windows line ends, and as a comment of a source file, after other text."""
    rows, want = [], []
    for text, rules, names in NOTICES.values():
        comment = "#!/bin/sh\n" + "\n".join(f" * {x}".rstrip() for x in text.split("\n"))
        for form in (text, " ".join(text.split()), text.replace("\n", "\r\n"), comment, f"Some words. More of them\n\n{text}\n\nAnd the end"):
            rows.append((len(rows), form))
            want.append((rules, names))
    rows += [(-1, "a line\nAll rights reserved\nanother line"), (-2, "We saw that all rights\nreserved seats were gone"), (-3, "one | two. All rights\nreserved.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].rules, got[i].licences) for i in range(len(want))] == want
    assert [got[i].rules for i in (-1, -2, -3)] == [["reserved"], [], ["reserved"]]
    assert [[s.position for s in got[i].sentences] for i in (-1, -3)] == [[1], [1]]


def test_packing_equals_a_fresh_tokenizer(spark):
    """Texts with the file's added token, also long ones, as the file itself tokenizes them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    assert 50256 in fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids
    end = "<|endoftext|>"
    table = dict(enumerate([f"a {end} b", end, end * 3, f"x{end}y  {end}\n z", "word " * 20_000 + end + " more" * 20_000, f"{'z' * 5000}{end}", "<|endoftext", f"é{end}ß", "plain"]))
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    got = {}
    for r in packing.pack(docs, path).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, text in table.items():
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted(got[d], key=lambda r: r.start)]).tolist()
        assert ids == fresh.encode(text, add_special_tokens=False).ids + [0]


def test_language_of_few_long_documents(spark):
    """Three documents of 5 MB are sampled like many short ones, and one long document does not break the bound."""
    words = {"aa": ["abra", "cadabra", "alakazam"], "bb": ["xyzzy", "plugh", "frotz"]}
    long = [(i, " ".join(words["aa"]) * 240_000, "aa") for i in range(3)]
    short = [(100 + i, " ".join(words["bb"]) * 10, "bb") for i in range(300)]
    docs = spark.createDataFrame([*long, *short], "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs)
    used = {k: int(n.sum()) for k, n in zip(model.languages, model.counts)}
    assert 700_000 < used["aa"] < 1_300_000 and used["bb"] == sum(len(t) for _, t, k in short)
    few = language.fit(docs, train_bytes=10)
    assert all(0 < n.sum() <= language.PART_CHARS for n in few.counts) and few.languages == ["aa", "bb"]


def _url_rows():
    """Rule-decided URLs of many words, each of a tiny share, and undecided siblings."""
    prose = "gardenia tulip orchid river mountain happy farm sunny bank the of words shop " * 3
    rows = [(i, f"http://words.{('a.com', 'b.net/es')[i % 2]}/{i}.html", prose) for i in range(400)]
    rows += [(1000 + i, f"http://tulipshop.net/fr/{i}/rarepath{chr(97 + i)}", None) for i in range(3)]
    rows += [(2000, "http://tuliporchid.org/x", None), (2001, "http://happyfarm.example.org/en/1", None), (2002, "http://gardenia.org/rarepathb", None)]
    return [*rows, (2003, "http://cheappills.org/", None), (2004, "http://gardenia.org/rarepathb", None), (None, "http://gardenia.org/rarepathb", None)]


def test_url_results_do_not_depend_on_the_limit_of_words(spark, monkeypatch):
    """What is rare counts by a join as it counts when everything fits the tasks' own table."""
    pages = spark.createDataFrame([*_url_rows(), (3000, "http://z.com/1", "unter " * 20_000)], "page_id long, url string, html string")
    out = []
    for most in (10, 100_000):
        monkeypatch.setattr(urls, "MOST_WORDS", most)
        out.append(sorted((-1 if r.page_id is None else r.page_id, r.host, r.path, r.verdict, tuple(r.tokens), r.score) for r in urls.judge(pages, RULES).collect()))
    assert out[0] == out[1] and len(out[0]) == len(_url_rows()) + 1
    by_id = {r[0]: r for r in out[0]}
    assert by_id[2000][4][:2] == ("host:tulip", "host:orchid") and by_id[2000][5] > 0
    assert by_id[2002][5] > 0 and by_id[2002][5] == by_id[2004][5] == by_id[-1][5]


SUSPECT = ["happyfarm.example.org", "farmloans.org", "poker-winner.org", "winner-farm.io", "loanfarm.co.uk", "cheaploans.org", "free-bets.io"]


@pytest.mark.parametrize("evidence", [False, True])
def test_hosts_are_blocked_with_evidence_only(spark, evidence):
    """No word blocks by itself; words that blocked URLs hold and allowed ones do not are enough. Scores equal plain naive Bayes."""
    prose = "poker winner farm loan loans cheap free bets happy " * 3
    rows = [*_url_rows(), *((4000 + i, f"http://{h}/", prose) for i, h in enumerate(SUSPECT))]
    rows += [(5000 + i, f"http://{w}.net/es/{i}", prose) for i in range(40 * evidence) for w in ("farmloans", "poker-winner", "cheapfarm")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    verdicts = {r.host: r.verdict for r in got if r.page_id is not None and 4000 <= r.page_id < 5000}
    assert verdicts == {h: "block" if evidence and h in SUSPECT[1:4] + SUSPECT[5:6] else "allow" for h in SUSPECT} or evidence and verdicts["free-bets.io"] == "allow" and verdicts["farmloans.org"] == verdicts["poker-winner.org"] == "block"
    named = {t for r in RULES for t in [*(x for x in ("host:com", "host:net", "host:example", "host:www") if x[5:] in r[1]), *(f"path:{x}" for x in r[1].split("/")[1:] if x)]}
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    for r in got:
        if r.rule:
            counts[r.verdict].update(t for t in r.tokens if t not in named)
    kinds = len(set(counts["allow"]) | set(counts["block"]))
    a, b = (sum(counts[k].values()) for k in ("allow", "block"))
    low = min(a, b)

    def weight(t):
        if t in named or not (counts["allow"][t] or counts["block"][t]):
            return 0.0
        return math.log((counts["block"][t] + b / low) / (b + kinds * b / low)) - math.log((counts["allow"][t] + a / low) / (a + kinds * a / low))

    for r in got:
        assert math.isclose(r.score, sum(map(weight, r.tokens)), abs_tol=1e-9)


def test_long_hosts_and_repeated_urls(spark):
    """Names that are too long to be host names are words as they are; unknown letters are one word a run."""
    rows = [(1, "http://" + "ab" * 150_000 + ".com/x", "ab cd"), (2, f"http://{'q' * 80}.org/", "ab"), (3, "http://xyzzyab.org/", "ab ab"), (3, "http://xyzzyab.org/", "ab ab"), (4, "http://a.b/" + "p" * 100_000, None)]
    got = [(r.page_id, r.tokens) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()]
    assert sorted(len(t) for i, t in got if i in (1, 2)) == [2, 3]
    assert [t for i, t in got if i == 3] == [["host:xyzzy", "host:ab", "host:org"]] * 2 and len(got) == 5
