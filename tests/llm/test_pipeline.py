"""The pipeline's stages, each against plain Python on what its predecessor kept."""

import collections
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airtrace.llm import kernels, language, quality
from airtrace.session import materialize

from . import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_what_plain_python_keeps(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns

    def step(name, df):
        out = materialize(stages[name](spark, df, SF), name)
        assert name == "packing" or out.columns == names
        return out

    judged = rows(quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    good = step("quality_rules", docs)
    assert set(rows(good)) == {d for d, r in judged.items() if r.kept}
    spoken = step("language_id", good)
    model = language.fit(good, spread=language.SPREAD)
    gains = {r.doc_id: r.p for r in good.select("doc_id", language.saved(F.col("text"), model).alias("p")).collect()}
    assert set(language.limits(good, model).items()) <= {(x, 0.0) for x in model.languages}
    assert set(rows(spoken)) == {d for d, p in gains.items() if p.lang_pred != "und" and p.saved > 0}
    before = {d: r.text for d, r in rows(spoken).items()}
    lines = step("line_dedup", spoken)
    texts = {d: r.text for d, r in rows(lines).items()}
    assert texts == {d: x[2] for d, x in brute.kept_lines(before).items()}
    assert all(r.n_chars == len(r.text) for r in rows(lines).values())
    single = step("near_duplicates", lines)
    classes = brute.classes(texts, 5, 8, 10)
    assert set(rows(single)) == set(classes.values())
    pieces = step("packing", single).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in rows(single).items()}
    assert {d: sum(p.length for p in pieces if p.doc_id == d) for d in want} == want
    assert {p.doc_id for p in pieces} == set(want)


def test_limits_are_learned_from_all_labelled_rows(spark):
    """More labelled rows than any sample: the middle one decides, which a few rows more on one side move."""
    class Known:
        languages = ["xx"]

        def saved(self, piece):
            sizes = np.diff(piece.offsets)
            return (sizes - 20.0)[:, None] * sizes[:, None], sizes

    rows = spark.range(20_001).select(F.lit("xx").alias("lang"), F.expr("repeat('a', cast(1 + id % 3 as int))").alias("text"))
    # Savings are -19, -18 and -17 by turns: quartile -19, median -18.
    assert language.limits(rows, Known()) == {"xx": -18.0 - language.SPREADS}
    few = rows.unionByName(spark.range(3).select(F.lit("yy").alias("lang"), F.lit("b").alias("text")))
    assert set(language.limits(few, Known())) == {"xx"}


def test_stages_bear_odd_tables(spark):
    long = " ".join(f"word{i}" for i in range(40))
    odd = [(None, long, None), (None, None, None), (1, long, "en"), (1, long, "en"), (2, "", "en"), (3, long + " more", None), (4, "x " * 40_000, "en")]
    schema = "doc_id long, text string, lang string, row string, c int, `_id` string, word string, n string"
    docs = spark.createDataFrame([(*r, "r", 1, "i", "w", "n") for r in odd], schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where(F.lit(False))):
            out = stage(spark, df, SF)
            found = out.collect()
            assert name == "packing" or out.columns == df.columns
            assert df is docs or not found
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert [r.doc_id for r in near].count(None) == 2 and {r.doc_id for r in near} == {None, 1, 2, 4}


PROSE = [
    "The children walked to school along the river while their parents talked about the weather.",
    "We went to the market early in the morning to buy fresh bread, cheese and a bottle of wine for dinner.",
    "Les enfants jouent dans le jardin pendant que leur mère prépare le repas du soir.",
    "Der alte Mann ging langsam durch den Wald und dachte an seine Jugend.",
    "Los niños corren por el parque mientras sus padres hablan de la vida.",
    "This notice is short.", "All rights reserved.",
]


@pytest.mark.parametrize("labels", [(), ("en", "fr", "de", "es"), ("en",) * 5])
def test_language_stage_keeps_unlabelled_prose_and_drops_noise(spark, labels):
    """Whether or not some noise carries a language label."""
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 4 = 0")
    mess = lambda signs: " ".join("".join(rng.choice(signs) for _ in range(rng.randint(2, 9))) for _ in range(400))
    signs = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "0123456789abcdef", "qxzvkj%#7"]
    noise = [mess(s) for s in signs]
    planted = [(10**9 + i, t, None) for i, t in enumerate([*PROSE, *noise])]
    planted += [(2 * 10**9 + i, mess(signs[i % 4]), lang) for i, lang in enumerate(labels)]
    found = corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(planted, "doc_id long, text string, lang string")), SF)
    kept = {r.doc_id for r in found.select("doc_id").collect()}
    assert {d for d in kept if d >= 10**9} == {10**9 + i for i in range(len(PROSE))}, {d: text for d, text, _ in planted if (d in kept) != (d < 10**9 + len(PROSE))}
    given = {r.doc_id for r in docs.select("doc_id").where("text rlike '[A-Za-z]'").collect()}
    assert len(given - kept) <= 0.002 * len(given)


def code_lengths(text, training):
    """Bits of every byte of ``text`` by plain prediction with partial matching, orders 3 to 0, escapes by method C."""
    fold = lambda t: [int(language.FOLD[b]) for b in t.encode()]
    seen = collections.defaultdict(collections.Counter)
    for t in training:
        classes = [1, 1, 1, *fold(t)]
        for i in range(3, len(classes)):
            for k in range(4):
                seen[tuple(classes[i - k : i])][classes[i]] += 1
    classes, out = [1, 1, 1, *fold(text)], []
    for i in range(3, len(classes)):
        bits = 0.0
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                bits += math.log2(language.CLASSES)
                break
            counts = seen[tuple(classes[i - k : i])]
            total = sum(counts.values()) + len(counts)
            if counts[classes[i]]:
                bits += math.log2(total / counts[classes[i]])
                break
            if counts:
                bits += math.log2(total / len(counts))
            # A Counter keeps no zero counts that it was only asked for.
        out.append(bits)
    return out


def test_code_lengths_equal_plain_partial_matching(spark):
    training = {"a": ["abracadabra", "Ça va, là-bas 12", ""], "b": ["banana bandana", "x" * 40]}
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate((g, t) for g, ts in training.items() for t in ts)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    texts = ["abra", "bandana", "Ça 3", "zq", "x", "日本", "abracadabra banana"]
    want = {t: [sum(code_lengths(t, training[g])) for g in ("a", "b")] for t in texts}
    gain = {t: [sum(math.log2(0.5 + 0.5 * language.CLASSES / 2**b) for b, c in zip(code_lengths(t, training[g]), t.encode()) if language.FOLD[c] >= 3) for g in ("a", "b")] for t in texts}
    for p in kernels.pieces(pa.array(texts)):
        np.testing.assert_allclose(model.score(p), [want[t] for t in texts[p.first : p.first + len(p)]], rtol=1e-4)
        np.testing.assert_allclose(model.saved(p)[0], [gain[t] for t in texts[p.first : p.first + len(p)]], rtol=1e-3, atol=1e-3)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].lang_pred == "ab"[int(want[t][1] < want[t][0])] and math.isclose(got[i].score, 1 / (1 + 2 ** -abs(want[t][0] - want[t][1])), rel_tol=1e-3)


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ")


def test_stages_measure_a_text_once_a_pass(spark):
    """A second evaluation in a stage starts a second worker a task, each with its own tables."""
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        languages = ["xx"]

        def saved(self, piece):
            calls.add(len(piece))
            sizes = np.diff(piece.offsets)
            return (sizes - 20.0)[:, None] * sizes[:, None], sizes

    rows = spark.range(300).select(F.lit("xx").alias("lang"), F.expr("if(id % 5 = 0, '1', repeat('a', cast(1 + id % 3 as int)))").alias("text"))
    assert set(language.limits(rows, Counting())) == {"xx"} and calls.value == 300
    signs = spark.range(300).select(F.lit("yy").alias("lang"), F.lit("12").alias("text"))
    assert language.limits(signs, Counting()) == {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert python_steps(corpus_pipeline.quality_rules(spark, docs, SF)) == 1
    assert python_steps(corpus_pipeline.language_id(spark, docs, SF)) == 1


def test_language_tables_hold_one_dense_count_beside_them():
    codes = np.arange(0, language.CLASSES**4, 7)
    model = language.Model(["a", "b"], [codes, codes + 1], [np.ones(len(codes), np.int64)] * 2)
    tracemalloc.start()
    table = model.tables()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dense = np.zeros(language.CLASSES**4, np.int32).nbytes
    assert peak < table.nbytes + 1.5 * dense
