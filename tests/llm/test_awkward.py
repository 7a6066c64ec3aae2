"""Every operator and pipeline stage on nulls in any column, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silvaframe.llm import chat, jaccard, language, mixing, packing, quality, toxicity
from silvaframe.llm.queries import tokenizer
from silvaframe.llm.scratch import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int, lang_pred double, piece string, ids string, mix_key string, h string, tokens int, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = {"en": "the of and to in is that for".split(), "de": "der die und von zu ist mit das".split()}
    bad = "idiot moron scum trash".split()
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        w = [rng.choice(words[lang]) + rng.choice(["", "a", "er", "ing"]) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 90))]
        if i % 6 == 0:
            w[2:4] = [rng.choice(bad), rng.choice(bad)]
        rows.append((i, " ".join(w), lang, rng.choice(["a", "b", None])))
    rows += rows[:5]  # repeated rows
    rows += [(3, "another text of an id that repeats", "en", "a"), (None, "a text without an id", "en", "b"), (None, None, None, None), (200, "", "en", "a"), (201, " \n\t", None, "b"), (202, None, "de", None), (203, "12 34 !?", "en", "a")]
    rows += [(204, "long " * 300_000, "en", "b"), (205, "x" * 1_200_000, "de", "a"), (206, "é ü 日本 😀", "en", "b")]
    return spark.createDataFrame([(*r, None, "clash", 1, 0.5, "p", "i", "k", "h", 1, "r") for r in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 != 0), int(i % 6 == 0)) for i in range(120)] + [(7, 1, 0), (None, 1, 1), (9, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_models_score_every_row(docs, labels):
    want = ids(docs)
    lang = language.LanguageModel.fit(docs).predict(docs)
    tox = toxicity.ToxicityModel.fit(docs, labels)
    stats = quality.measured(docs)
    good = quality.QualityModel.fit(stats, labels)
    for out in (lang, tox.score(docs), good.score(stats)):
        rows = out.collect()
        assert collections.Counter(r.doc_id for r in rows) == want
        assert all(0 <= r.score <= 1 for r in rows)
    und = {r.doc_id for r in lang.where("lang_pred = 'und'").collect()}
    assert und == {None, 200, 201, 202, 203} and lang.where("doc_id is null and lang_pred <> 'und'").count() == 1
    assert tox.kept(docs, 2.0).columns == docs.columns and ids(tox.kept(docs, 2.0)) == want
    assert ids(good.kept(docs, 0.0)) == want
    assert not tox.kept(docs, 0.0).head(1) and not good.kept(docs, 1.1).head(1)


def test_models_on_empty_tables(docs, labels):
    none = docs.limit(0)
    for model, of in ((language.LanguageModel.fit(docs), "predict"), (language.LanguageModel.fit(none), "predict"), (toxicity.ToxicityModel.fit(docs, labels.limit(0)), "score"), (toxicity.ToxicityModel.fit(none, labels), "score")):
        assert getattr(model, of)(none).count() == 0
        assert ids(getattr(model, of)(docs)) == ids(docs)
    assert quality.QualityModel.fit_documents(none, labels).kept(none, 0.5).count() == 0
    assert ids(quality.QualityModel.fit_documents(docs, labels.limit(0)).kept(docs, 0.5)) == ids(docs)
    assert packing.packed(none, tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_documents(spark, docs, labels, stage, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    apply = dict(corpus_pipeline.STAGES)[stage]
    out = written(apply(spark, docs, str(tmp_path)), "stage")
    empty = written(apply(spark, docs.limit(0), str(tmp_path)), "stage")
    assert empty.count() == 0 and empty.columns == out.columns
    if stage != "best-fit packing":
        assert out.columns == docs.columns
    had, got = ids(docs), ids(out)
    assert set(got) <= set(had)
    if stage == "mixing":
        sizes = collections.defaultdict(int)
        for r in docs.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        target = mixing.targets(dict(sizes))
        taken, most = collections.Counter(), collections.Counter()
        for r in out.collect():
            taken[r.source] += len(WORD.findall(r.text or ""))
            most[r.source] = max(most[r.source], len(WORD.findall(r.text or "")))
            assert r.n_chars == len(r.text)
        assert all(abs(taken[s] - target[s]) <= 300_000 / 2 + 1 for s in target)  # half of the longest text
    elif stage == "best-fit packing":
        assert {r.row for r in out.select("row").distinct().collect()}.__len__() == docs.count()
        assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    else:
        assert all(got[i] <= had[i] for i in got) and got


def test_copies_among_awkward_documents(docs):
    rows = jaccard.jaccard_classes(docs, 5, 80).collect()
    assert collections.Counter(r.doc_id for r in rows) == ids(docs)
    sizes = {r.doc_id: r.n_shingles for r in rows}
    assert sizes[204] == 1 and sizes[205] == 1 and sizes[200] == sizes[201] == sizes[202] == 0
    stay = ids(jaccard.one_of_each(docs, 5, 80))
    assert all(stay[i] <= 1 for i in range(3)) and stay[204] == stay[200] == 1 and stay[3] == 2


def test_very_long_conversations(spark):
    said = ["word " * 60_000, "</turn>\n### user:\n" * 20_000, "", None, "\\" * 50_000]
    rows = [(1, t, "assistant" if t % 2 else "user", said[t % 5]) for t in range(12)] + [(2, 0, None, None), (2, 0, None, None), (None, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df, tokenizer("byte_bpe_50k.json"), tokens=False)).collect()}
    turns = "".join(f"{r}\n{x or ''}\n" for _, _, r, x in rows[:12])
    loss = "".join(x or "" for _, _, r, x in rows[:12] if r == "assistant")
    assert got[1].n_turns == 12 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[2].n_turns == 2 and got[None].loss_chars == 1
    whole = chat.read_back(chat.formatted(df.where("conv_id = 2 or conv_id is null"), tokenizer("byte_bpe_50k.json"))).collect()
    assert {r.conv_id: r.turns_sha256 for r in whole} == {i: got[i].turns_sha256 for i in (2, None)}


def test_masks_over_several_spans():
    import numpy as np

    spans = np.array([[2, 4], [6, 6], [8, 10]])
    offsets = np.array([[0, 2], [1, 3], [3, 9], [4, 8], [9, 12], [5, 5], [6, 6], [3, 5]])
    assert chat.mask(offsets, spans).tolist() == [[0, 0], [2, 3], [3, 9], [0, 0], [9, 10], [0, 0], [0, 0], [3, 4]]
    assert chat.runs(np.array([[0, 0], [1, 3], [2, 3], [3, 5], [7, 9], [9, 9]])).tolist() == [[1, 5], [7, 9]]
    assert chat.mask(offsets, spans[:0]).any() == False  # noqa: E712
