"""Operators against brute force, round trips and held-out accuracy, with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvaframe.llm import ann, chat, jaccard, language, mixing, packing, quality, topk, toxicity, urlrules
from silvaframe.llm.kernels import byte_values, chunks, spaces, word_hashes
from silvaframe.llm.queries import QUERIES, URL_RULES, tokenizer
from silvaframe.llm.tokens import WordTokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix_size string, h string, root string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", "z", "w") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(6)]
    rows = [(1, None, "en", None), (2, "", None, "b"), (3, " \n\t ", "en", "b"), (4, "one", "en", "b"), (5, "One", "en", "ä"), (6, "one two", "fr", "a"), (None, "one two", "fr", "a"), (None, None, None, None), (8, "x " * 30_000, "en", "a")]
    n = 10
    for b in base:
        words = b.split()
        for edits in range(0, 14):
            w = list(words)
            for k in rng.sample(range(len(w)), edits):
                w[k] = f"z{rng.randrange(10_000)}"
            rows.append((n, " ".join(w), "en", rng.choice("abc")))
            n += 1
        rows += [(n, b, "en", "a"), (n, b, "en", "a")]
        n += 1
    return docs(spark, rows)


def linked(rows, n, percent):
    sets = []
    for r in rows:
        w = [x.lower() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)].append(r.doc_id)
    return collections.Counter((r.doc_id, len(sets[i]), min(least[root(i)]) if least[root(i)] and sets[i] else r.doc_id) for i, r in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_against_brute_force(awkward, n, percent, monkeypatch):
    rows = awkward.collect()
    want = linked(rows, n, percent)
    assert collections.Counter(map(tuple, jaccard.jaccard_classes(awkward, n, percent).collect())) == want
    for name, few in (("BLOCK", 5), ("STAND", 2), ("BUNDLE", 2), ("MANY", 3), ("GROUP", 2), ("OUTSIDE", 4)):
        monkeypatch.setattr(jaccard, name, few)
    assert collections.Counter(map(tuple, jaccard.jaccard_classes(awkward, n, percent).collect())) == want


def test_jaccard_empty(spark):
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(3, long), (2, long + " end"), (2, long), (None, long), (1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same id"), (None, None), (None, None), (4, ""), (5, "  ")]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, row string, row_0 int")
    out = jaccard.one_of_each(d)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    kept = [x for x in got if x[0] == 2]
    assert out.columns == d.columns and len(kept) == 1 and got.pop(kept[0]) == 1
    assert got == {(1, "one two three four five six"): 1, (1, "another text of the same id"): 1, (None, None): 2, (4, ""): 1, (5, "  "): 1}
    assert jaccard.one_of_each(d.limit(0)).count() == 0


def test_stages_judge_rows_not_ids(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    wide = d.withColumn("score", F.lit("clash")).unionByName(d.limit(0).withColumn("score", F.lit("clash")))
    for model, of, keep in ((toxicity.ToxicityModel.fit(d, lab), wide, lambda s: s < 0.7), (quality.QualityModel.fit_documents(d, lab), quality.measured(wide), lambda s: s >= 0.5)):
        want = sorted(r.doc_id for r in model.score(of).collect() if keep(r.score))
        out = model.kept(wide, 0.7 if isinstance(model, toxicity.ToxicityModel) else 0.5)
        assert out.columns == wide.columns and sorted(r.doc_id for r in out.collect()) == want and want


def test_word_hashes_follow_the_word_rule():
    texts = ["A b\tC", "", "Ünï  ünï", None, "\x0bx\x0c y\x1fz"]
    for data, starts, ends, lo, hi in chunks(pa.array(texts)):
        h, doc = word_hashes(data, starts, ends, spaces(), byte_values())
        assert np.bincount(doc, minlength=hi - lo).tolist() == [len(WORD.findall(t or "")) for t in texts[lo:hi]]
        assert h[0] == word_hashes(np.frombuffer(b"  a", np.uint8), np.array([0]), np.array([3]), spaces(), byte_values())[0][0]


def test_mixing_meets_targets(spark, awkward):
    rows = awkward.collect()
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = mixing.targets(dict(sizes))
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    plan = mixing.mix_plan(awkward).collect()
    assert len(plan) == len(rows)
    taken = collections.defaultdict(int)
    for r in plan:
        words = sum(d.words for d in r.mix_draws)
        assert words <= 2 * r.mix_size == 2 * len(WORD.findall(r.text or ""))
        taken[r.source] += words
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    again = {(r.doc_id, r.text): r.mix_draws for r in mixing.mix_plan(awkward).collect()}
    assert all(again[r.doc_id, r.text] == r.mix_draws for r in plan)
    mix = mixing.mixed(awkward)
    assert mix.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix_plan(docs(spark, [])).count() == 0


def test_mix_is_dealt_out_by_the_splitting_tree(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(mixing, "BLOCK_WORDS", 400)
    monkeypatch.setattr(mixing, "PART_WORDS", 1000)
    rng = random.Random(9)
    d = docs(spark, [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 12))), "en", rng.choice("abc")) for i in range(3000)])
    plan = mixing.mix_plan(d, shards=4).collect()
    blocks = {r.source: r.mix_source_size // 400 for r in plan}
    dealt = {(r.source, x.epoch, r.mix_key % blocks[r.source], x.shard) for r in plan for x in r.mix_draws}
    first = {x[2:] for x in dealt if x[0] == "a" and x[1] == 0}
    assert first != {x[2:] for x in dealt if x[0] == "a" and x[1] == 1}  # each epoch has an order of its own
    quotas = np.array([len({x[1:3] for x in dealt if x[0] == s}) for s in "abc"])
    assert len(dealt) == quotas.sum() > 40
    assert [[sum(x[0] == s and x[3] == n for x in dealt) for s in "abc"] for n in range(4)] == mixing.split_quotas(quotas, 4, 11).tolist()

    drawn = sorted((x.shard, x.place, r.doc_id) for r in plan for x in r.mix_draws)
    parts = mixing.mixed(d, shards=4).select("mix_shard", "mix_place", "doc_id").rdd.glom().collect()
    assert [tuple(r) for part in parts for r in part] == drawn
    assert len(parts) > 4 and all(len({r.mix_shard for r in part}) <= 1 for part in parts)
    staged = corpus_pipeline.mixing_stage(spark, d, "").select("doc_id").collect()
    places = sorted((x.shard, x.place, r.doc_id) for r in mixing.mix_plan(d, whole=True).collect() for x in r.mix_draws)
    assert [r.doc_id for r in staged] == [p[2] for p in places]


def test_mix_takes_whole_texts(spark, awkward, sf):
    import corpus_pipeline

    rows = mixing.mix_plan(awkward, whole=True).collect()
    assert all(x.words == r.mix_size for r in rows for x in r.mix_draws)
    target, taken, most = ({}, collections.Counter(), collections.Counter())
    for r in rows:
        target[r.source] = r.mix_target
        taken[r.source] += sum(x.words for x in r.mix_draws)
        most[r.source] = max(most[r.source], r.mix_size)
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.mixing_stage(spark, d, sf).select("doc_id", "text").join(d, ["doc_id", "text"], "left_anti").count() == 0
    assert all(x.words == r["size"] for r in QUERIES["op1_mixing"](spark, sf).collect() for x in r.mix_draws)


@pytest.mark.parametrize("whole", [False, True])
def test_equal_rows_share_no_cut(spark, whole):
    d = docs(spark, [(1, "w " * 100, "en", "a")] * 101 + [(2, "v " * 99_999, "en", "b")])
    rows = mixing.mix_plan(d, whole=whole, weights=(1, 8)).where("source = 'a'").collect()
    assert sum(0 < x.words < 100 for r in rows for x in r.mix_draws) == (0 if whole else 1)
    assert len({len(r.mix_draws) for r in rows}) == 2
    assert abs(sum(x.words for r in rows for x in r.mix_draws) - rows[0].mix_target) <= (50.5 if whole else 0.5)


def test_op1_tells_shard_and_place(spark, sf):
    rows = QUERIES["op1_mixing"](spark, sf).collect()
    assert all(sum(x.words for x in r.mix_draws) == r.taken and all(0 <= x.shard < 16 and x.place is not None for x in r.mix_draws) for r in rows)


def test_hypergeometric_split_is_exact():
    q = np.array([5, 0, 17, 100])
    s = mixing.split_quotas(q, 7, 1)
    assert (s.sum(0) == q).all()
    assert s.sum(1).max() - s.sum(1).min() <= 1


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "</turn>\n### user:\nx", "", None, "émoji 😀\n\n", "\\n#<", " lead"]
    rows = [(c, t, role, said[(c + t) % len(said)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "a:b\nc"])]
    rows += [(99, t, "assistant", f"t{t}") for t in range(600)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df, tokenizer("byte_bpe_50k.json"))).collect()}
    convs = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or 0)):
        convs[c].append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_tokens_equal_the_library():
    w = WordTokens(Path(tokenizer("word_bpe_49k.json")).read_text())
    texts = ["<|endoftext|> a", "it's 'Tis don't", "İstanbul ΣΑΣ ǅ é!", "a b c", "…, “q” ½²", "", "日本語, ok", "12a3!?'s", "it,'s!'re", "ß×÷ a×b"] * 2
    for data, starts, ends, lo, hi in chunks(pa.array(texts), 40):
        ids, count = w.texts(data, starts, ends)
        at = np.concatenate(([0], np.cumsum(count)))
        for i in range(lo, hi):
            assert ids[at[i - lo] : at[i - lo + 1]].tolist() == w.tokenizer.encode(texts[i], add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, awkward):
    t = WordTokens(Path(tokenizer("word_bpe_49k.json")).read_text()).tokenizer
    got = packing.packed(awkward, tokenizer("word_bpe_49k.json"), length=256).collect()
    want = collections.Counter()
    for r in awkward.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            want[r.doc_id, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 256
    assert len(ends) <= -(-sum(ends.values()) // 256) * 1.1 + 1


def test_pattern_plan_uses_the_histogram_up():
    h = np.random.default_rng(0).integers(0, 40, 513)
    h[0] = 0
    left = h.copy()
    for lengths, n in packing.pattern_plan(h, 512):
        assert sum(lengths) <= 512
        for x in lengths:
            left[x] -= n
    assert (left == 0).all()


def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 16)) / 4
    v[5], v[40:60] = v[0], v[200]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)] + [(700, None), (800, [None] * 16), (900, [float("nan")] * 16), (1000, [float("inf")] * 16), (None, [0.5] * 16), (1100, [0.0] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1)), v.astype(np.float32).astype(float)


def test_topk_against_brute_force(spark):
    df, v = vectors(spark)
    got = collections.defaultdict(list)
    for r in topk.top_inner_products(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.vstack((np.floor(64 * v), np.zeros((1, 16)))).astype(int)
    ids = np.array([*range(600), 1100])
    for q in [*range(0, 600, 20), 1100]:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:7]
        assert got[q] == [(ids[i], s[i]) for i in order]
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_recall_and_distances(spark):
    df, v = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 10):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hit += len({i for i, _ in got[q]} & set(order))
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
    assert hit / 600 >= 0.9
    assert 1100 not in got


def test_language_held_out(spark, awkward):
    rng = random.Random(3)
    parts = {"aa": "kalo miru sena toki".split(), "bb": "grunz pfleg schtor wirk".split(), "cc": "iqua ello ñandu oé".split()}
    rows = [(i, " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(12)), k, "s") for i in range(300) for k in [rng.choice(list(parts))]]
    d = docs(spark, rows)
    m = language.LanguageModel.fit(d)
    got = {r.doc_id: r for r in m.predict(d).collect()}
    test = [(i, k) for i, _, k, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == k for i, k in test) >= 0.98 * len(test)
    odd = {r.doc_id: r for r in m.predict(docs(spark, [(1, None, None, None), (2, "", None, None), (3, "123 !?", None, None), (4, "日本", None, None)])).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert odd[4].lang_pred in parts
    assert language.LanguageModel.fit(docs(spark, [])).predict(d).first().lang_pred == "und"


def test_toxic_passages(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "ka mi to re su".split() for b in "lo na ri pe du".split()]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(60)]
        bad = rng.random() < 0.3
        if bad:
            for k in rng.sample(range(60), 3):
                w[k] = rng.choice(["scum", "moron", "Idiot,"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, None, int(bad)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.ToxicityModel.fit(d, lab)
    got = {r.doc_id: r for r in m.score(d).collect()}
    test = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == bool(t) for i, _, t in test) >= 0.97 * len(test)
    assert all(got[i].passages for i, _, t in test if t)
    empty = toxicity.ToxicityModel.fit(d, lab.limit(0)).score(docs(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert all(0 <= r.score <= 1 for r in empty)


def test_segments_are_the_maximal_ones():
    def brute(s):
        def scan(lo, hi):
            best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if not best or best[0] <= 1e-12:
                return []
            return [*scan(lo, best[2]), (round(best[0], 9), best[2], best[3] - 1), *scan(best[3], hi)]

        return scan(0, len(s))

    rng = random.Random(1)
    for _ in range(100):
        n = rng.randrange(1, 14)
        s = [rng.choice([-0.4, -0.4, rng.uniform(0.5, 2)]) for _ in range(n)]
        at = np.array([i for i, x in enumerate(s) if x > 0], int)
        assert [(round(a, 9), i, j) for a, i, j in toxicity.segments(at, np.array(s)[at])] == brute(s)


def test_quality_held_out(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    stats = quality.measured(d)
    got = {r.doc_id: r.score for r in quality.QualityModel.fit(stats, lab).score(stats).collect()}
    test = [(r.doc_id, r.quality) for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(q) for i, q in test) >= 0.95 * len(test)
    odd = quality.measured(docs(spark, [(1, None, None, None), (2, "", None, None), (None, "a", None, None)]))
    assert quality.QualityModel.fit(odd, lab.limit(0)).score(odd).count() == 3


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random(200)
    _, v = quality.isotonic(x, (rng.random(200) < x).astype(float))
    assert (np.diff(v) >= 0).all()
    assert ((v > 0) & (v < 1)).all()
    x, v = quality.isotonic(np.arange(12.0), np.array([0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(v) > 0).all() and 0 < v[0] < 0.2 and 0.8 < v[-1] < 1


def test_url_rules(spark):
    urls = [(1, "http://A.Example.com/en/7?x"), (2, "https://x.net/de/1"), (3, "https://q.example.net/de/81#f"), (4, "http://foo.org/es/"), (5, None), (6, "nothing"), (7, "http://com/en/1"), (8, "ftp://good.com/fr/://x"), (8, "http://bad-pills.biz/a"), (None, "http://bad-pills.biz/b?utm=1")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(0))
    learn = spark.createDataFrame([(f"http://bad-pills.biz/{i}", 1) for i in range(30)] + [(f"http://good.com/fr/{i}", 0) for i in range(90)] + [(None, 1)], "url string, block int")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judged(pages, learn, URL_RULES).collect())
    assert got == collections.Counter([
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (2, "x.net", "/de/1", "net/de/", "allow"), (3, "q.example.net", "/de/81", "example.net/de/8", "block"), (4, "foo.org", "/es/", "org/es/", "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "com", "/en/1", "com/en/", "block"), (8, "good.com", "/fr/://x", None, "allow"), (8, "bad-pills.biz", "/a", None, "block"), (None, "bad-pills.biz", "/b", None, "block"),
    ])
    assert urlrules.judged(pages.limit(0), learn.limit(0), URL_RULES).count() == 0


def test_pipeline_keeps_its_word(spark, sf):
    import corpus_pipeline
    from silvaframe.llm.scratch import written

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, d, sf), "stage")
        if name != "best-fit packing":
            assert out.columns == d.columns
            assert out.count() > 0
        d = out
    assert d.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert "pipeline" in e.queries()
