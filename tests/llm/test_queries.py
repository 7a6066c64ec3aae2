"""Every registered query over whole tables, against its contract: brute force, an SQL twin, or held-out accuracy."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaframe.llm import ann, jaccard, mixing, sample, urlrules
from silvaframe.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF01 = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, tables, name):
    from parity import normal

    assert normal(QUERIES[name](spark, sf).toPandas()) == normal(tables.sql(ORACLE_SQL[name]).df())


def test_op1_contract(spark, sf, tables):
    rows = QUERIES["op1_mixing"](spark, sf).collect()
    docs = {i: (t, s) for i, t, s in tables.sql("SELECT doc_id, text, source FROM documents").fetchall()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in rows:
        text, source = docs[r.doc_id]
        assert r["size"] == len(WORD.findall(text or "")) and r.taken <= 2 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
        largest[source] = max(largest[source], r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            want |= {s: unit * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(want[s] for s in full)
        open_ -= full
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in order)
    assert sorted(map(repr, rows)) == sorted(map(repr, QUERIES["op1_mixing"](spark, sf).collect()))


def test_op2_has_the_extra_conversation(spark, sf):
    said = r"\### Assistant: </turn> ok"
    r = QUERIES["op2_chat_formatting"](spark, sf).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op3_op8_op9_on_documents_held_out(spark, tables):
    con = duckdb.connect()
    docs = {i: lang for i, lang in con.sql(f"SELECT doc_id, lang FROM read_parquet('{SF01}/documents.parquet')").fetchall()}
    labels = con.sql(f"SELECT doc_id, quality, toxic FROM read_parquet('{SF01}/labels.parquet')").fetchall()
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF01).collect()}
    assert set(got) == set(docs) and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    test = [i for i in docs if held(i) and docs[i] is not None]
    assert sum(got[i].lang_pred == docs[i] for i in test) >= 0.95 * len(test)
    for name, at, cut in (("op8_toxicity", 2, 0.7), ("op9_quality_classifier", 1, 0.5)):
        got = {r.doc_id: r for r in QUERIES[name](spark, SF01).collect()}
        assert set(got) == set(docs)
        assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for i, r in got.items())
        test = [x for x in labels if held(x[0]) and x[at] is not None]
        assert sum(got[x[0]].predicted == x[at] for x in test) >= 0.95 * len(test)


def test_op4_packs_every_document(spark, sf, tables):
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for (i,) in tables.sql("SELECT doc_id FROM documents").fetchall()}
    ends = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id] and r.start == 2048 * r.piece
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len({(r.row, r.piece) for r in rows}) == len(rows)
    assert len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_op7_given_rules(spark, sf, tables):
    got = {r.page_id: r for r in QUERIES["op7_url_filters"](spark, sf).collect()}
    pages = tables.sql("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, url in pages:
        _, mark, rest = (url or "").partition("://")
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if mark and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path) and got[i].rule == (max(fits)[1] if fits else None)
        assert got[i].verdict == max(fits)[2] if fits else got[i].verdict in ("allow", "block")


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        host, word = rng.choice(["spam", "news", "shop"]), rng.choice(["win", "read", "buy"])
        bad = (host == "shop" and word == "win") or host == "spam" or rng.random() < 0.1
        rows.append((f"http://{host}.org/{word}/{i}", int(bad)))
    learn = spark.createDataFrame(rows, "url string, block int")
    got = {tuple(r.tokens): (r.confidence, r.support) for r in urlrules.mined_rules(learn).collect()}
    sets = {u: tuple(t) for u, t in learn.select("url", urlrules.tokens_of(F.col("url"))).distinct().collect()}
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    from itertools import combinations

    count = collections.defaultdict(lambda: [0, 0])
    for u, b in rows:
        for k in range(1, len(sets[u]) + 1):
            for some in combinations(sorted(sets[u]), k):
                count[some][0] += 1
                count[some][1] += b
    lift = min(urlrules.LIFT, (1 + 1 / base) / 2)
    fine = {s: b / a for s, (a, b) in count.items() if b >= max(urlrules.SUPPORT * n, urlrules.LEAST_URLS) and b / a >= urlrules.CONFIDENCE and b / a / base >= lift and (b - a * base) / (a * base * (1 - base)) ** 0.5 >= urlrules.SURE}
    want = {s for s, c in fine.items() if not any(set(t) < set(s) and fine[t] >= c for t in fine)}
    assert set(got) == want and want
    assert all(abs(got[s][0] - fine[s]) < 1e-9 for s in want)


def vectors_of(sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{sf}/embeddings.parquet') ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def test_op10_recall_on_the_whole_table(spark):
    ids, x = vectors_of(SF01)
    got = collections.defaultdict(list)
    for r in QUERIES["op10_nearest_neighbours"](spark, SF01).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        near = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        assert all(abs(s - d[list(ids).index(i)]) < 1e-12 for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set(near))
    assert hit >= 0.9 * 10 * len(got)


def test_multiprobe_visits_a_share_of_the_rows():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((50, 32))
    x = centres[rng.integers(0, 50, 5000)] + rng.standard_normal((5000, 32)) * 0.15
    _, whole = vectors_of("/root/testdata/sf0.1")
    for v, most in ((x, 0.03), (whole, 0.6)):  # the table's vectors point everywhere alike: no index can leave most of them out
        hashing = ann.Hashing(v.shape[1], ann.expected_distance(v[: ann.SAMPLE], len(v), 10))
        index, cells = hashing.index(v), hashing.cells(v)
        hit = share = 0
        for q in range(0, len(v), len(v) // 40):
            near = hashing.candidates(index, cells[q], len(v))
            d = ((v - v[q]) ** 2).sum(1)
            d[q] = np.inf
            hit += near[np.argsort(d)[:10]].sum()
            share += near.mean()
        n = len(range(0, len(v), len(v) // 40))
        assert hit / n >= 9 and share / n <= most


def test_perturbations_come_best_first():
    sets = ann.perturbations(4, 60)
    assert not sets[0].any() and len({tuple(s) for s in sets.tolist()}) == 60
    assert not (sets & sets[:, ::-1]).any()  # no cell is moved both ways
    assert sets[1].tolist() == [True] + [False] * 7


def test_equal_ids_and_short_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.Counter((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") == 0, 2).collect())
    assert got == collections.Counter([(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 1, 1.0), (0, 2, 1, 1.0), (0, 1, 0, 1.414214), (0, 2, 0, 1.414214)])


def test_query_blocks_give_the_same(spark, sf):
    from silvaframe.llm import blocked, topk

    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = topk.top_inner_products(df, F.col("vec_id") % 20 == 0, 20)
    rows = blocked.usable(df, True).withColumn("v", F.transform("v", lambda x: F.floor(x * 64.0).cast("double")))
    cut = blocked.blocked_topk(rows, F.col("vec_id") % 20 == 0, 20, lambda r, n: (topk.maxscore_unit(20), None), F.col("score").cast("long"), run_rows=64, query_bytes=4096)
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_only_groups_that_may_qualify_are_opened():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 60, 80, dtype=np.uint64)) for _ in range(400)]
    for i in range(0, 400, 40):
        sets[i + 1] = np.sort(np.concatenate((sets[i][:-2], rng.integers(0, 1 << 60, 2, dtype=np.uint64))))
    yes = np.ones(400, bool)
    root, (opened, compared) = jaccard.matrix_links(sets, yes, yes, 80)
    assert (root != np.arange(400)).sum() == 10
    assert 10 <= opened <= 20 and compared <= 20 * jaccard.GROUP


def test_samples_of_huge_tables_are_not_empty():
    for n in (10**11, 10**15):
        assert 0.99 * 3000 <= sample.threshold(n, 3000) * n / sample.SPACE <= 3001 or n == 10**15
        assert sample.threshold(n, 3000) > 0


def test_shards_follow_the_mix():
    assert mixing.shards_for(10**6, 5) == 16
    assert mixing.shards_for(10**11, 5) == 1562
    assert mixing.shards_for(10**13, 5) == 4096


def test_pipeline_stages_against_brute_force(spark, sf, tables):
    import corpus_pipeline
    from silvaframe.llm import toxicity
    from silvaframe.llm.scratch import written

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = written(stages["toxicity"](spark, docs, sf), "t")
    scores = {r.doc_id: r.score for r in toxicity.ToxicityModel.fit(docs, labels).score(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s < 0.7)
    one = stages["n-gram Jaccard join"](spark, kept, sf).collect()
    sets = {}
    for r in kept.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in one) == [i for i in ids if root(i) == i]


def test_components_in_one_task_and_over_levels(spark, monkeypatch):
    from silvaframe.llm import components as c

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 500, (300, 2))] + [(1000, 1000 + i) for i in range(1, 120)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for few in (1 << 20, 40):
        monkeypatch.setattr(c, "EDGES", few)
        assert sorted(map(tuple, c.components(df).collect())) == sorted((i, root(i)) for i in up)
    assert c.components(df.limit(0)).count() == 0
