"""Operators and stages that compare documents with each other, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from babelfold.llm import toxicity
from babelfold.llm import words as W
from babelfold.llm.cluster import connected_components
from babelfold.llm.line_dedup import dedup_lines, within_one_edit
from babelfold.llm.near_dup import near_duplicates
from babelfold.llm.queries import tokenizer_file
from helpers import components, edits, lines_left, near_groups, passages, space_words

SF = "/root/testdata/sf0.001"
VOCAB = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "io", "und", "ar")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def changed(rng, text, edits_):
    w = text.split(" ")
    for _ in range(edits_):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def corpus(rng):
    """Singles, exact and near copies, a crowd of near copies, odd rows."""
    rows = [(i, sentence(rng, rng.randint(1, 120))) for i in range(60)]
    for k in range(12):
        base = sentence(rng, 90)
        rows += [(100 + 10 * k + j, changed(rng, base, rng.randint(0, 8))) for j in range(6)]
    crowd = sentence(rng, 100)
    rows += [(400 + j, changed(rng, crowd, rng.randint(0, 14))) for j in range(120)]
    rows += [(600 + j, crowd.upper()) for j in range(20)]
    rows += [(700, "a b"), (701, "A  b\n"), (702, ""), (703, " \t"), (704, None), (705, sentence(rng, 9000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, k, percent):
    rows = corpus(random.Random(k))
    want = near_groups(rows, k, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as cid", "2 as component_id")
    got = near_duplicates(df, k, percent).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r.doc_id


def test_near_duplicates_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 2, False)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 510 + i) for i in range(50)]
    want = {n: c for n, c in components({x for e in links for x in e}, links).items()}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b and sum(a in e for e in links) == 1}
    assert got == {n: c for n, c in want.items() if n not in alone}


def test_one_edit():
    rng = random.Random(9)
    for _ in range(3000):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 7))]
        b = [rng.choice("ab") for _ in range(rng.randint(0, 7))]
        assert within_one_edit(a, b) == (edits(a, b) <= 1), (a, b)


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(1, 14)) for _ in range(40)]

    def line():
        s = rng.choice(base)
        x = rng.random()
        if x < 0.4:
            w = s.split(" ")
            at = rng.randrange(len(w))
            w[at:at + rng.randint(0, 1)] = [rng.choice(VOCAB)] * rng.randint(0, 1)
            s = " ".join(w)
        return s.upper() if rng.random() < 0.1 else s + rng.choice(("", " ", "\r"))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(150)] + [(1000, ""), (1001, "\n\n"), (1002, sentence(rng, 4000))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "'q' as h", "doc_id as origin")
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "n_dropped"]
    out = {r.doc_id: r for r in got.collect()}
    want = lines_left(rows)
    for d, t in rows:
        assert out[d].text == want[d], d
        assert out[d].n_dropped == t.count("\n") + 1 - (want[d].count("\n") + 1 if out[d].n_dropped < t.count("\n") + 1 else 0)


def test_lines_odd_tables(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, line), (1, None), (2, line), (2, line), (3, f"{line}\nkeep")]
    out = sorted(((r.doc_id or 0, r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(0, line, 0), (1, None, 0), (2, line, 0), (2, line, 0), (3, "keep", 1)], key=str)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("turn", [1, -1])
def test_lines_of_one_id_with_different_texts(spark, turn):
    line = "one two three four five six seven eight nine"
    near = line.replace("four", "vier")
    rows = [(2, "short"), (2, f"x\ny\nz\n{line}"), (3, near), (4, f"keep this\n{line}"), (4, "other"), (4, "other")]
    df = spark.createDataFrame(rows[::turn], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in dedup_lines(df).collect())
    assert got == [(2, "short", 0), (2, f"x\ny\nz\n{line}", 0), (3, "", 1), (4, "keep this", 1), (4, "other", 0), (4, "other", 0)]


def test_lines_columns_of_any_name(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, line), (2, line)], "doc_id long, text string")
    for c in ("n_dropped", "row", "id", "t", "r", "gone", "a.b", "rid", "line", "__gone"):
        df = df.withColumn(c, F.lit("kept"))
    got = sorted(dedup_lines(df).collect(), key=lambda r: r["doc_id"])
    assert sorted(got[0].asDict()) == sorted(df.columns) and [r["n_dropped"] for r in got] == [0, 1] and [r["text"] for r in got] == [line, ""]
    assert all(r[c] == "kept" for r in got for c in ("row", "id", "t", "r", "gone", "a.b", "rid", "line", "__gone"))


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, rng.integers(1, 8), replace=False)), rng.integers(1, 4, 8)) for _ in range(700)]
    rows = [(t, c[: len(t)].tolist()) for t, c in rows]
    ix = toxicity.Index(np.arange(40, dtype=np.uint64), rng.random(40) + 0.5, list(range(700)), rng.integers(0, 2, 700), rows, 0.1)
    dense = np.zeros((700, 40))
    for i, d in enumerate(ix.ids):
        dense[i, rows[d][0]] = ix.vector(*rows[d])
    for t, c in rows[:80]:
        q = ix.vector(t, c)
        full = np.round(dense[:, t] @ q, 9)
        order = np.lexsort((np.arange(700), -full))[: toxicity.NEIGHBOURS]
        order = order[full[order] > 0]
        s, d = ix.nearest(t, q)
        assert np.allclose(s, full[order]) and (full[d] == full[order]).all()


@pytest.mark.parametrize("leave_out", [False, True])
def test_search_of_many_texts_is_exact(leave_out):
    """Common and rare terms, long and short texts, equal cosines: as a product with all examples."""
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 3001) ** 0.9
    rows = []
    for i in range(900):
        t, c = np.unique(rng.choice(3000, int(rng.integers(1, 400)), p=share / share.sum()), return_counts=True)
        rows.append((t, c))
    rows += rows[:30]  # copies
    weights = np.where(rng.random(3000) < 0.02, 1.0, 0.002) * (1 + rng.random(3000))
    ix = toxicity.Index(np.arange(3000, dtype=np.uint64), weights, list(range(930)), rng.integers(0, 2, 930), rows, 0.1)
    assert 0 < len(ix.dense) < 3000 and len(ix.doc)
    mine = [rows[i] for i in ix.ids]
    dense = np.zeros((930, 3000))
    for i, (t, c) in enumerate(mine):
        dense[i, t] = ix.vector(t, c)
    queries = list(range(0, 930, 7))
    row = np.repeat(np.arange(len(queries)), [len(mine[i][0]) for i in queries])
    got = ix.search(row, np.concatenate([mine[i][0] for i in queries]), np.concatenate([ix.vector(*mine[i]) for i in queries]),
                    len(queries), without=np.array(queries) if leave_out else None)
    for i, (s, d) in zip(queries, got):
        full = np.round(dense @ dense[i], 9)
        if leave_out:
            full[i] = 0
        order = np.lexsort((np.arange(930), -full))[: toxicity.NEIGHBOURS]
        assert np.allclose(s, full[order], atol=2e-9) and np.allclose(full[d], full[order], atol=2e-9) and (i not in d or not leave_out)


def test_toxicity_scores_equal_brute_force(spark):
    """Scores of whole texts from plain cosines, votes and the calibration."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ix = toxicity.train(docs, labels)
    assert set(ix.labels) == {0.0, 1.0}
    known = {int(t): k for k, t in enumerate(ix.terms)}

    def vector(text):
        data, off = W.buffers(pa.array([text or ""]))
        v = np.zeros(len(known))
        for term, n in Counter(int(t) for t in toxicity._terms(data, off)[1]).items():
            if term in known:
                v[known[term]] = (1 + np.log(n)) * ix.weights[known[term]]
        return v / (np.linalg.norm(v) or 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    examples = np.array([vector(texts[i]) for i in ix.ids])
    for r in toxicity.score_toxicity(docs, ix).collect():
        s = np.round(examples @ vector(texts[r.doc_id]), 9)
        top = np.lexsort((np.arange(len(s)), -s))[: toxicity.NEIGHBOURS]
        top = top[s[top] > 0]
        if not len(top):
            assert r.score == ix.prior and not r.evidence
            continue
        assert np.allclose([e.cosine for e in r.evidence], s[top], atol=2e-9)
        w = 1 / (1.05 - np.minimum(s[top], 1))
        found = {ix.calibrated(v) for v in (np.array([(w * ix.labels[top]).sum() / w.sum()]) + [-1e-6, 0, 1e-6]).tolist()}
        assert r.score in found
    assert sum(bool(r.evidence) for r in toxicity.score_toxicity(docs, ix).collect()) > 0.95 * len(texts)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    held = {r.doc_id: r.score for r in scored.filter("crc32(cast(doc_id as string)) % 3 = 1").collect()}
    pairs = [(held[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in held]
    hit = [y for s, y in pairs if s >= 0.7]
    assert sum(hit) / len(hit) > 0.9 and sum(hit) / sum(y for _, y in pairs) > 0.9
    assert all(0 <= s <= 1 for s, _ in pairs)


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(i, f"you {'scum' if i % 2 else 'friend'} number {i}", 1) for i in range(200)]
                                 + [(900, None, 1), (901, "", 1), (None, "scum", 1), (902, "scum " * 9000, 1), (902, "scum " * 9000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels), score="s").collect()}
    assert got[901].s == got[900].s < 0.5 and got[None].s == got[902].s > 0.7 and got[902].evidence
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    assert toxicity.train(docs.limit(0), labels).prior == 0.5


def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "no id at all here", "en", "s", 17)], docs.schema)
    return docs.union(odd).selectExpr("*", "1 as kept", "2 as n_words", "3 as score", "'f' as found", "4 as n_hit", "5 as cid", "6 as `a.b`",
                                     "7 as dropped", "8 as __gone", "9 as __doc", "10 as __dropped", "11 as row", "12 as id", "13 as rid", "14 as component_id",
                                     "15 as ids", "16 as decoded", "17 as n_dropped")


def test_stages_equal_brute_force(spark):
    docs = clashing(spark)
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    kept = P.toxicity(spark, docs, SF)
    index = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.s for r in toxicity.score_toxicity(docs, index, score="s").collect()}
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {d for d in rows if score[d] < 0.7}

    out = P.line_dedup(spark, kept, SF)
    assert out.columns == columns
    out = {r.doc_id: r for r in out.collect()}
    before = {r.doc_id: r.text for r in kept.collect()}
    left = lines_left([(d, t) for d, t in before.items() if d is not None and t is not None])
    want = {d: (left.get(d, t)) for d, t in before.items() if d not in left or left[d] == t or space_words(left[d])}
    assert {d: r.text for d, r in out.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in out.items() if r.text != rows[d].text)

    lines = spark.createDataFrame(list(out.values()), docs.schema)
    near = P.near_dedup(spark, lines, SF)
    group = near_groups([(d, t) for d, t in want.items() if d is not None], 5, 80)
    assert near.columns == columns
    assert {r.doc_id for r in near.collect()} == {d for d in want if d is None or group[d][1] == d}

    clean = P.decontamination(spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = passages([(d, r.text) for d, r in rows.items()], items)
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {d for d in rows if not hits[d][1]}

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tokenizer.no_padding(), tokenizer.no_truncation()
    for r in P.encoding(spark, docs, SF).collect():
        ids = tokenizer.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_an_empty_table(spark):
    docs = clashing(spark).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_runs_and_keeps_clean_documents(spark):
    out = P.run(spark, SF).collect()
    assert [s for s, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "encoding"]
    assert 100 < len(out) <= 200 and len({r.doc_id for r in out}) == len(out)
    assert all(r.n_tokens >= 0 and len(r.ids_sha256) == 64 for r in out)
