"""Merkle manifest, whitening and language identification against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelfold.llm import langid, merkle, whitening
from babelfold.llm import queries as L

SF = "/root/testdata/sf0.001"


# ---- Merkle manifest -------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(trees, digest):
    met = []
    for rows, k in trees:
        for row in rows[:-1]:
            other = row[k ^ 1] if (k ^ 1) < len(row) else ""
            met.append(other)
            digest = H(other, digest) if k & 1 else H(digest, other)
            k >>= 1
    return met, digest


def plain_manifest(rows):
    """Sorted (doc_id, lang, leaf, subroot, root, siblings) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, row_digest(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            met, root = climb([(trees[g], i), (top, j)], leaf)
            assert root == top[-1][0]
            out.append((r[0], g, leaf, trees[g][-1][0], root, "".join(met)))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("width", [1, 3, 256])
def test_manifest_equals_plain_trees(spark, width):
    rows = [(i, f"s{i % 3}", ["en", "é", "a\x00", None, "zz"][min(i % 7, 4)], i if i % 5 else None, "t" * (i % 50)) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "x", "en", 1, ""), (7, "s", "en", 3, "other"), (7, "s", "en", 3, "other"),
             (1, "s", "alone", 1, "x" * 200_000), (2, "s", "", 1, "empty name")]
    df = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("key", F.lit(2))
    got = merkle.manifest(df.repartition(5), width=width)
    assert got.columns == ["lang", "doc_id", "leaf", "changed", "subroot", "root", "proof"]
    got = got.select("doc_id", "lang", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("met"),
                     (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    assert sorted([tuple(r)[:6] for r in got], key=str) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(5, "s", "en", 1, "a")], DOCS)).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []


def test_changed_rows_do_not_verify(spark):
    got = L.op12_merkle_manifest(spark, SF).collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_octopus_is_minimal():
    for n in range(1, 40):
        for a in range(n):
            for b in range(a + 1, n + 1):
                need, have = set(), {(0, i) for i in range(a, b)}
                lo, hi = a, b - 1
                for level in range(merkle.height(n)):
                    for i in range(lo, hi + 1):  # every sibling on the way, unless it lies over these leaves too
                        if (i ^ 1) < merkle.count(n, level) and not lo <= (i ^ 1) <= hi:
                            need.add((level, i ^ 1))
                    lo, hi = lo >> 1, hi >> 1
                assert set(merkle.missing(a, b, n)) == need and have


# ---- whitening -------------------------------------------------------------------

def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n = len(x)
    c = x - x.mean(axis=0)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return x, e[:k], u[:, :k], np.trace(v)


def check_whitening(got, vectors, k=8):
    x, e, u, trace = plain_whitening(vectors, k)
    n, sums = len(x), x.astype(int).sum(axis=0)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-8
    assert sorted(by) == list(range(n))
    z = (x - sums / n) @ u / np.sqrt(e)
    for c in range(1, len(e) + 1):
        w = np.array([by[i][c].whitened for i in range(n)])
        sign = np.sign(w @ z[:, c - 1])
        assert np.allclose(w * sign, z[:, c - 1], atol=1e-6)
        assert abs(by[0][c].explained - e[c - 1] / trace) < 1e-10
    for i in range(n):
        assert int(by[i][1].deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))


def vectors_of(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]


def test_whitening_equals_eigenvectors(spark):
    v = vectors_of(400, 12)
    rows = [(i, [float(c) for c in x], "x") for i, x in enumerate(v)]
    bad = [(900, None, ""), (901, [float("nan")] * 12, ""), (902, [float("inf")] + [0.0] * 11, ""), (903, [None] + [0.0] * 11, ""), (904, [1.0], ""), (905, [], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string").repartition(7)
    got = whitening.whiten(df).collect()
    assert len(got) == 400 * 8
    check_whitening(got, v)


def test_whitening_with_dependent_and_constant_dimensions(spark):
    v = vectors_of(300, 5)
    v = np.column_stack([v, np.floor(1024 * v[:, 0]) / 1024 * 2, np.full(300, 0.5), np.floor(1024 * (v[:, 1])) / 1024])
    v[:, 0] = v[:, 5] / 2
    v[:, 1] = v[:, 7]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 300 * 5  # three of eight directions have no variance
    check_whitening(got, v, 5)


def test_whitening_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(3, [float("nan")])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0


def test_whitening_of_the_table(spark):
    got = L.op11_whitening(spark, SF).collect()
    v = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitening(got, v)
    assert dict(L.op11_whitening(spark, SF).dtypes)["deviation"] == "bigint"


def test_huge_entries_keep_exact_deviations(spark):
    v = [[1e17, 1.0], [-1e17, 2.0], [3e9, 0.0]]
    got = whitening.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    x = [[min(max(int(np.floor(c * 1024)), -2 ** 62), 2 ** 62) + 100_000 for c in r] for r in v]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        want = sum((3 * c - t) ** 2 for c, t in zip(x[r.vec_id], s))
        assert (r.deviation is None and want >= 10 ** 38) or int(r.deviation) == want


# ---- language --------------------------------------------------------------------

def test_held_out_languages(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = L.op13_language(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    def words(letters):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    kinds = {"aa": "abcde", "ab": "abcdf", "ba": "mnopq", "bb": "mnopr"}
    rows = [(words(letters), lang) for lang, letters in kinds.items() for _ in range(40)] + [("x", None), (None, "aa"), ("12", "aa"), ("", "ab")]
    model = langid.train(spark.createDataFrame(rows * 2, "text string, lang string"))
    assert model.languages == ["aa", "ab", "ba", "bb"] and model.families == [[0, 1], [2, 3]]
    test = [(1, words("abcde") + " " + words("abcde")), (2, words("mnopr")), (3, None), (4, ""), (5, "12 !?"), (6, words("abcdf") * 3000), (7, "a"), (8, "語")]
    df = spark.createDataFrame(test, "score int, text string").withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    got = {r["score"]: r for r in langid.identify(df, model, score="p").collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["aa", "bb", "und", "und", "und", "ab"]
    assert got[7].lang_pred in model.languages and got[8].lang_pred in model.languages and got[1]["a.b"] == 1
    assert [got[k].p for k in (3, 4, 5)] == [0.0] * 3 and got[2].p > 0.5
    nothing = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, nothing, score="p").collect()} == {"und"}
    single = langid.train(spark.createDataFrame([("abc", "only")], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, single, score="p").collect()} == {"und", "only"}


def test_grams_equal_a_plain_count():
    import pyarrow as pa
    from babelfold.llm import words as W
    texts = ["ab c", "", "é!?x", "  hello,  World 12 x", "z"]
    data, off = W.buffers(pa.array(texts))
    g = langid.Grams(data, off)
    for k, t in enumerate(texts):
        b = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in t.lower().encode())
        b = b" " + b + b" "
        b = bytes(c for i, c in enumerate(b) if c != 0x20 or i == 0 or b[i - 1] != 0x20 or i == len(b) - 1)
        want = {}
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                s = b[i:i + n]
                if s != b" " and not (n == 3 and s[1:] == b"  "):
                    key = np.array([sum(c << (8 * j) for j, c in enumerate(s))], np.uint32)
                    want[int(langid._bucket(key, n)[0])] = want.get(int(langid._bucket(key, n)[0]), 0) + 1
        idx, share = g.of(k)
        total = sum(want.values())
        assert abs(total - g.total[k]) <= 2
        if total and g.total[k] == total:
            assert {i: round(s * total) for i, s in zip(idx.tolist(), share)} == want
