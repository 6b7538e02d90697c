"""Operators that answer each text on its own, against plain versions and the odd cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelfold.llm import bpe, decontaminate, html_extract, licenses, pii, quality, token_counts
from babelfold.llm.queries import tokenizer_file
from helpers import passages, quality_counts, seeds

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three four five " * 30), (5, "one two three four five " * 30),
       (None, "Émile's 12 ÀÉ日本語🙂 a+b@c.org\r\nx"), (6, "w" * 5000), (7, "na " * 9000 + "end")]


def table(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns that are called like the operators' own
        for c in ("n_words", "kept", "ids", "row", "found", "score", "g", "x", "lang", "source", "__row2"):
            df = df.selectExpr("*", f"cast(null as string) as {c}")
    return df


def same(df, want, key="doc_id"):
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    assert got == sorted(map(str, want))


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = "abcÉßΣς ’'stre ll\n\x85\x1c日本🙂²Ⅷ½１#$é<|endoftext|>"
    rows = ODD + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for i in range(400)] + [
        (900, "a<|startoftext|>b <|endoftext|>"), (901, "ab" * 700)]
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, np.array(ids, "<u4").tobytes().hex(), lib.decode(ids, skip_special_tokens=False)))
    got = bpe.encode_decode(table(spark, rows), path).selectExpr("doc_id", "lower(hex(ids)) h", "decoded")
    same(got, want)
    assert bpe.encode_decode(table(spark, []), path).count() == 0


def test_bpe_tree_of_one_and_tree_of_many_agree():
    v = bpe.Vocabulary(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(2)
    words = [bytes(rng.choice(b"thearnigo") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for w, ids in zip(words, bpe.encode_words(v, words)):
        b = np.frombuffer(w, np.uint8)
        assert bpe.merge_one(v, [*v.inner[b[:-1]].tolist(), int(v.final[b[-1]])]) == np.frombuffer(ids, "<u4").tolist()


def test_token_counts_equal_plain_dynamic_programming(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    unknown = min(score.values()) - token_counts.UNKNOWN_PENALTY

    def count(w):
        s = token_counts.MARK + w
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j - 1, -1, -1):
                if s[i:j] in score and best[i][0] + score[s[i:j]] > best[j][0]:
                    best[j] = best[i][0] + score[s[i:j]], best[i][1] + 1
            if best[j - 1][0] + unknown > best[j][0]:
                best[j] = best[j - 1][0] + unknown, best[j - 1][1] + len(s[j - 1].encode())
        return best[-1][1]

    from helpers import space_words
    rows = [r for r in ODD if r[0] not in (6, 7)] + [(50, "thé🙂 日本語 the them themselves theatre"), (51, "x" * 80)]
    want = [(d, len(space_words(t)), sum(count(w) for w in space_words(t, lower=False))) for d, t in rows]
    same(token_counts.count_tokens(table(spark, rows), path), want)
    assert token_counts.count_tokens(table(spark, []), path).count() == 0


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_passages_equal_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocab = "red green blue one two Ünder 7".split()
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(("", ",", ".")) for _ in range(n))
    items = [(i, text(rng.choice((2, 5, 12, 20)))) for i in range(12)] + [(90, None), (91, " . "), (92, ""), (93, text(12))]
    items += [(94, items[-1][1])]
    docs = ODD + [(200 + i, text(rng.randint(1, 700))) for i in range(60)]
    docs += [(300 + i, text(5) + " " + (items[i][1] or "") + " " + text(700)) for i in range(12)]
    want = passages(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(table(spark, docs), bench, block_bytes=block_bytes).selectExpr(
        "doc_id", "n_words", "n_hit", "array_join(array_sort(array_distinct(found.item_id)), ',') ids")
    same(got, [(d, *want[d]) for d, _ in docs])


def test_passages_without_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_passages(table(spark), none).collect()} == {0}
    some = spark.createDataFrame([(1, "one two three four five one two three four five")], "item_id long, text string")
    assert decontaminate.find_passages(table(spark, []), some).count() == 0


def test_quality_counts_and_outliers(spark):
    rng = random.Random(6)
    plain = [(1000 + i, ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(12)).capitalize()
                                  for _ in range(rng.randint(6, 30)))) for i in range(150)]
    junk = [(2000 + i, " ".join(w + "***" for w in t.split())) for i, (_, t) in enumerate(plain[:10])]
    odd = [*ODD, (9, "same line here\nsame line here\n\nsame line here \nother & <b>")]
    rows = [(d, t, "en", None if d % 2 else "s") for d, t in plain + junk] + [(d, t, None, None) for d, t in odd]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as x")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    text = {}
    for d, t, *_ in rows:
        text.setdefault(d, t)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(text[r.doc_id]), r.doc_id
        if r.doc_id and r.doc_id >= 1000:
            assert r.kept == (r.doc_id < 2000) and not r.base_failed, r
        if r.n_words < 50:
            assert r.base_failed and not r.kept
    assert quality.judge(df.limit(0)).count() == 0


def test_quality_rejects_junk_that_is_nearly_half_of_a_group(spark):
    rng = random.Random(16)

    def plain():
        return ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(12)).capitalize()
                         for _ in range(rng.randint(6, 30)))
    rows = []
    for share in (0, 10, 30, 38, 45):
        for i in range(200):
            t = plain()
            junk = i < 2 * share
            if junk:
                t = " ".join(w + "***" if rng.random() < 0.7 else w for w in t.split())
            rows.append((share * 1000 + i, t, "en", f"s{share}", junk))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    wrong = [(r.source, r.doc_id, r.distance) for r in quality.judge(df, columns=["doc_id", "source", "junk"]).collect() if r.base_failed or r.kept == r.junk]
    assert not wrong, (len(wrong), wrong[:5])


def test_seeds_equal_the_forms(spark):
    rng = random.Random(7)
    bits = ["a.b@c-d.org", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713",
            "+49.30.12", "word", "_a@b.co_x@y.com", "12", "é", "\n", "007.008.9.010", "+1+2 345 678 90", "\x01", "9" * 3000]
    rows = ODD + [(100 + i, rng.choice(("", " ", ",")).join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    got = pii.find_spans(table(spark, rows)).select("doc_id", pii.listed(pii.F.col("base")).alias("s"))
    same(got, [(d, seeds(t)) for d, t in rows])


def test_contexts_discover_what_the_forms_miss(spark):
    rows = [(i, f"call my phone number: +1 (555) 123-{i:04d} any time") for i in range(100, 140)] + [
        (500, "my phone number: 555-123-9999, ok"), (501, "room 12 at 5 o'clock"), (502, None)]
    out = {r.doc_id: r for r in pii.find_spans(table(spark, rows)).collect()}
    assert [(x.kind, x.value) for x in out[500].found] == [("phone", "555-123-9999")]
    assert not out[501].found and not out[502].found and len(out) == len(rows)
    assert all(not out[i].found and len(out[i].base) == 1 for i in range(100, 140))
    assert pii.digests(pii.find_spans(table(spark, []))).count() == 0


def test_contexts_are_rated_by_others_only_and_values_count_in_place(spark):
    rows = [(i, f"call my phone number: +1 (555) 123-{i:04d} any time") for i in range(1000, 1120)]
    rows += [(2000 + j, f"call my phone number: 555-123-900{j} any time") for j in range(10)]  # 120 of 130 are seeds
    rows += [(2100 + j, f"by fax desk 555-123-900{j} now") for j in range(10)] + [(2110, "by fax desk 555-777-0000 now")]  # a second hop
    rows += [(2200 + i, f"the ticket ref +1 (555) 999-{i:04d} ok") for i in range(12)]
    rows += [(2300 + i, f"the ticket ref 77{i} ok") for i in range(8)]  # 12 of 20 are seeds
    rows += [(2400, "a room 555-123-9001 empty")]
    out = {r.doc_id: [x.value for x in r.found] for r in pii.find_spans(table(spark, rows)).collect()}
    want = {2000 + 100 * k + j: [f"555-123-900{j}"] for j in range(10) for k in (0, 1)} | {2110: ["555-777-0000"]}
    assert {d: v for d, v in out.items() if v} == want


def test_licences(spark):
    rng = random.Random(8)
    plain = [(i, "\n".join(" ".join(rng.choice(("alpha", "version", "beta", "gamma", "under", "the", "this", "work", "is")) for _ in range(rng.randint(3, 30)))
                           for _ in range(4))) for i in range(80)]
    rows = plain + [(200, plain[0][1] + "\nReleased under the MIT License."), (201, "LICENSED UNDER CC BY-NC 4.0"), (202, None), (None, ""),
                    (203, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
                    (204, "he was licensed to drive a public bus"),
                    (205, "Some words.\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
                          "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n \nMore."),
                    (206, "Released under the\nMIT License"),
                    (207, "Licensed under the Apache License, Version 2.0 or Released under the MIT License"),
                    (208, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."),
                    (209, "// SPDX-License-Identifier: MIT"), (210, "# SPDX-License-Identifier: Apache-2.0"),
                    (211, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
                    (212, " ".join(plain[k][1].replace("\n", " ") for k in range(40)) + " Permission is hereby granted, free of charge, to any person obtaining a copy of "
                          "this software and associated documentation files, to deal in the Software without restriction. "
                          + " ".join(plain[k][1].replace("\n", " ") for k in range(40, 80)))]
    out = {r.doc_id: [x.family for x in r.notices] for r in licenses.scan(table(spark, rows)).collect()}
    assert out[200] == ["mit"] and out[201] == ["cc-by-nc"] and out[203] == ["apache-2.0", "gpl-3.0"]
    assert out[205] == ["gpl-3.0"] and out[206] == ["mit"] and out[207] == ["apache-2.0", "mit"] and out[208] == ["isc"]
    assert out[209] == ["mit"] and out[210] == ["apache-2.0"] and out[211] == ["cc-by-sa"] and out[212] == ["mit"]
    assert not out[202] and not out[204] and not out[None] and not any(out[d] for d, _ in plain)


def test_licence_training_takes_every_line(spark, monkeypatch):
    """The odds that the bound is taken from are those of all held-out lines, of more texts and
    lines than a bounded sample would hold, and the ordinary lines counted are all of the table's."""
    rng = random.Random(12)
    vocab = ["alpha", "version", "beta", "gamma", "under", "the", "this", "work", "is", "a", "of", "terms", "delta", "2.0"]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 30)))
    texts = ["\n".join([line(), line(), (f"4.0 nc by cc licensed alpha{k}" if k % 200 == 0 else line()), "", "..."]) for k in range(2600)]
    texts += [texts[0], " ".join(line() for _ in range(40)), "", None, "Released under the MIT License"]
    docs, seen = table(spark, list(enumerate(texts))), {}
    monkeypatch.setattr(licenses, "_bound", lambda values, total: seen.update(values=values.collect(), total=total) or 0.75)
    model = licenses.train(docs)
    all_ = {tuple(w[k: k + licenses.WIDTH]) for t in texts for x in (t or "").split("\n") for w in [re.findall(licenses.WORD, x.lower())]
            for k in range(0, len(w), licenses.WIDTH)}
    shared = lambda w: max(len(set(b) & {f"{x} {y}" for x, y in zip(w, w[1:])}) / len(b) for _, b in licenses._template_bigrams())
    plain = [w for w in all_ if shared(w) < 0.3]
    assert 7000 < len(plain) < len(all_)
    df = spark.createDataFrame([(list(w),) for w in plain], "w array<string>").withColumn("h", F.xxhash64("w"))
    odds = model.odds(df.withColumn("grams", F.concat("w", licenses.bigrams(F.col("w"))))).select("h", "odds").collect()
    held = sorted(max(r.odds[1:]) for r in odds if r.h % 2)
    assert model.bound == 0.75 and seen["total"] == len(held)
    assert sorted(r.value for r in seen["values"] for _ in range(r.n)) == pytest.approx(held, abs=1e-9)
    ordinary = licenses._ordinary(docs).collect()
    assert sum(r.n for r in ordinary) == len(plain) and sum(r.n for r in ordinary if r.held) == len(held)
    ones, twos = map(set, licenses._features())
    of = lambda w: tuple(sorted({x for x in w if x in ones} | {b for b in (f"{x} {y}" for x, y in zip(w, w[1:])) if b in twos}))
    kinds = {}
    for r in ordinary:
        kinds[tuple(r.grams)] = kinds.get(tuple(r.grams), 0) + r.n
    assert kinds == Counter(map(of, plain))


def test_licence_bound_equals_sorting(spark):
    rng = random.Random(13)
    for values in ([rng.random() for _ in range(300)], [0.6] * 50, [0.9] * 2 + [0.2] * 40, [0.1], [], [0.5 + rng.random() / 10**9 for _ in range(90)]):
        rows = [(v, rng.randint(1, 40)) for v in values]
        flat = sorted(v for v, n in rows for _ in range(n))
        over = [v for v in flat if sum(x > v for x in flat) <= (1 - licenses.PURITY) * len(flat)]
        got = licenses._bound(spark.createDataFrame(rows, "value double, n long"), len(flat))
        assert got == max(0.5, over[0] if over else 0.0)


def test_licence_shares_and_windows_equal_plain_python(spark):
    """Windows, template shares and what is part of a better match, worked out in plain Python."""
    rng = random.Random(9)
    vocab = ["licensed", "under", "the", "mit", "apache", "license", "version", "2.0", "released", "cc", "by", "sa", "4.0", "software", "x", "y"]
    texts = ["\n".join("" if rng.random() < 0.2 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts += [t for ts in licenses.TEMPLATES.values() for t in ts] + ["", "\n \n\n", "a\n \t\n\nb"]

    def plain_windows(text):
        out = []
        for i, p in enumerate(re.split(r"\n(?:[ \t\x0b-\r]*\n)+", text)):
            w = re.findall(licenses.WORD, p.lower())
            starts = range(0, len(w) - licenses.WIDTH + licenses.STEP, licenses.STEP) if len(w) > licenses.WIDTH else [0]
            out += [(i, w[a: a + licenses.WIDTH]) for a in starts]
            assert not w or {x for a in starts for x in range(a, min(a + licenses.WIDTH, len(w)))} == set(range(len(w)))
        return out
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", F.explode(licenses.windows(F.col("text"))).alias("p")).select("i", "p.paragraph", "p.w")
    by = {}
    for r in got.collect():
        by.setdefault(r.i, []).append((r.paragraph, r.w))
    assert {i: plain_windows(t) for i, t in enumerate(texts)} == by

    families = [licenses.NONE, *licenses.TEMPLATES]
    odds = F.array(*[F.lit(0.4 if f in ("none", "bsd") else 0.9) for f in families])
    found = got.withColumn("two", licenses.bigrams(F.col("w"))).select("w", licenses._confirmed(F.col("two"), odds, families, 0.5).alias("n")).collect()
    hits = 0
    for r in found:
        two = {f"{a} {b}" for a, b in zip(r.w, r.w[1:])}
        sure = []
        for f, b in licenses._template_bigrams():
            if f != "bsd" and len(two & set(b)) / len(b) >= licenses.CONFIRM:
                sure.append((f, len(two & set(b)) / len(b), two & set(b)))
        want = sorted((f, s) for f, s, h in sure if not any(g != f and len(k) > len(h) and h <= k for g, _, k in sure))
        assert sorted((x.family, x.share) for x in r.n) == want
        hits += bool(want)
    assert hits > 20


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    trees = html_extract.train(pages)
    p = "<p>Some words,\n  quite a&nbsp;few &amp; more.</p>"
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("<html><script>var a='<p>x</p>'</script></html>", ""),
        4: (f'<body><div class="cookie-notice"><p>We use cookies.</p></div><nav><a href=x>Home</a></nav><main><h1>T &#146;</h1>{p}'
            f'<div class="ad">Buy now</div>{p}</main><div id="comments"><p>I liked it.</p></div><footer>&copy; us</footer></body>',
            "T ’\nSome words, quite a few & more.\nSome words, quite a few & more."),
        5: (f"<article><p><b>Open.<br>{p}<li>a<li>b<p title='a > b'>end" + "<p>x y</p>" * 3000 + "</article>", None),
    }
    df = spark.createDataFrame([(k, h, "u", 1) for k, (h, _) in cases.items()], "page_id long, html string, url string, text int")
    out = {r.page_id: r.text for r in html_extract.extract_text(df, trees).collect()}
    for k, (_, want) in cases.items():
        if want is not None:
            assert out[k] == want
    assert out[5].startswith("Open.\nSome words, quite a few & more.\na\nb\nend\nx y") and out[5].count("\n") == 3004
    assert html_extract.extract_text(df.limit(0), trees).count() == 0


@pytest.mark.parametrize("source, want", [
    ('<p>A <svg class="i"/> first.</p><p>second</p></article>', ["A first.", "second"]),
    ('<p>A <svg class="i"/> first.</p><p>second</p><svg><text>x</text></svg><p>third', ["A first.", "second", "third"]),
    ("<p title=it's>one</p><p>two don't three</p>", ["one", "two don't three"]),
    ("<p title='a > b' id=\"c > d\" x = 'e > f'>one", ["one"]),
    ("<p>a<svg><style/><title/><svg>x</svg>y</svg>b<p>c", ["ab", "c"]),
    ("<p>a<svg><path><p>b<p>c<svg></svg>", ["a", "b", "c"]),
    ("<p>a<svg><foreignObject><p>x</p></foreignObject>y</svg>b", ["ab"]),
    ("<p>a<object>x<object>y</object>z</object>b<p>c", ["ab", "c"]),
    ("<p>a<object data=x><p>b<p>c", ["a", "b", "c"]),
    ("<p>a<select><option>x<option>y</select>b<noscript>x</noscript><template><p>x</template>c", ["abc"]),
    ("<p>a<script>if (a < b) '</p>'</script>b<style>p > a {}", ["ab"]),
])
def test_only_hidden_elements_hide_text(source, want):
    assert [t for t in html_extract.Page(source).text if t] == want


def test_main_text_on_layouts_it_was_not_trained_on(spark):
    trees = html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    bad = 0
    for seed in range(300):
        page = html_extract.Page(html_extract.training_page("some other words make this page of text".split(), 10**9 + seed))
        want = [t[1:].replace(html_extract.MAIN, "") for t in page.text if t and t.startswith(html_extract.MAIN)]
        page.text = [t.replace(html_extract.MAIN, "") if t else t for t in page.text]
        bad += page.decode(trees.reject(page.features())) != "\n".join(want)
    assert bad <= 6
