"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tesselite.llm import bpe, dom, exact_dedup, html_extraction, inverted_multi_index, jaccard, language_model, line_dedup, mixing, packing, token_files, toxicity, wavelet, words
from tesselite.llm.common import scratch

SCHEMA = "doc_id long, text string, source string, id string, len int, size int, key string"
#: Columns whose names clash with those used inside.
EXTRA = ("x", 1, 2, "k")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, *EXTRA) for i, t, s in rows], SCHEMA)


ROWS = [(1, "a b c d", "s"), (2, None, None), (3, "", "s"), (4, "a b c d", "t"), (4, "a b c d", "t"), (5, "à  b\n" * 2000, "t"), (None, "x", "é"), (7, " A\tB\x0bC d ", "s"), (8, "x", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, digest_all=True).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)
    assert exact_dedup.exact_dedup(none).count() == 0


@pytest.mark.parametrize("salted", [1, 100])
def test_exact_dedup_of_more_groups_than_are_broadcast(spark, monkeypatch, salted):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "SALTED", salted)
    rows = [(k, f"text {k % 7 if k < 140 else 'alone' * (k % 5)} {'same' if k % 3 else k}", "s") for k in range(200)]
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()}
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t, _ in rows}


def test_exact_dedup_tells_recurring_lengths(docs):
    plan = exact_dedup._met(docs.select("doc_id", F.octet_length("text").alias("len")), exact_dedup._bits(docs.select(F.lit(1).alias("len")), "len"), "len")
    assert {(r.doc_id, r.again) for r in plan.collect()} == {(i, len((t or "").encode()) == 1 and t is not None) for i, t, _ in ROWS}


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_encoder_agrees_with_the_library():
    enc = bpe.Encoder(bpe.public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b", " a", "a ", "a\n b \n\nc  ", "don't  we'll", "a\x1cb c", "<|endoftext|> hi", "é  ü\t\tq", "\n\n\n", "12 34  56!!  ?", "a\n\nb c", "foo\n", "q  z", "w　", "x " + "y" * 200 + " z\n", "naïve café 日本語 text 😀 ok", "a\u0085b c"]
    for _ in range(2):  # the second time from memory
        for t, ids in zip(texts, enc.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 300, 5000).astype(np.uint32) ** 2
    m, names, counts = wavelet.load(wavelet.dump(ids, [3, None], [4000, 1000]))
    assert (m.ids() == ids).all() and names == [3, None] and counts.tolist() == [4000, 1000]
    for i in (0, 63, 64, 777, 4999):
        assert m.access(i) == ids[i]
    for v in {int(ids[5]), int(ids[4999]), 7}:
        at = np.flatnonzero(ids == v)
        assert m.count(v) == len(at) and m.count(v, 100, 3000) == ((at >= 100) & (at < 3000)).sum()
        for j in range(len(at)):
            assert m.select(v, j) == at[j]
    with pytest.raises(IndexError):
        m.select(7, 0)
    with pytest.raises(IndexError):
        m.access(5000)
    assert len(wavelet.load(wavelet.dump(np.zeros(0, np.uint32), [], []))[0].ids()) == 0


def test_token_files(spark, docs, none):
    folder = scratch(spark, "t")
    got = token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder, shard_tokens=1000)).collect()
    enc = bpe.encoder()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t, _ in order:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((str(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    folder = scratch(spark, "t")
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(none, folder)).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1024: 5, 1: 3}, {345: 900}, {513: 100, 300: 500, 212: 333}, {k: 1 + k % 7 for k in range(1, 1025)}, {1: 5000}, {600: 3, 424: 3}])
def test_packing_plan(histogram):
    p = packing.plan(histogram)
    used, taken = collections.Counter(), collections.defaultdict(list)
    for length, a, b, each, first, at in p.rows:
        used[length] += b - a
        for k in range(b - a):
            taken[first + k // each].append((at + k % each * length, length))
    assert used == collections.Counter(histogram)
    for pieces in taken.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= 1024
    decreasing = packing.Plan(1024)
    for s in sorted(histogram, reverse=True):
        decreasing.best_fit(s, histogram[s])
    assert len(taken) == p.sequences <= decreasing.sequences


def test_packing(docs, none):
    got = packing.pack_documents(docs).toPandas()
    assert len(got[got.doc_id == 4]) == 2 and got[got.doc_id == 5].length.iloc[1:].eq(1024).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 1024
    long = got[got.doc_id == 5].sort_values("piece")
    assert (long.length.cumsum() - long.length == long.start).all()
    ids = np.array([*bpe.encoder().tokenizer.encode(ROWS[5][1], add_special_tokens=False).ids, 2], "<u4")
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(long.start, long.length, strict=True)] == long.ids_crc32.tolist()
    assert packing.pack_documents(none).count() == 0


def shingle_set(text, width):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width,percent,frequent,up_to", [(3, 90, 32, 60), (3, 90, 3, 60), (5, 80, 3, 600), (5, 80, 3, 0)])
def test_jaccard(spark, monkeypatch, width, percent, frequent, up_to):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", up_to)
    rng, rows = np.random.default_rng(3), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(140)]
        for _ in range(18):
            w = list(base)
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(140)] = f"z{rng.integers(6)}"
            rows.append(" ".join(w))
    rows += ["", "a", "A", "a b", " a\tb ", "à b c d e f", "à b c d e f"] + rows[:3] + ["passage " * 3 + " ".join(f"p{k}" for k in range(60)) + f" own{j}" * 40 for j in range(6)]
    rows = list(enumerate(rows))
    got = jaccard.jaccard_join(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class int"), width=width, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows, width, percent)


def test_jaccard_edges(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, width=3, percent=90).collect()}
    assert {(1, 2, 1), (4, 2, 1), (7, 2, 1), (2, 0, 2), (3, 0, 3)} <= got
    assert jaccard.jaccard_join(none).count() == 0


def test_words():
    texts = pa.array(["à b à\x85c", "", " A\tb\x0bC\x0c d \n", "  ", "É\x1cz A"])
    for some in (texts, texts.slice(2), texts.slice(1, 0)):
        bounds, index, found = words.tokens(some)
        found = found.to_pylist()
        assert [[found[k].encode() for k in index[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] == [WORD.findall(t.encode().lower()) for t in some.to_pylist()]


def test_line_dedup(spark, none):
    boiler = "this site was last updated on day {} by the team of editors in charge"
    long = " ".join(f"passage{k}" for k in range(60))
    rows = [(k, f"{boiler.format(k)}\nown text number{'abcdefghijkl'[k]} here\n{long if k < 4 else ''}\n", "s") for k in range(12)]
    rows += [(20, None, "s"), (21, "", "s"), (22, "one\n\ntwo", "s"), (23, boiler.format(99), None), (24, "whole copy of a text that is long enough to count", "s"), (25, "whole copy of a text that is long enough to count", "s"), (26, "whole copy of a text that is long enough to count", "s"), (26, "whole copy of a text that is long enough to count", "s")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == rows[0][1]
    for k in range(1, 12):
        assert got[k].text == f"own text number{'abcdefghijkl'[k]} here\n" + ("" if k < 4 else "\n"), k
    assert got[20].text is None and got[21].text == "" and got[22].text == "one\n\ntwo"
    assert got[23].text == "" and got[23].n_dropped == got[23].n_lines == 1
    assert got[25].n_dropped == got[26].n_dropped == 0  # equal texts count once
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("size", [20, 400])
def test_line_dedup_of_fields_with_few_values(spark, size):
    rows = [(k, f"Posted in section s{'abcde'[k % 5]} by our writer w{'abcdefg'[k % 7]} for readers of r{'abc'[k % 3]} only\nown{k}", "s") for k in range(size)]
    # Three such lines of one text don't recur.
    rows.append((size, "\n".join(f"prices of all {x} in the shop of this town are final" for x in ("apples", "pears", "plums")), "s"))
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert [got[k].n_dropped for k in range(size)] == [0] + [1] * (size - 1)
    assert got[5].text == "own5" and got[size].n_dropped == 0


def test_line_dedup_of_a_long_line_in_two_texts(spark):
    long, short = " ".join(f"passage{k}" for k in range(50)), " ".join(f"shorter{k}" for k in range(49))
    rows = [(k, f"own{k}\n{long}\n{short}", "s") for k in range(2)] + [(9, f"{'other ' * 60}\nown9\n{'other ' * 60}", "s")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and got[1].text == f"own1\n{short}"
    assert got[9].n_dropped == 0  # twice in one text


def test_line_dedup_of_lines_with_many_digits(spark):
    rows = [(k, f"own{k}\nUpdated 12 May 2021 at 10:45 UTC", "s") for k in range(10)] + [(k, f"own{k}\nSeen {k} of {k + 5} on {k * 7} days", "s") for k in range(10, 20)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert [got[k].n_dropped for k in range(20)] == ([0] + [1] * 9) * 2


def test_line_dedup_of_short_lines(spark):
    rows = [(k, "\n".join([f"own{k}", "版权所有", *["Read more"] * (k < 30), *["Go back"] * (k < 29)]), "s") for k in range(60)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and got[1].text == "own1\nGo back" and got[29].text == "own29"
    assert all(got[k].text == f"own{k}" for k in range(30, 60))
    assert all("版权所有" in r.text for r in line_dedup.line_dedup(table(spark, rows[1:])).collect())  # 59 texts


def test_line_dedup_splits_a_text_of_many_lines_once(spark):
    """Splitting it anew for every line that stays takes minutes."""
    gone = "this line is in every one of the texts of this test, so it goes " * 3
    own = [f"own{'abcdefghij'[k % 10]}{k}" if k % 7 else ("", " \t\x0b", "\r", "\x85", "\xa0", "\x1c")[k % 6] for k in range(40_000)]
    rows = [(k, f"{gone}\nu{'abcd'[k]}", "s") for k in range(4)] + [(9, "\n".join([*own, gone, *own[:3]]), "s")]
    made = line_dedup.line_dedup(table(spark, rows))
    began = time.monotonic()
    got = {r.doc_id: r for r in made.collect()}
    assert time.monotonic() - began < 15
    assert [got[k].text for k in range(4)] == [rows[0][1], "ub", "uc", "ud"] and got[9].n_dropped == 1
    assert got[9].text == "\n".join([*own, *own[:3]])
    assert got[9].n_lines == sum(bool(WORD.search(x.encode())) for x in [*own, gone, *own[:3]])


def test_hashes_of_words():
    some = pa.array(["", "a", "à", "long " * 100, "x\x00y"])
    for w in (some, some.slice(1, 3), some.slice(5)):
        assert words.hashes(w).tolist() == [xxhash.xxh3_64_intdigest(x.encode()) for x in w.to_pylist()]


def plain_line_dedup(rows):
    """The docstring's rules, line by line, without hashes."""
    words = lambda line: [t.decode() for t in WORD.findall(line.encode().lower())]
    need = lambda n: 2 if n >= 50 else 3
    lines = []  # id, text, number, tokens with fields as None, leaf
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = words(line)
            field = [any(c in "0123456789" for c in x) for x in w]
            if w:
                w = tuple(None if f and 2 * sum(field) < len(w) else x for x, f in zip(w, field, strict=True))
                lines.append((i, t, k, w, (len(w), w[:3])))
    texts, in_leaf = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, _, w, leaf in lines:
        texts[w].add(t)
        in_leaf[leaf].add(t)
    at = collections.Counter()
    for w, held in texts.items():
        for k, x in enumerate(w):
            at[len(w), w[:3], k, x] += len(held)
    template, uses = {}, collections.defaultdict(set)
    for w, held in texts.items():
        leaf = (len(w), w[:3])
        if len(in_leaf[leaf]) < need(len(w)):
            continue
        places = [(at[*leaf, k, x], k, x) for k, x in enumerate(w) if x is not None and at[*leaf, k, x] >= need(len(w))]
        least = max(1, math.ceil(0.6 * sum(x is not None for x in w) - 1e-9))
        if len(places) >= least:
            bar = sorted((p[0] for p in places), reverse=True)[least - 1]
            template[w] = (leaf, tuple(p[1:] for p in places if p[0] >= bar))
            uses[template[w]] |= held
    recurs = {u for u, held in uses.items() if len(held) >= need(u[0][0]) and len(held) * u[0][0] >= 60}
    first = {}
    for i, _, k, w, _ in lines:
        u = template.get(w)
        first[u] = min(first.get(u, (True, math.inf, 0)), (i is not None, i or 0, k))
    gone = {(i, t, k) for i, t, k, w, _ in lines if template.get(w) in recurs and first[template[w]] != (i is not None, i or 0, k)}
    return [(i, t if t is None or not any((i, t, k) in gone for k in range(t.count("\n") + 1)) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t, _ in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(rng.integers(0, 9)):
            lines.append(
                pick(
                    f"posted by {pick('ann', 'bob', 'Cy')} in {pick('news', 'sport')} on {rng.integers(1, 30)} may",
                    f"all {pick('rights', 'goods', 'lefts')} are {pick('reserved', 'sold', 'gone')} here {pick('a', 'b', 'c', 'd', 'e', 'f')}",
                    "Read more",
                    pick("Les.", "", "  ", "x1 y2 z3", "x1 y2 z"),
                    " ".join(f"p{'abcdefgh'[(j + s) % 8]}" for s in [rng.integers(0, 40)] for j in range(rng.integers(48, 52))),
                    " ".join(pick("u", "v", "w", "7") for _ in range(rng.integers(1, 8))),
                )
            )
        rows.append((k, "\n".join(lines), "s"))
    rows += [(None, rows[3][1] + "\nRead more", "s"), (500, None, "s"), (501, rows[4][1], "s"), (7, rows[8][1], "s"), (502, "word " * 30_000 + "\nRead more", "s")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(table(spark, rows)).collect()), key=str)
    want = sorted(plain_line_dedup(rows), key=str)
    assert got == want
    assert sum(a != b[:2] for a, b in zip(want, sorted(((i, t) for i, t, _ in rows), key=str), strict=True)) > 50


def test_nearest(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 8)).round(2)
    m[50:120] = m[7]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1.0] * 7), (1020, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    got = inverted_multi_index.search(df, F.col("vec_id") % 20 == 0, recall=1.0).toPandas()
    assert set(got.query_id) == set(range(0, 400, 20))
    hits = 0
    for q, g in got.groupby("query_id"):
        s = m @ m[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s.round(9)))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in g.vec_id.values
        assert np.allclose(g.score, [m[v] @ m[q] for v in g.vec_id])
        hits += len(set(best) & set(g.vec_id))
        copies = [v for v in g.vec_id if v == 7 or 50 <= v < 120]  # copies tie, the smaller ids come first
        assert copies == [v for v in [7, *range(50, 120)] if v != q][: len(copies)]
    assert hits >= 0.9 * 20 * 20
    assert inverted_multi_index.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = inverted_multi_index.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2


def test_nearest_recall_by_default(spark):
    """At the production settings, on clustered vectors, against brute force."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = inverted_multi_index.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 150
    hits = 0
    for q, g in got.groupby("query_id"):
        s = m @ m[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert hits >= 0.9 * 150 * 20


def test_toxicity_counterfactuals():
    texts, toxic = [], []
    for k in range(200):
        texts.append(f"these muslim people are w{k % 20} idiots")
        toxic.append(1)
        texts.append(f"a fine day w{k % 20} for christian walks")
        toxic.append(0)
    neutral = pa.array(["my muslim neighbour plants trees", "my christian neighbour plants trees"])
    free, held = (toxicity.fit(texts, np.array(toxic), penalty=p).score(neutral) for p in (0.0, 50.0))
    assert held[0] - held[1] < 0.3 * (free[0] - free[1])
    assert toxicity.fit(texts, np.array(toxic), penalty=50.0).score(pa.array(["they are idiots", "a fine day"])).round().tolist() == [1, 0]


def test_toxicity(spark, small, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in ROWS if i}
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).count() == len(ROWS)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    import os

    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    got = toxicity.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) & (got.toxic == 1)).sum() >= 0.8 * (got.toxic == 1).sum()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.02 * (got.toxic == 0).sum()


def test_language_model(spark, none):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 13}" for j in range(40)), "s") for k in range(40)] + [(100, None, "s"), (101, "unseen word", "s"), (101, "unseen word", "s"), (102, "W1 w1\tw2", "s")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    got = language_model.score(table(spark, rows), language_model.held_out(F.col("doc_id"))).collect()
    tokens = {(i, t): [*WORD.findall((t or "").encode().lower()), None] for i, t, _ in rows}
    counts = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens[i, t])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, t, _ in rows:
        for r in by_id[i]:
            w = tokens[i, t]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            assert r.score <= 1e-9
    fresh = [r for r in got if r.held_out and r.n_known == r.n_tokens > 10]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    assert language_model.score(none, language_model.held_out(F.col("doc_id"))).count() == 0


def test_language_model_leaves_no_shuffle_files_of_written_steps(spark):
    """By the time the scores are read, the documents and requests that were dealt out are off the disk."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "shuffle_" in f and f.endswith(".data") and os.path.exists(f)}

    before = shuffled()
    rows = [(k, " ".join(f"w{(k * 7919 + j * j) % 100_003}" for j in range(2_000)), "s") for k in range(100)]
    got = language_model.score(table(spark, rows), language_model.held_out(F.col("doc_id")))
    size = sum(len(t) for _, t, _ in rows)
    for _ in range(100):  # files go in the background
        left = sum(os.path.getsize(f) for f in shuffled() - before)
        if left < size / 20:
            break
        time.sleep(0.1)
    assert left < size / 20
    assert got.count() == len(rows)


def test_language_model_by_brute_force(spark, monkeypatch):
    """Scores from plain counts and the learnt shares; the shares against unbinned expectation-maximisation."""
    rng, shares = np.random.default_rng(4), []
    learn = language_model.weights
    monkeypatch.setattr(language_model, "weights", lambda *a: shares.append(learn(*a)) or shares[-1])
    monkeypatch.setattr(language_model, "PART_BYTES", 3_000)  # more blocks of hashes than partitions
    chain = [f"W{k}" for k in range(30)]
    rows = [(k, " ".join(chain[(k + j * (1 + int(rng.integers(0, 2)))) % 30] for j in range(int(rng.integers(0, 60)))), "s") for k in range(120)]
    rows += [(None, "W1 W2 w3", "s"), (None, "nul", "s"), (500, None, "s"), (501, "never met words", "s"), (502, "w5 " * 20_000, "s")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    texts = [(i, [*WORD.findall((t or "").encode().lower()), "end"]) for i, t, _ in rows]
    learnt = [w for i, w in texts if not held(i)]
    one, two = collections.Counter(x for w in learnt for x in w), collections.Counter(p for w in learnt for p in zip(["start", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    context = lambda x: len(learnt) if x == "start" else one[x]
    bucket = lambda c: min(language_model.BUCKETS - 1, c.bit_length()) if c else 0
    got = language_model.score(table(spark, rows), language_model.held_out(F.col("doc_id"))).collect()
    share = shares[0]
    assert np.allclose(share.sum(axis=1), 1) and (share >= 0).all()

    def plain(w):
        total = 0.0
        for a, b in zip(["start", *w], w, strict=False):
            s = share[bucket(context(a))]
            total += math.log10(s[0] * two[a, b] / max(context(a), 1) + s[1] * one[b] / n + s[2] / (v + 1))
        return total

    want = sorted((-1 if i is None else i, round(plain(w), 4)) for i, w in texts)
    assert [(i, pytest.approx(s, abs=1e-3)) for i, s in want] == sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
    # Leave one out: every training bigram is judged by the counts of all others.
    events = collections.defaultdict(list)
    for w in learnt:
        for a, b in zip(["start", *w], w, strict=False):
            events[bucket(context(a) - 1)].append(((two[a, b] - 1) / max(context(a) - 1, 1), (one[b] - 1) / (n - 1), 1 / (v + 1)))
    for k, f in events.items():
        if k and len(f) > 200:
            f, p = np.array(f), np.array([0.5, 0.4, 0.1])
            for _ in range(200):
                part = f * p
                p = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
            assert np.log(f @ share[k]).mean() > np.log(f @ np.maximum(p, 1e-9)).mean() - 0.01
    # The probabilities of all words after a known one, and of one never met, add up to 1.
    s, after = share[bucket(one[b"w5"])], [(two[b"w5", x], one[x]) for x in one]
    assert sum(s[0] * b / one[b"w5"] + s[1] * u / n + s[2] / (v + 1) for b, u in [*after, (0, 0)]) == pytest.approx(1)


def waterfilled(sizes, weights, most=3.0):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(target[k] for k in range(len(sizes)) if k not in free)
        w = sum(weights[k] for k in free)
        over = [k for k in free if rest * weights[k] / w > most * sizes[k]]
        for k in free:
            target[k] = rest * weights[k] / w
        if not over:
            break
        for k in over:
            target[k] = most * sizes[k]
            free.discard(k)
    return target


def test_mixing(spark, docs, none):
    rng, rows = np.random.default_rng(2), []
    names = ["b", "a", "Z", "é", None, "tiny", "zz"]
    for k in range(600):
        s = names[rng.integers(0, 5)] if k % 3 else "b"
        rows.append((k, " ".join(["w"] * int(rng.integers(0, 60))), s))
    rows += [(9000, "w w", "tiny"), (9001, "w " * 3000, "zz"), (9002, "", "a"), (9003, None, "a"), (5, "w w w", "b"), (5, "w w w", "b")]
    df = table(spark, rows)
    got = mixing.mix(df).select("doc_id", F.col("source").alias("of"), mixing.word_count(F.coalesce("text", F.lit(""))).alias("words"), *[F.col(f"mix_{n}").alias(n) for n in ("target", "taken", "source_size")]).toPandas()
    again = mixing.mix(df.repartition(7)).select("doc_id", F.col("mix_taken").alias("taken")).toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, got[["doc_id", "taken"]].values))
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = waterfilled([size[s] for s in order], [k % 3 + 1 for k in range(len(order))])
    for s, t in zip(order, want, strict=True):
        g = got[got.of.isna()] if s is None else got[got.of == s]
        assert g.target.iloc[0] == pytest.approx(t) and g.source_size.iloc[0] == size[s]
        assert 0 <= t - g.taken.sum() < 1.0001
    assert (got.taken <= 3 * got.words).all()
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    taken = mixing.sample(df).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert taken == got.taken.sum()
    assert mixing.mix(docs).count() == len(ROWS)


def test_mixing_keeps_empty_texts(spark):
    rows = [(1, "w " * 900, "a"), (2, "", "a"), (3, None, "a"), (4, " \n", "a"), (5, "w " * 50, "b"), (6, "", "b"), (7, None, "none")]
    df = table(spark, rows)
    reps = {r.doc_id: r.mix_repetitions for r in mixing.mix(df).collect()}
    got = collections.Counter(r.doc_id for r in mixing.sample(df).collect())
    assert reps[2] == 0 and reps[6] > 1
    assert [got[k] for k in (2, 3, 4, 6, 7)] == [1, 1, 1, reps[6], 1]


def test_dom():
    nodes, runs = dom.parse('<html><head><title>T</title></head><body>a<p>b <b>c<br>d<p>e&amp;f</p><script>var x="</p>";</script><!-- > --><ul><li>g<li>h</ul><table><tr><td>i<td>j</table>k<p title="a>b">l')
    assert [(nodes[k].name, t) for k, t in runs] == [("html", "a"), ("p", "b c d"), ("p", "e&f"), ("li", "g"), ("li", "h"), ("td", "i"), ("td", "j"), ("html", "k"), ("p", "l")]
    for odd in ("", "<", "<p", "</p>", "<p><p><p", "a < b", "<script>x", "<textarea>q", "<!--", "<a href='", "<p" * 3000, "<div>" * 3000 + "x"):
        dom.parse(odd)


def test_deep_and_long_pages():
    """Time is linear in depth and length: these would take minutes otherwise."""
    for odd in ("<div>" * 100_000 + "x", "<div>" * 50_000 + "</section>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000 + "x", "<svg>" * 50_000 + "x", "<ul><li>" * 50_000 + "x"):
        _, runs = dom.parse(odd)
        assert [t for _, t in runs] == ["x"]
    deep = "<div>" * 5_000 + "<p>Words of an article, long enough to be taken as such.</p>" + "</div>" * 5_000
    wide = "<article>" + "".join(f"<p>Sentence {k} of an article, long enough to be taken as such.</p>" for k in range(5_000)) + "</article>"
    got = html_extraction.fitted().text([deep, wide, "<p>a</b>b</p>"])
    assert len(got) == 3 and got[1].count("Sentence") == 5_000


def test_html_extraction(spark):
    labelled = html_extraction.labelled_pages(200, seed=77)
    got = html_extraction.fitted().text([h for h, _ in labelled])
    right = [g == " ".join(w) for g, (_, w) in zip(got, labelled, strict=True)]
    assert np.mean(right) > 0.9
    page = '<html><body><nav><a href="/a">Home</a></nav><div class="cookie">We use cookies.</div><article><h1>A title</h1><p>First part, with <b>bold</b> words &amp; more of them.</p><div class="ad">Buy now</div><p>Second   part\nof it is here, and it is long enough.</p></article><div id="comments"><p>Nice post, I liked it.</p></div><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (2, "v", "", 5), (None, "w", "<article><h1>T</h1><p>cut off he", 5)], "page_id long, url string, html string, text int")
    out = [(r.page_id, r.url, r.text, r.n_chars) for r in html_extraction.extract(df).collect()]
    want = "A title First part, with bold words & more of them. Second part of it is here, and it is long enough."
    assert sorted(out, key=str) == sorted([(1, "u", want, len(want)), (2, None, "", 0), (2, "v", "", 0), (None, "w", "T cut off he", 12)], key=str)
    assert html_extraction.extract(df.where("false")).count() == 0


def test_marginals_by_enumeration():
    """Sum-product against the sum over all labellings of a small tree."""
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1])
    kind = np.array([0, 1, 2, 1, 3])
    model = html_extraction.Model(rng.normal(size=len(html_extraction.FEATURES)), rng.normal(size=(8, 2, 2)))
    trees = html_extraction.Forest(parent, np.array([0, 1, 1, 2, 2]), kind, np.arange(5), np.arange(5) * 3)
    content, joint = model.marginals(trees)
    weight = {}
    for y in itertools.product((0, 1), repeat=5):
        s = sum(model.node[3 * k] * y[k] for k in range(5)) + sum(model.edge[kind[k], y[parent[k]], y[k]] for k in range(1, 5))
        weight[y] = math.exp(s)
    z = sum(weight.values())
    for k in range(5):
        assert content[k] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / z)
    assert joint[0, 1, 1] == pytest.approx(sum(w for y, w in weight.items() if y[0] and y[1]) / z)
