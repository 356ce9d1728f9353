"""Operators against brute force, and on tables with every odd row there is."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.compare import compare
from vigil.llm import decontaminate, embedding_dedup, html_text, licenses, line_dedup, minhash_dedup, packing, quality, queries, repeats, suffix_sort, toxicity
from vigil.llm.components import connected_components
from vigil.llm.logistic import auc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (2, None, None, None, None),
        (3, "", "en", None, 0), (None, "one two three four five six seven", "en", "a", 33), (4, long, "en", "a", len(long)), (5, long, None, "b", -1),
        (6, "alpha beta", "de", "b", 10), (6, "gamma delta\nepsilon", "de", "b", 10), (7, "   \n\n  ", "", "", 1), (8, "\x00\x85 １２ Ünï ß", "xx", "c", 9), (None, None, None, None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    # columns of names that operators use themselves
    return spark.createDataFrame([(*r, 5, "x") for r in odd_rows()], DOCS + ", kept long, component_id string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_tables_have_owners(spark, docs):
    import os

    from vigil.llm import session

    def files():
        home = f"{session.shared_folder(spark)}/vigil/{spark.sparkContext.applicationId}"
        return set(os.listdir(home)) if os.path.isdir(home) else set()

    before = files()
    with session.scratch():
        kept = session.keep(session.stored(minhash_dedup.near_duplicates(docs.where("doc_id < 200")), "kept"))
        repeats.remove_repeats(docs.where("doc_id < 200"), digest=True).count()
        line_dedup.dedup_lines(docs.where("doc_id < 200")).count()
        embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count()
    assert {x.split("-")[0] for x in files() - before} == {"kept"} and kept.count() > 0
    session.drop(kept)
    assert files() == before


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from vigil.llm import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "/shared/"}
    assert session.shared_folder(Session) == "/shared"


def test_heavy_keys_join_as_others(spark, monkeypatch):
    from vigil.llm import session

    monkeypatch.setattr(session, "HEAVY_ROWS", 10)
    monkeypatch.setattr(session, "HEAVY", 20)
    big = spark.createDataFrame([(0 if i % 3 == 0 else i % 40, i) for i in range(900)], "k long, v long")
    small = spark.createDataFrame([(k, k * k) for k in range(0, 40, 2)], "k long, w long")
    counts = big.groupBy("k").agg(toxicity.F.count("*").alias("n"))
    heavy = session.heavy_keys(counts, ["k"], 900)
    assert [r["k"] for r in heavy.collect()] == [0]
    assert sorted(session.spread_join(big, small, ["k"], heavy).collect()) == sorted(big.join(small, "k").collect())


# quality -------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(docs, labels):
    train = labels.where("pmod(xxhash64(doc_id, 9), 3) <> 0")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, train).collect()}
    rest = labels.where("pmod(xxhash64(doc_id, 9), 3) = 0").collect()
    y = np.array([r["quality"] for r in rest])
    assert auc(np.array([got[r["doc_id"]]["quality_score"] for r in rest]), y) > 0.98
    assert np.mean([got[r["doc_id"]]["kept"] for r, q in zip(rest, y, strict=True) if q]) > 0.98
    assert np.mean([got[r["doc_id"]]["kept"] for r, q in zip(rest, y, strict=True) if not q]) < 0.1


def test_quality_on_odd_rows(odd, none, labels, spark):
    few = spark.createDataFrame([(1, 1, None), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(odd, few).collect()
    assert len(rows) == 12 and all(r["quality_score"] == 0.5 and r["kept"] for r in rows)
    assert quality.score_quality(none, labels).count() == 0
    assert quality.keep_good(odd, few).columns == odd.columns




def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = y[:, None] + rng.normal(0, 0.3, (400, 2))
    z = y[:, None] + rng.normal(0, 0.5, (400, 2))
    few = np.arange(400) < 40
    model = quality.co_train(x[few], z[few], y[few], np.arange(40) % 2 == 0, x[~few], z[~few])
    assert ((model(x, z)[0] > 0.5) == y).mean() > 0.95


def test_exchange_beats_the_seed_labels(monkeypatch):
    """Two views of many weak features and few labels: pseudo-labels of the other view make both better."""

    def right(rounds):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        shares = []
        for seed in range(6):
            rng = np.random.default_rng(seed)
            y = rng.integers(0, 2, 5000)
            x, z = (0.9 * y[:, None] + rng.normal(0, 1, (5000, 24)) for _ in range(2))
            few, new = np.arange(5000) < 60, np.arange(5000) >= 3000
            pool = ~few & ~new
            model = quality.co_train(x[few], z[few], y[few], np.arange(60) % 2 == 0, x[pool], z[pool])
            shares.append([((p[new] > 0.5) == y[new]).mean() for p in model(x, z)])
        return np.mean(shares, axis=0)

    without, with_rounds = right(0), right(4)
    assert (with_rounds > without).all() and (1 - with_rounds[0]) < 0.8 * (1 - without[0]), (without, with_rounds)


def test_sources_differ_behind_any_prefix():
    names = ["https://host.example/" + "a" * 100 + c for c in "abcdefgh"]
    rows = quality.page_view([None] * 8, names, [1] * 8)
    assert len({tuple(r) for r in rows}) > 4


# vectors -------------------------------------------------------------------------------------------------------------


def brute_vectors(rows):
    fine = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = collections.defaultdict(set)
    for a in fine:
        for b in fine:
            if a != b and label[a] == label[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.98:
                links[a].add(b)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("block", [1500, 7])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for c in range(25):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 14)):
            rows.append((n, (centre + rng.normal(0, 0.12, 16)).tolist(), int(c % 3)))
            n += 1
    same = rng.standard_normal(16).tolist()
    rows += [(n + i, same, 1) for i in range(20)] + [(n + 20, same, 2), (n + 21, same, None), (n + 22, None, 1), (n + 23, [0.0] * 16, 1), (n + 24, [float("nan")] + same[1:], 1), (n + 25, same[:8], 1), (n + 26, [], 1), (n + 27, [None, *same[1:]], 1), (n + 28, [float("inf"), *same[1:]], 1)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, kept boolean")).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_plans_of_any_size():
    before = 0
    for n in (0, 1, 150, 10**4, 2 * 10**7, 10**9, 10**12):
        g, tables = embedding_dedup.Plan.size(n)
        assert g <= 40 and before <= tables <= 1000
        before = tables
    # against the plain sum of binomials
    import math

    for m, p, recall in ((32, 0.98758, 1 - 1e-6), (10, 0.5, 0.9), (64, 0.9, 0.999)):
        tail = lambda a: sum(math.comb(m, k) * (1 - p) ** k * p ** (m - k) for k in range(a + 1, m + 1))  # noqa: E731, B023
        a = embedding_dedup.allowed_misses(m, p, recall)
        assert tail(a) <= 1 - recall < tail(a - 1)
    assert embedding_dedup.Plan.of(64, 2 * 10**7, 0.98).directions.shape[0] == 64


def test_recall_at_the_threshold():
    """Pairs a little above the threshold, through cells, windows and counts, as for labels of 20,000 vectors: none of 4,000 is missed."""
    rng = np.random.default_rng(8)
    plan = embedding_dedup.Plan.of(64, 20_000, 0.98)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal((4000, 64))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    b = 0.9801 * a + (1 - 0.9801**2) ** 0.5 * off
    (ca, fa, ka), (cb, fb, kb) = plan.project(a), plan.project(b)
    met = (ka == kb) & (np.abs(fa - fb) <= plan.window)
    assert met.any(axis=1).all() and 0.4 < met.mean() < 0.8
    missed = (np.abs(ca.astype(int) - cb) > embedding_dedup.STEPS).sum(axis=1)
    assert (missed <= plan.misses).all() and missed.sum() > 0
    # unrelated vectors seldom pass
    passing = list(plan.collisions(fa[:, 0], ca, np.full(4000, 2)))
    assert sum(len(i) for i, _ in passing) < 4000


def test_vectors_of_all_magnitudes_and_labels(spark):
    one = np.random.default_rng(2).standard_normal(8)
    rows = [(1, (one * 1e300).tolist(), "a"), (2, (one * 1e-300).tolist(), "a"), (3, (one * 3e200).tolist(), "a"), (4, one.tolist(), "b"), (5, (-one).tolist(), "a"), (6, [float("inf")] + [1.0] * 7, "a"), (7, [0.0] * 8, "a"), (8, (one * 2).tolist(), None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def test_many_vectors_with_clusters(spark):
    """Clusters of all sizes among thousands of strangers, with a cell that is dealt out."""
    rng = np.random.default_rng(7)
    rows = [rng.standard_normal(32) for _ in range(3000)]
    centre = rng.standard_normal(32)
    rows += [centre + rng.normal(0, 0.1, 32) for _ in range(700)]
    for _ in range(60):
        c = rng.standard_normal(32)
        rows += [c + rng.normal(0, rng.uniform(0.02, 0.2), 32) for _ in range(rng.integers(2, 9))]
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(rows)]
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(len(rows))}
    assert near.sum() > 1000


def test_vectors_odd(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], kind)
    got = sorted((r["vec_id"] is None, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(rows).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (True, 0, None)]


# lines ---------------------------------------------------------------------------------------------------------------


def plain_chunks(lines):
    """(first line, lines) of chunks, cut by hand: the rank of a place is mixed from the hashes of the line before it and of that line's forerunner."""
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def line_hash(b):
        total = 0
        for j, c in enumerate(b):
            total += (mix((c + 1 + mix(3)) & mask) | 1) * pow(golden, j, 1 << 64)
        return mix((total + len(b) * 0xA0761D6478BD642F) & mask)

    h = [line_hash(x.encode()) for x in lines]
    rank = [mix((h[k] * 3 + (h[k - 1] if k else 1)) & mask) for k in range(len(h))]
    cut = {-1, len(lines) - 1}
    for k in sorted(range(len(lines)), key=lambda k: (rank[k], k)):
        if not cut & {k - 1, k, k + 1}:
            cut.add(k)
    ends = sorted(cut)
    return [(a + 1, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def brute_lines(rows):
    """Removes later chunks of equal bytes, of two lines or more with something on them, one text after another."""
    first, out = {}, {}
    for i, text in sorted(rows.items()):
        lines, gone = text.split("\n"), set()
        if text:
            for a, n in plain_chunks(lines):
                chunk = "\n".join(lines[a : a + n]).encode()
                if n > 1 and chunk.strip(b" \t\n\r\x0b\x0c"):
                    if chunk in first:
                        gone |= set(range(a, a + n))
                    first.setdefault(chunk, i)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_lines_against_brute_force(docs, texts, bits):
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(docs, hash_bits=bits).collect()}
    assert got == brute_lines(texts)


def test_very_common_lines(spark, monkeypatch):
    """A passage in a third of all documents, and documents without an id."""
    from vigil.llm import session

    monkeypatch.setattr(session, "HEAVY_ROWS", 5)
    common = "\n".join(f"common line {k} of the passage" for k in range(4))
    rows = {i: (common + f"\nown {i}\nmore {i}" if i % 3 == 0 else f"own {i}\nother {i}\n" * (i % 4) + f"end {i}") for i in range(120)}
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and sum(n for _, n in got.values()) >= 70
    odd = [(None, common), (-(1 << 63), common), (None, common), (5, common)]
    left = [r["n_removed_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(odd, "doc_id long, text string")).collect()]
    assert sorted(left) in ([0, 0, 4, 4], [0, 4, 4, 4])


def test_line_boundaries_resist_shifts(spark):
    rng = random.Random(2)
    line = lambda: " ".join(str(rng.randrange(1000)) for _ in range(6))
    passage = [line() for _ in range(60)]
    rows = [(i, "\n".join([line() for _ in range(i % 5)] + passage + [line()])) for i in range(6)]
    got = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[i] > 30 for i in range(1, 6))


def test_short_passages_in_differing_surroundings(spark):
    """Passages of 2-8 lines, three times each; no use of the operator's own boundaries."""
    rng = random.Random(6)
    line = lambda: " ".join(str(rng.randrange(1000)) for _ in range(6))
    passages = [[line() for _ in range(2 + k % 7)] for k in range(350)]
    texts = [[line() for _ in range(rng.randint(1, 6))] + p + [line() for _ in range(rng.randint(1, 6))] for p in passages * 3]
    rows = [(i, "\n".join(x)) for i, x in enumerate(texts)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone, there = collections.Counter(), collections.Counter()
    for i, x in enumerate(texts):
        p = passages[i % 350]
        left = set(got[i]["text"].split("\n"))
        assert left >= set(x) - set(p) and (i >= 350 or left == set(x))
        gone[len(p)] += len(p) - len(left & set(p)) if i >= 350 else 0
        there[len(p)] += len(p) if i >= 350 else 0
    share = {n: gone[n] / there[n] for n in there}
    assert share[2] > 0.07 and share[3] > 0.15 and share[5] > 0.35 and share[8] > 0.55


def test_cuts_follow_rank():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        rank, ends, may = rng.integers(0, rng.choice([2, 1000]), n), rng.random(n) < 0.1, rng.random(n) < 0.8
        ends[-1] = True
        want = np.concatenate(([True], ends, [True]))
        for i in np.argsort(rank, kind="stable"):
            if may[i] and not want[i : i + 3].any():
                want[i + 1] = True
        assert (line_dedup._cuts(rank, ends, may) == want[1:-1]).all()


def test_lines_odd(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed_lines"]
    rows = out.collect()
    assert len(rows) == 12 and sum(r["text"] is None for r in rows) == 2
    assert line_dedup.dedup_lines(none).count() == 0


# licences ------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, texts):
    got = {r["doc_id"]: set(r["families"]) for r in licenses.scan_licenses(docs).collect()}
    fixed = {"apache-2.0": "Apache License", "mit": "MIT License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}
    assert got == {i: {f for f, s in fixed.items() if s in t} for i, t in texts.items()}


def test_licenses_odd(spark, none):
    rows = odd_rows() + [(20, "Some text.\nReleased under the MIT License.", "en", "a", 1), (21, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "en", "a", 1), (22, "He has a license to drive and all rights of way.", "en", "a", 1)]
    out = licenses.scan_licenses(spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", families string"))
    nodes = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", nodes)
    got = out.collect()
    assert len(got) == 15
    by = {r["doc_id"]: r for r in got}
    assert by[20]["families"] == ["mit"] and by[21]["families"] == ["apache-2.0"] and by[22]["families"] == [] and by[3]["n_paragraphs"] == 0
    assert licenses.scan_licenses(none).count() == 0


def test_wrapped_licenses(spark, docs):
    import textwrap

    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    prose = ["The river was low and the boats lay on the sand, so that nobody could cross before the evening came.", "It rained for three days after that."]
    rows, want = [], {}
    for k, (family, text) in enumerate((("gpl", gpl), ("mit", mit), ("bsd", bsd), ("apache-2.0", apache))):
        for j, (width, lead) in enumerate(((70, ""), (76, " * "), (80, "# "), (60, "    "))):
            notice = [lead + x for x in textwrap.wrap(text, width)]
            rows.append((10 * k + j, "\n".join(notice if j == 0 else ["/*", *notice, "*/", *prose] if j == 1 else [*prose, "", *notice, "", *prose])))
            want[10 * k + j] = [family]
    rows += [(90, "\n".join(prose)), (91, "He took the software home, with permission\nof the office, and reserved a table."), (92, "Released under the MIT License.\nSee there.\nReleased under the MIT License.")]
    want |= {90: [], 91: [], 92: ["mit"]}
    frame = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs.where("doc_id > 1000").unionByName(frame)).collect()}
    assert {i: got[i]["families"] for i in want} == want
    assert all(got[i]["n_notices"] == len(f) for i, f in want.items() if i < 90) and got[92]["n_notices"] == 2


def test_hints_stand_in_all_templates():
    for t in (t for texts in licenses.TEMPLATES.values() for t in texts):
        w = re.findall("[a-z0-9]+", t.lower())
        runs = {" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}
        assert len(t) < licenses.AROUND - 50 and sum(not re.search(licenses.HINTS, x) for x in runs) < licenses.CONFIRMED * len(runs), t


# pages ---------------------------------------------------------------------------------------------------------------


def test_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for p in pages.collect():
        inner = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", "", re.sub("</?(p|h1|br)[^>]*>", " ", inner))).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_page_parts():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><div id="menu"><a href=x>Home</a></div>
      <div class="cookie-notice">We use cookies.</div><div class="content"><h2>A &amp; B</h2><p>First <b>bo</b>ld&nbsp;text<br>here &lt;3.</p><p>Short.<ul><li>one<li>two</ul><form>Sign <input> up</form>
      <div class="ad">Buy</div><script>if (a < b) { x("</p>") }</script><!-- no <p>comment</p> --></div><div class="sidebar"><p>Other stories, long ones, with commas, and more of it.</p></div>
      <section class="comments"><p>I disagree, sir.</p></section><footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_text(page) == "A & B First bold text here <3. Short. one two"
    plain = "".join(f"<p>Paragraph {i} of the story goes on, with some length, and ends here at last.</p>" for i in range(8))
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(20))
    bare = f"<body><div id=site class=with-sidebar><ul>{links}</ul><div><h2>Heading</h2>{plain}<ul><li>an item of the list, in words</li></ul></div><div class=x><div><span>All rights</span></div></div></div></body>"
    assert html_text.main_text(bare) == "Heading " + re.sub("<[^>]+>", " ", plain).replace("  ", " ").strip() + " an item of the list, in words"
    for empty in (None, "", "<nav>a</nav>", "<p>   </p>", "<!-- x", "<script>alert(1)"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("just text") == "just text"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep"


def test_names_inside_the_article(monkeypatch):
    """A section's name doesn't take it out, an unmistakable one does, and the ratio settles names that say two things."""
    story = "".join(f"<p>Paragraph {i} of the story goes on, with some length, and ends here at last.</p>" for i in range(4))
    said = re.sub("<[^>]+>", " ", story).replace("  ", " ").strip()

    def read(part):
        text = html_text.main_text(f"<body><article>{story}{part}<p>End.</p></article><div class=related>More, of other things, to read.</div></body>")
        assert text.startswith(said) and text.endswith(" End.")
        return text[len(said) : -5].strip()

    for name in ("discussion", "legal-history", "search", "side-effects", "replies-to-critics", "followUp", "legal", "with-comments"):
        for part in (f"<section id={name}><h2>Title</h2><p>Short.</p></section>", f"<div class='{name}'>Title Short.</div>", f"<a class={name} href=x>Title</a> <span class={name}>Short.</span>"):
            assert read(part) == "Title Short.", (name, part)
    assert read("<pre>x <span class=comment>note</span></pre>") == "x note"
    for name in ("comments", "share", "share-buttons", "commentList", "related-posts", "ad ad-slot-3", "newsletter-form", "cookie-notice"):
        assert read(f"<div class='big {name}'><p>Something else, with words, and signs, and more words to fill a line.</p></div>") == "", name
    assert read("<div role=complementary>Aside.</div><aside>Aside.</aside><form>Form</form>") == ""
    priced = "<div class=share-price><h3>Price</h3><p>The price of a share fell, for once, by more than a tenth.</p></div>"
    tools = "<div class=share-price-tools><b>Tweet</b> Pin</div>"
    assert read(priced) == "Price The price of a share fell, for once, by more than a tenth." and read(tools) == ""
    assert html_text.main_text("<article><div class=share-price>Alone</div></article>") == "Alone"
    monkeypatch.setattr(html_text, "DOUBTED", 0.0)
    assert read(tools) == "Tweet Pin"


def test_pages_of_many_paths():
    """One long paragraph and short ones, each with a path of its own: no size loses the short ones."""
    for n in (399, 400, 10_000):
        names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n)]
        texts = ["Long words, all of them. " * 20] + [f"Section {x} has a text of its own, and says a little more in it." for x in names[1:]]
        page = "<body>" + "".join(f"<div id=z{x}><p>{t}</p></div>" for x, t in zip(names, texts, strict=True)) + "</body>"
        assert html_text.main_text(page) == " ".join(t.strip() for t in texts)


def test_smoothing_equals_all_pairs():
    def near(a, b):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        apart = len(a) + len(b) - 2 * same
        return 0.5**apart if apart < 6 else 0.0

    rng = random.Random(3)
    for _ in range(40):
        ratio = {tuple(rng.choice("abc") for _ in range(rng.randint(0, 9))): rng.uniform(1, 3000) for _ in range(rng.randint(1, 120))}
        got = html_text._smoothed(ratio)
        for p in ratio:
            weights = {q: near(p, q) for q in ratio}
            assert got[p] == pytest.approx(sum(w * ratio[q] for q, w in weights.items()) / max(1.0, sum(weights.values()) ** 0.5))


def test_pages_odd(spark):
    kind = "page_id long, url string, html string, text int"
    rows = [(1, None, None, 1), (None, "u", "<p>a b</p>", 1), (2, "u", "", 1), (2, "u", "", 1)]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, "a b", 3), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_text.extract_text(spark.createDataFrame([], kind)).count() == 0


# packing -------------------------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    """Every id in one piece, sequences without gaps, little padding. ``texts``: list of (doc_id, text)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    seqs, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    for i, parts in docs.items():
        if len([k for k in want if k[0] == i]) == 1 and sum(v for k, v in want.items() if k[0] == i) == 1:
            ids = np.array([*tokenizer.encode(dict(texts)[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
    assert sum(r["length"] for r in rows) == sum(k[1] * v for k, v in want.items())


def test_packing(docs, texts):
    check_packing(packing.pack_documents(docs, queries.tokenizer_path()).collect(), list(texts.items()))


def test_packing_odd(odd, none):
    check_packing(packing.pack_documents(odd, queries.tokenizer_path()).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [int(rng.paretovariate(1.1) * 60) for _ in range(800)]
    rows = packing.pack(lengths)
    full = collections.Counter()
    cost = collections.Counter()
    for _, _, n, s, _ in rows:
        full[s] += n
        cost[s] += packing.cost(n)
    assert sum(full.values()) == sum(lengths)
    plain = [c for s, c in cost.items() if full[s] == 4096]
    assert np.std(plain) < 0.35 * np.mean(plain)


def test_word_ids_equal_the_tokenizers(texts):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(queries.tokenizer_path()), packing.WordTokens(queries.tokenizer_path())
    rng = random.Random(2)
    letters = "abÀÁÇÐþÿÜõæ÷×$%-('sé ǅİß1２ ́  \x85\x1c\t\n.,!<|endoftext|>IΣσς가나"
    cases = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(3000)] + ["<|endoftext|> a<|endoftext|>b", ""] + list(texts.values())[:100]
    for x in cases:
        assert np.frombuffer(words.text(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids


# near duplicates -----------------------------------------------------------------------------------------------------


def brute_near(rows, percent=85):
    """(doc_id, text) pairs with different ids -> {id: (set size, component)}."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_family(n, edits, words=220, seed=4):
    """Copies of one text that each differ in a few words, some with edits in common, and strangers."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return rows


@pytest.mark.parametrize(("star", "block"), [(200, 64), (3, 4)])
def test_near_copies_of_copies(spark, monkeypatch, star, block):
    monkeypatch.setattr(minhash_dedup, "STAR", star)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = near_family(120, 9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_near(rows)
    assert got == want
    assert len({c for _, c in want.values()}) > 61


def test_near_duplicates_odd(odd, none):
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == 12
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in by[1]] == [(3, 1, True)] * 2
    assert by[2][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2 and by[3][0]["kept"]
    assert by[4][0]["component_id"] == by[5][0]["component_id"] == 4 and not by[5][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert by[7][0]["n_shingles"] == 0
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_one_of_each_group_stays(spark, odd, none):
    a, b, c = ("a b c d e f g h", "gamma delta epsilon zeta eta theta", "no such words anywhere in here")
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c), (3, a), (None, a), (4, ""), (4, ""), (5, None)]
    kept = minhash_dedup.keep_one(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int"))
    assert kept.columns == ["doc_id", "text", "kept"]
    got = sorted(((r[0], r[1]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, c), (None, a), (4, ""), (4, ""), (5, None)], key=repr)
    unique = [(i, t) for i, t in enumerate([a, b, a, c, "", b])]
    assert sorted(r[0] for r in minhash_dedup.keep_one(spark.createDataFrame(unique, "doc_id long, text string")).collect()) == [0, 1, 3, 4]
    assert minhash_dedup.keep_one(odd).columns == odd.columns and minhash_dedup.keep_one(none).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900, dtype=np.int64).view(np.uint64)
    a, b = np.unique(x[:600]), np.unique(x[200:800])
    s = minhash_dedup.sketch(np.concatenate((a, b, a[:1])), np.repeat([0, 1, 2], [len(a), len(b), 1]), 3, 500)
    assert (s != minhash_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08
    for n in (1, 2, 7):
        one = minhash_dedup.sketch(a[:n], np.zeros(n, dtype=np.int64), 1, 144)
        assert (one != minhash_dedup._EMPTY).all()


# repeats -------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(x[j : j + length] for _, x in raw for j in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = bytearray(len(x))
        for j in range(len(x) - length + 1):
            if seen[x[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def brute_repeats_by_hash(rows, length):
    """As ``brute_repeats``, with strings told apart by a polynomial of their bytes modulo a prime, for whole tables."""
    prime, base = (1 << 61) - 1, 911382323
    top = pow(base, length - 1, prime)
    raw, seen = [(i, (t or "").encode()) for i, t in rows], collections.Counter()
    hashes = []
    for _, x in raw:
        own, h = [], 0
        for j, c in enumerate(x):
            if j >= length:
                h = (h - x[j - length] * top) % prime
            h = (h * base + c) % prime
            if j >= length - 1:
                own.append(h)
        hashes.append(own)
        seen.update(own)
    out = []
    for (i, x), own in zip(raw, hashes, strict=True):
        kept, n, spans, end = [], 0, 0, -1
        starts = [j for j, h in enumerate(own) if seen[h] > 1]
        at = 0
        for j in starts:
            if j > end:
                kept.append(x[at:j])
                spans += 1
                end = at = j
            n += j + length - max(end, j)
            end = at = j + length
        kept.append(x[at:])
        out.append((i, len(x), n, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_over_the_whole_table(spark, docs, texts):
    rows = list(texts.items())
    want = brute_repeats_by_hash(rows, 400)
    assert brute_repeats_by_hash(rows[:60], 400) == brute_repeats(rows[:60], 400)
    assert rows_of(repeats.remove_repeats(docs, digest=True)) == want
    assert sum(r[2] > 0 for r in want) > 100
    # of passages of over 50 words that stand in several documents, only ones under 400 bytes may stay
    places = collections.defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            if len(line.split()) > 50:
                places[line].add(i)
    removed = {r[0]: r[2] for r in want}
    shared = {line: ids for line, ids in places.items() if len(ids) > 1}
    assert len(shared) > 20
    assert all(removed[i] >= 400 for line, ids in shared.items() if len(line.encode()) >= 400 for i in ids)


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_against_brute_force(spark, docs, texts, monkeypatch, hot):
    from vigil.llm import session

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(session, "HEAVY_ROWS", 5)
    some = [(i, t) for i, t in texts.items() if i < 400]
    got = rows_of(repeats.remove_repeats(spark.createDataFrame(some, "doc_id long, text string"), digest=True))
    assert got == brute_repeats(some, 400)


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2000), (3, 3)])
def test_repeats_of_short_strings(spark, monkeypatch, seed, hot):
    """Short lengths, small alphabets, periodic texts: overlaps and self-repeats of all kinds."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GRAM", 5)
    rng = random.Random(seed)
    bits = ["".join(rng.choice("abé") for _ in range(rng.randint(10, 50))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(bits), "x" * rng.randint(1, 30), "ab" * rng.randint(1, 20), str(rng.random())]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(1, rows[1][1]), (1, "other text with the same id"), (None, rows[3][1]), (90, None), (91, "y" * 21), (92, "z" * 20), (93, "\x00" * 25)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    assert rows_of(repeats.remove_repeats(df, 20, digest=True)) == brute_repeats(rows, 20)
    whole = repeats.remove_repeats(df, 20).collect()
    assert all(r["n_removed"] == sum(s["e"] - s["s"] for s in r["spans"]) and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in whole)


def test_repeats_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), digest=True).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for k in range(120):
        letters = rng.choice([b"ab", b"abc", b"\x00\xff", b"abcdefgh"])
        own = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        own += [own[0] * 3, b"a" * 50, b"a" * 30] if k % 3 == 0 else []
        t, _, _ = suffix_sort.join_texts([np.frombuffer(x, dtype=np.uint8) for x in own])
        sa = suffix_sort.suffix_array(t)
        assert sorted(sa) == [i for i in range(len(t)) if t[i]]
        symbols = t.tolist()
        ordered = [symbols[i : symbols.index(0, i)] for i in sa]
        assert ordered == sorted(ordered)


# decontamination -----------------------------------------------------------------------------------------------------


def brute_leaks(rows, items, threshold=0.8):
    def shingles(text):
        w = re.findall(r"[a-z0-9\x80-\xff]+", (text or "").lower().encode().decode("latin1"))
        return w, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    out = []
    for d, text in rows:
        words, have = shingles(text)
        for i, item in items:
            w, own = shingles(item)
            if 0 < len(w) < 5:
                n = 1 if any(words[k : k + len(w)] == w for k in range(len(words) - len(w) + 1)) else 0
            else:
                n = len(own & have) if len(words) >= 5 else 0
            if own and n >= threshold * len(own):
                out.append((d, i, len(own), n))
    return sorted(out, key=repr)


def test_leaks_in_all_shapes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 70)))) for i in range(120)] + [(500, None), (501, ""), (None, "only these six words are here"), (502, "Same, Words! again"), (503, "same words again")]
    rows = []
    for k in range(200):
        w = [word() for _ in range(rng.choice((0, 3, 50, 900)))]
        if k % 2:
            own = items[rng.randrange(120)][1].upper().split()
            if k % 4 == 1 and len(own) > 30:
                own = own[:-4]
            at = rng.randint(0, len(w))
            w = w[:at] + own + w[at:]
        rows.append((k, ", ".join(w) if k % 3 else " ".join(w)))
    rows += [(None, "x SAME words; again y"), (900, None), (901, ""), (950, "only these six words are here"), (950, "only these six words are here")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, containment double")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    want = brute_leaks(rows, items)
    assert got == want
    leaking = {d for d, *_ in want}
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((d for d, _ in rows if d not in leaking), key=repr)
    empty = docs.limit(0)
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_leaks_of_short_items():
    """Hundreds of items of one to twenty-four words, each in a text of its own of 400 more words, some with a word changed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 5, 6, 7, 8, 10, 14, 20, 24) for _ in range(80)]
    rows = []
    for k, item in enumerate(items):
        own, w = item.split(), [word() for _ in range(400)]
        if k % 3 == 0 and len(own) >= 10:
            own = own[:-1] + [word()]
        at = rng.randint(0, 400)
        rows.append((k, " ".join(w[:at] + own + w[at:])))
    index = decontaminate.Index(list(range(len(items))), items)
    import pyarrow as pa

    got = set(index.hits(pa.array([t for _, t in rows]), 0.8))
    have = [set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for _, t in rows]
    want = set()
    for k, item in enumerate(items):
        w = item.split()
        own = set(zip(*[w[j:] for j in range(5)], strict=False))
        n = len(own & have[k]) if len(w) >= 5 else 1
        if n >= 0.8 * max(len(own), 1):
            want.add((k, k, max(len(own), 1), n))
    assert len(want) > 900 and want == {x for x in got if x[0] == x[1]}
    assert all(f" {items[i]} " in f" {rows[row][1]} " for row, i, *_ in got if row != i)


def test_leaks_in_blocks_of_items(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted((r["doc_id"], r["item_id"]) for r in df.collect())
    whole = key(decontaminate.contamination(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert key(decontaminate.contamination(docs, items)) == whole


# toxicity ------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(docs, labels):
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    rest = [r for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    y = np.array([r["toxic"] for r in rest])
    assert auc(np.array([got[r["doc_id"]]["score"] for r in rest]), y) > 0.8
    assert np.mean([got[r["doc_id"]]["predicted"] for r, t in zip(rest, y, strict=True) if not t]) < 0.05


def test_scores_do_not_read_held_out_labels(docs, labels):
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, other))
    assert a == b


def test_restoring(docs):
    restorer = toxicity.Restorer(toxicity.language_model(docs.select("text")))
    for seen, plain in (("st.u-p_i*d", "stupid"), ("l0s3r", "loser"), ("tr@sh", "trash"), ("i d i o t", "idiot"), ("stuuuuupid", "stupid"), ("$cum", "scum"), ("cl0wn", "clown")):
        assert restorer.long(seen) == plain


def test_restoring_long_stretches_and_many_signs(docs):
    restorer = toxicity.Restorer(toxicity.language_model(docs.select("text")))

    def hidden(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        found = toxicity.suspects(data, *toxicity.K.word_spans(data, np.array([0, len(data)])))
        return {w for _, s, e in found for w in restorer.long(text[s:e]).split()}

    assert hidden("say s--t--u--p--i--d twice") == {"stupid"}
    assert hidden("5tup!d 5!|_|y") >= {"stupid"} and len(hidden("5!|y")) == 1
    assert hidden("stup" + "i" * 60 + "d") == {"stupid"}
    for joint in (".", "-", " "):
        assert hidden("so " + joint.join("trashidiot" * 4)) >= {"trash", "idiot"}
    # no place of a long run is a cut
    assert restorer.long(" ".join("idiot" * 40)).replace(" ", "") == "idiot" * 40
    assert all(restorer.long("x " * k + "s t u p i d").endswith("stupid") for k in range(30))


def test_decoder_finds_the_cheapest_path(docs):
    import itertools

    restorer = toxicity.Restorer(toxicity.language_model(docs.select("text")))
    rng = random.Random(5)
    for _ in range(60):
        seen = "".join(rng.choice("aest10|!.- @") for _ in range(rng.randint(1, 8)))
        runs = [sum(1 for _ in itertools.takewhile(lambda c: c == x, reversed(seen[:i]))) for i, x in enumerate(seen)]
        best = {}
        for path in itertools.product(*(restorer._options(c, k) for c, k in zip(seen, runs, strict=True))):
            out = "".join(o for o, _ in path)
            s = [0, 0, *map(toxicity.symbol, out), 0]
            cost = sum(e for _, e in path) + sum(restorer.costs[a][b][c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
            best[out] = min(best.get(out, cost), cost)
        assert best[restorer.long(seen)] == pytest.approx(min(best.values()))


def test_planted_obfuscation_needs_the_decoder(docs, labels, monkeypatch):
    """Clean held-out documents into which hidden insults are put score as toxic; without the decoder they don't."""
    import pyarrow as pa

    model = toxicity.train(docs, labels)
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out()).orderBy("doc_id").limit(60)
    clean = [r["text"] or "" for r in clean.collect()]
    hidden = ["st.u-p_i*d l0s3r", "i d i o t", "s-t-u-p-i-d", "p4th3t1c", "tr@sh", "1d10t", "stuuuupiiiid", "l.o.s.e.r", "cl0wn", "$cum"]
    rng = random.Random(2)
    dirty = [" ".join([*t.split(" ")[:20], *rng.sample(hidden, 5), *t.split(" ")[20:]]) for t in clean]

    def found(texts):
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])
        return np.mean([x for out in toxicity._score(model, 0.7)(iter([batch])) for x in out["predicted"].to_pylist()])

    assert found(clean) < 0.05 and found(dirty) > 0.9
    monkeypatch.setattr(toxicity, "suspects", lambda *_: [])
    assert found(dirty) < 0.1


def test_toxicity_odd(odd, none, spark):
    few = spark.createDataFrame([(1, None, 1), (None, 1, 1), (6, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(odd, few).collect()
    assert len(rows) == 12 and len({r["score"] for r in rows}) == 1
    assert toxicity.score_toxicity(none, few).count() == 0


# pipeline ------------------------------------------------------------------------------------------------------------


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "packing":
            assert kept[-1].columns == columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert np.mean([i in ids[1] for i, q in labels.items() if q]) > 0.98
    lines = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert lines == {i: t for i, (t, _) in brute_lines({r["doc_id"]: r["text"] for r in kept[1].collect()}).items()}
    assert ids[2] == ids[1]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [(r["doc_id"], r["text"]) for r in kept[3].collect()]
    assert ids[4] == ids[3] - {d for d, *_ in brute_leaks(left, items)}
    groups = collections.defaultdict(set)
    for i, (_, c) in brute_near(list(lines.items()), 80).items():
        groups[c].add(i)
    assert ids[3] == set(groups)
    check_packing(kept[5].collect(), [(r["doc_id"], r["text"]) for r in kept[4].collect()])
    again = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in again.select("doc_id").distinct().collect()} == ids[5]
