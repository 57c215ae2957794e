"""Operators on texts against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import core, decontaminate, jaccard, licenses, mixing, queries, repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, body string"


def test_suffix_dedup_matches_brute_force(documents, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_array_dedup(documents, length=40, anchor=16).collect()}
    assert got == suffix_dedup.brute_force({i: (t or "").encode() for i, t in corpus.items()}, 40)


def test_substring_dedup_matches_brute_force(documents, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeated_phrase_dedup(documents, length=20, anchor=8).collect()}
    assert got == substring_dedup.brute_force({i: (t or "").encode() for i, t in corpus.items()}, 20)


@pytest.mark.parametrize("batch", ["3", "4000"])
def test_substring_dedup_repeats_inside_the_later_document(spark, batch):
    """Y P Z Y P Z behind a document with P in another context: both P go, whichever content of a key sorts first."""
    rng = random.Random(21)
    text = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    texts = {}
    for i in range(0, 60, 3):
        p, yz = text(60), (text(30), text(30))
        texts[i] = f"{text(30)} {p} {text(30)}"
        texts[i + 1] = " ".join((yz[0], p, yz[1])) + " " + " ".join((yz[0], p, yz[1])) + (f" {yz[0]} {p} {yz[1]}" if i % 2 else "")
        texts[i + 2] = texts[i + 1] if i % 4 else f"{text(9)} {p} {text(9)} {p}"
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA).repartition(3)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeated_phrase_dedup(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert got == substring_dedup.brute_force({i: t.encode() for i, t in texts.items()})


def test_smallest_id_is_not_null(spark):
    """A doc_id of -2^63 comes back as it is, beside a null one."""
    same = "alpha beta gamma delta " * 30
    df = spark.createDataFrame([(-(2**63), same, ""), (None, "other", ""), (5, same, "")], SCHEMA)
    for out in (suffix_dedup.suffix_array_dedup(df), substring_dedup.repeated_phrase_dedup(df)):
        assert {r.doc_id: r.n_removed > 100 for r in out.collect() if r.doc_id != -(2**63)} == {None: False, 5: True}
        assert {r.doc_id for r in out.collect()} == {-(2**63), None, 5}


@pytest.mark.parametrize("part_bytes", [300, 20_000, 1 << 20])
def test_automata_of_any_part_size(spark, documents, corpus, part_bytes):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeated_phrase_dedup(documents, length=20, anchor=8, part_bytes=part_bytes).collect()}
    assert got == substring_dedup.brute_force({i: (t or "").encode() for i, t in corpus.items()}, 20)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), min_size=1, max_size=6), st.integers(2, 7))
def test_passages_locate_every_occurrence(docs, length):
    """Whole documents as the passages of the documents behind them."""
    texts = {i: " ".join(d).encode() for i, d in enumerate(docs)}
    owners = [i for i in texts if len(docs[i]) >= length]
    automaton = substring_dedup.Passages(owners, [texts[i] for i in owners], length)
    expected = substring_dedup.brute_force(texts, length)
    assert {i: int(automaton.covered(i, t.split()).sum()) for i, t in texts.items()} == {i: x[1] for i, x in expected.items()}


def test_rows_that_repeat_id_and_text_are_one_document(spark, corpus):
    """Two identical rows and no third copy lose nothing; with other documents they lose what one row does."""
    texts = {i: corpus[i] for i in (0, 3, *range(60, 74), 80, 81, 95, 99)} | {200: "one two three four five six seven eight nine ten " * 9, 201: " ".join(f"q{i}" for i in range(150))}
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items() for _ in range(1 + i % 3)], SCHEMA).repartition(4)
    raw = {i: t.encode() for i, t in texts.items()}
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())) for r in suffix_dedup.suffix_array_dedup(df).collect()]
    assert len(got) == sum(1 + i % 3 for i in texts) and set(got) == set(suffix_dedup.brute_force(raw).items())
    got = [(r.doc_id, (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())) for r in substring_dedup.repeated_phrase_dedup(df, length=20).collect()]
    assert len(got) == sum(1 + i % 3 for i in texts) and set(got) == set(substring_dedup.brute_force(raw, 20).items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=40), min_size=1, max_size=9), st.integers(3, 9))
def test_merged_intervals_find_every_repeat(texts, length):
    raw = [t.encode() for t in texts]
    n = len(raw)
    from rasterloom.llm import repeats

    parts = [[i for i in range(n) if i % 3 == k] for k in range(3) if k < n]
    shards = [suffix_dedup.Shard([raw[i] for i in part], length) for part in parts]
    pieces = [(np.array(part), np.zeros(len(part), dtype=np.int64), np.array([max(0, len(raw[i]) - length + 1) for i in part], dtype=np.int64)) for part in parts]
    did, _, loc = suffix_dedup.later_runs(shards, pieces, length)
    found: dict[int, list[int]] = {}
    for d, x in zip(did.tolist(), loc.tolist()):
        found.setdefault(d, []).append(x)
    expected = suffix_dedup.brute_force(dict(enumerate(raw)), length)
    for i, t in enumerate(raw):
        assert int(repeats.covered(len(t), found.get(i), length).sum()) == expected[i][1]


def test_shard_transform_is_the_sorted_rotation():
    text = np.frombuffer(b"banana\x00bandana\x00ana\x00", dtype=np.uint8)
    sa, transform = suffix_dedup.shard_transform(text)
    def key(i):
        end = bytes(text[i:]).index(0)
        return bytes(text[i : i + end]), i + end
    assert sa.tolist() == sorted(range(len(text)), key=key)
    assert (transform == text[sa - 1]).all()


def test_long_texts_are_sliced(monkeypatch):
    from rasterloom.llm import repeats

    rng = np.random.default_rng(3)
    t = bytes(rng.integers(97, 100, 5000).astype(np.uint8))
    whole = repeats.piece_runs(*repeats.byte_symbols([t[:2000], t[2000:]]), 30, 8)
    monkeypatch.setattr(repeats, "SLICE", 700)
    parts = repeats.piece_runs(*repeats.byte_symbols([t[:2000], t[2000:]]), 30, 8)
    cover = lambda x: {(int(k), int(d), s) for k, _, d, lo, hi, _ in zip(*x) for s in range(lo, hi + 1)}
    assert cover(whole) == cover(parts)


def test_dedup_edges(spark):
    same = "alpha beta gamma delta " * 10
    rows = [(1, same, "x"), (1, same, "y"), (None, same, "z"), (2, None, ""), (3, "", ""), (4, same, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.suffix_array_dedup(df).collect())
    # the null id is the first; the repeated row counts once and both its rows are returned alike
    full = [x for x in got if x[1] in (1, 4)]
    assert len(got) == 6 and all(x[2] == len(same) for x in full) and [x for x in got if x[0]][0][2] < len(same)
    words = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.repeated_phrase_dedup(df, length=20).collect())
    assert [x for x in words if x[1] == 4][0][3] == 40 and [x for x in words if x[0]][0][3] == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_array_dedup(empty).count() == 0
    assert substring_dedup.repeated_phrase_dedup(empty).count() == 0


def _licenses(df, **kw):
    out = {}
    for r in licenses.license_scan(df, **kw).collect():
        blocks = sorted((b.label, b.first_word, b.share) for b in r.blocks)
        out[r.doc_id] = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, blocks)
    return out


#: Headers as they stand in source files: wrapped at 80 columns, with comment marks.
MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is ...
 */"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License"); you may not
// use this file except in compliance with the License. You may obtain a copy of
// the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
// WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """   This program is free software: you can redistribute it and/or modify it
   under the terms of the GNU General Public License as published by the Free
   Software Foundation, either version 3 of the License, or any later version."""


def test_license_scan(spark, documents, corpus):
    notices = {0: "GNU General Public License\nGNU general public LICENSE", 1: "Licensed%%% under&&& the&&& Apache*** License, Version 2.0.", 2: "x\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions hold", 3: "mit dem license", 4: None, 5: ""}
    notices |= {6: MIT, 7: BSD, 8: APACHE, 9: GPL, 10: "word " * 3000 + MIT.replace("\n", " ") + " word" * 3000 + BSD, 11: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."}
    df = spark.createDataFrame([(i, t, "") for i, t in notices.items()] + [(7, BSD, "again")], SCHEMA)
    got = _licenses(df)
    assert got == {i: licenses.brute_force(t) for i, t in notices.items()}
    assert got[0][1] == 2 and "apache" in got[1][4] and "bsd-notice" in got[2][5] and got[3][5] == "" and got[4] == (0, 0, None, None, "", "", 0.0, [])
    assert got[6][5] == "mit-grant,mit-notice" and got[7][5] == "bsd-notice" and got[8][5] == "apache,apache-2.0,apache-notice,apache-terms" and "gpl-notice" in got[9][5]
    assert got[10][5] == "bsd-notice,mit-grant,mit-notice" and got[11][5] == "cc-by-nc-4.0" and {b[0] for b in got[11][7]} >= {"cc-by-4.0", "cc-by-nc-4.0"}
    assert _licenses(documents) == {i: licenses.brute_force(t) for i, t in corpus.items()}
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_threshold_is_a_containment(spark):
    """Shares of a template, spread over longer and longer stretches, and words of one notice in a text without breaks."""
    rng = random.Random(1)
    templates = dict(licenses.TEMPLATES)
    texts = {}
    for label in ("bsd-notice", "mit-notice", "cc-by-4.0"):
        base = templates[label].split()
        for k in range(4, len(base) + 1):
            w = rng.sample(base, k)
            texts[len(texts)] = " ".join(w + ["filler"] * k)
            for _ in range(rng.randint(0, len(base) // 2)):
                w.insert(rng.randrange(len(w)), "filler")
            texts[len(texts)] = " ".join(w)
    every = " ".join(t for _, t in licenses.TEMPLATES).split()
    for i in range(20):
        texts[1000 + i] = " ".join(rng.choice(every) for _ in range(400))
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA).repartition(3)
    for threshold in (0.8, 0.5):
        assert _licenses(df, threshold=threshold) == {i: licenses.brute_force(t, threshold=threshold) for i, t in texts.items()}


def test_shard_transform_sorts_every_suffix_and_moves_only_what_is_tied(monkeypatch):
    """Against sorted slices; strings that repeat and strings that do not, beside one another."""
    rng = random.Random(4)
    passage = bytes(rng.randrange(1, 250) for _ in range(200))
    for parts in ([b""], [b"a"], [b"ab"] * 5, [bytes(rng.choice(b"abc") for _ in range(rng.randrange(40))) for _ in range(60)], [passage] * 3 + [bytes(rng.randrange(1, 250) for _ in range(6000))]):
        text = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
        ends = np.flatnonzero(text == 0)
        # a sentinel is smaller than any symbol and counts by its position
        suffix = [(*(int(x) + len(text) for x in text[i:e]), int(e)) for i, e in ((i, ends[np.searchsorted(ends, i)]) for i in range(len(text)))]
        moved = []
        monkeypatch.setattr(suffix_dedup, "sorted_by", lambda key, bits, n, f=suffix_dedup.sorted_by: moved.append(n) or f(key, bits, n))
        sa, transform = suffix_dedup.shard_transform(text)
        monkeypatch.undo()
        assert sa.tolist() == sorted(range(len(text)), key=suffix.__getitem__)
        assert (transform == text[sa - 1]).all()
    assert max(moved[1:]) < 700 < moved[0]  # the passages alone
    key = np.array([rng.randrange(1 << 60) for _ in range(500)], dtype=np.uint64) >> np.uint64(56)
    for bits in (8, 60):  # place and key in one number, and apart
        got, by = suffix_dedup.sorted_by(key, bits, len(key))
        assert (by == np.argsort(key, kind="stable")).all() and (got == key[by]).all()


def test_windows_are_hashed_in_small_chunks(spark, monkeypatch):
    """Arrays of eight bytes a symbol and more stay small, however many documents a batch holds."""
    seen = []
    symbols = lambda texts: seen.append(sum(map(len, texts))) or repeats.byte_symbols(texts)
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(500)) for _ in range(120)]
    rows = repeats.prepared(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA), "doc_id", "text")
    scans = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, schema: scans.append(f) or df)
    repeats.pieces(rows, symbols, 100, 32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), type=pa.int64()), pa.array([0] * 120, type=pa.int32()), pa.array(texts)], ["did", "tie", "body"])
    assert sum(x.num_rows for x in scans[0](iter([batch]))) and sum(seen) == sum(map(len, texts)) > 1 << 20 and max(seen) <= 1 << 18


def test_license_query_names_every_notice_at_the_threshold(spark, tmp_path):
    """Notices that differ in a word or two stand on one another's blocks: each that holds is a pair of the join."""
    templates = dict(licenses.TEMPLATES)
    texts = {i: t for i, t in enumerate(templates.values())}
    texts |= {100: "a " + templates["cc-by-nc-4.0"] + " mit license", 101: "nothing of the kind", 102: None}
    spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, str(tmp_path)).collect()}
    left_out = 0
    for i, t in texts.items():
        *_, base, clearest, _, blocks = licenses.brute_force(t)
        every = {b[0] for b in blocks} | set(filter(None, base.split(",")))
        assert got[i].labels == ",".join(sorted(every)) and got[i].clearest_labels == clearest and got[i].base_labels == base
        left_out += got[i].labels != clearest
    assert left_out and got[100].labels == "cc-by-4.0,cc-by-nc-4.0,cc-by-sa-4.0,mit" and got[101].labels == got[102].labels == ""


def _near_texts():
    rng = random.Random(11)
    words = [f"v{i}" for i in range(300)]
    texts: dict[int, str | None] = {}
    for size in (3, 5, 6, 7, 8, 9, 12, 20, 33, 60, 140):
        base = [rng.choice(words) for _ in range(size + 3)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(words)], [w[k], rng.choice(words)]])
            if rng.random() < 0.3:
                w += [rng.choice(words) for _ in range(rng.randint(1, max(1, size // 8)))]
            texts[len(texts)] = " ".join(w)
    return texts | {900: "", 901: None, 902: "one", 903: "ONE", 904: "one two", 905: "one two"}


def test_jaccard_classes_match_all_pairs(spark, documents, corpus):
    texts = _near_texts()
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()}
    assert got == jaccard.brute_force(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(documents).collect()}
    assert got == jaccard.brute_force(corpus)


def _mostly_shared(n):
    """Texts that share three quarters of their words in one run, and so signatures, but link only with every tenth one's near copy."""
    rng = random.Random(29)
    words = lambda k: [f"q{rng.randrange(10**9)}" for _ in range(k)]
    most, texts = words(120), {}
    for i in range(n):
        own = words(40)
        texts[len(texts)] = most + own
        if i % 10 == 0:
            texts[len(texts)] = most + own[:-2] + words(2)
    return {i: " ".join(w) for i, w in texts.items()}


def test_jaccard_joins_do_not_multiply_buckets(spark, monkeypatch):
    """No join makes more rows than the buckets have, also where a large group of sets shares many signatures without linking."""
    texts = _mostly_shared(100)
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA).repartition(4)
    rows, made = [], []
    monkeypatch.setattr(jaccard, "CANOPY", 16, raising=False)
    monkeypatch.setattr(core, "discard", lambda df: None)
    monkeypatch.setattr(jaccard, "_buckets", lambda found, f=jaccard._buckets: rows.append(out := core.checkpointed(f(found))) or out)
    monkeypatch.setattr(type(df), "join", lambda self, *a, f=type(df).join, **b: made.append(out := f(self, *a, **b)) or out)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()}
    assert got == jaccard.brute_force(texts) and len({root for _, root in got.values()}) == 100
    buckets = rows[0].count()
    assert buckets > 4 * len(texts) and max(x.count() for x in made) <= buckets


@pytest.mark.parametrize("block, alone", [(7, 0), (4096, 1 << 20)])
def test_jaccard_classes_in_blocks_and_rounds(spark, monkeypatch, block, alone):
    """Groups dealt into blocks, and components by rounds or in one task, give the same classes."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ALONE", alone)
    texts = _mostly_shared(40) | {1000 + i: t for i, t in _near_texts().items()}
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA).repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()} == jaccard.brute_force(texts)


def test_jaccard_other_thresholds(spark):
    texts = _near_texts()
    df = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, n=2, num=7, den=10).collect()}
    assert got == jaccard.brute_force(texts, 2, 7, 10)


def test_pipeline_drops_copies_from_four_fifths(spark):
    """Copies with a five-word Jaccard of 0.811 go, those of 0.772 stay."""
    import corpus_pipeline

    rng = random.Random(17)
    words = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for i in range(0, 30, 3):
        base = words(1000)
        at = rng.randrange(100, 800)
        texts[i], texts[i + 1], texts[i + 2] = base, base[:at] + words(100) + base[at + 100 :], base[:at] + words(125) + base[at + 125 :]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == {i for i in texts if i % 3 != 1}


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e", ""), (5, "a b c d e", ""), (5, "p q r s t", ""), (9, "P q r s t", ""), (7, None, "")], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, None), (5, 2, None), (5, 2, 5), (9, 2, 5), (7, 0, 7)], key=repr)
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 12, 30, 100, 400])
def test_pigeonhole_plan_never_loses_a_link(size):
    """Every linked pair of random sets shares a signature."""
    rng = np.random.default_rng(size)
    plan = jaccard.Plan({s: 50 for s in range(1, 500)}, 85, 100)
    for _ in range(40):
        a = rng.integers(0, 1 << 63, size).astype(core.U64)
        b = np.unique(np.concatenate((a[rng.permutation(size)[: size - rng.integers(0, size // 12 + 1)]], rng.integers(0, 1 << 63, rng.integers(0, size // 12 + 1)).astype(core.U64))))
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 85 * (len(a) + len(b) - shared) or (len(a) == len(b) == shared):
            continue
        doc = np.repeat([0, 1], [len(a), len(b)])
        d, s = jaccard.signatures(plan, doc, np.concatenate((a, b)), np.array([len(a), len(b)]))
        assert set(s[d == 0].tolist()) & set(s[d == 1].tolist())


def test_sketches_never_overestimate():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(core.U64))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(core.U64))))
        if not len(b):
            continue
        x, y = (np.frombuffer(jaccard.sketches(np.zeros(len(v), dtype=int), v, np.array([0]))[0], dtype=core.U64)[None] for v in (a, b))
        n = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard._folded(x, n) ^ jaccard._folded(y, n)).sum() <= len(np.setxor1d(a, b))


def _items(corpus):
    words = corpus[7].split()
    return {1: corpus[60][-300:], 2: " ".join(words[:13]), 3: " ".join(words[2:5]), 4: None, 5: "", 6: "not in any document at all, never seen anywhere here or there again", 7: corpus[8].upper()}


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination(spark, documents, corpus, block):
    items = _items(corpus)
    bench = spark.createDataFrame([(i, t) for i, t in items.items()] + [(2, items[2]), (None, "the on er")], "item_id long, text string")
    out = decontaminate.benchmark_decontamination(documents, bench, block_bytes=block)
    got = {r.did: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()}
    assert got == decontaminate.brute_force(corpus, items)


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", ""), (None, "a b c", ""), (2, None, ""), (1, "a b c", "")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.benchmark_decontamination(docs, none).collect()] == [0] * 4
    bench = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    assert sorted(r.n_hit for r in decontaminate.benchmark_decontamination(docs, bench).collect()) == [0, 2, 2, 2]
    assert decontaminate.benchmark_decontamination(docs.limit(0), bench).count() == 0


def _mix(df, **kw):
    return {(r.doc_id, r.size): r for r in mixing.mix_sources(df, **kw).collect()}


@pytest.mark.parametrize("packet", [1, mixing.PACKET])
def test_mixing_targets_and_caps(documents, corpus, packet):
    got = _mix(documents, packet=packet)
    assert len(got) == len(corpus)
    total = sum(r.size for r in got.values())
    by = {}
    for r in got.values():
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * total)
    assert sum(r.taken for r in got.values()) == int(1.5 * total)
    for rs in by.values():
        assert rs[0].target <= 2 * rs[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= packet
    assert {k: r.taken for k, r in got.items()} == {k: r.taken for k, r in _mix(documents.repartition(7), packet=packet).items()}


@pytest.mark.parametrize("share, cap", [(1.5, 2.0), (0.5, 1.0), (1.25, 1.5)])
def test_mixing_is_the_order_of_finish_times(spark, share, cap):
    """Against packets sent one after the other from a heap of queues; a long text, ties and clashing columns among them."""
    import heapq

    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 3, 40, 300]), f"s{i % 5 % 4}", 9, 9.0, 9) for i in range(60)] + [(60, "w " * 5000, None, 1, 1.0, 1), (60, "w " * 5000, "s1", 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, finish double, start long")
    got = mixing.mix_sources(df, share=share, cap=cap, packet=16).collect()
    queues = {}
    for r in sorted(got, key=lambda r: r.start):
        queues.setdefault(r.source, []).append(r)
    taken, heap = {}, []
    for source, q in queues.items():
        packets = [(n, r, a, min(a + 16, r.size)) for n in range(2) for r in q for a in range(0, r.size, 16) if n * r.source_size + r.start + a < int(cap * r.source_size)]
        if packets:
            packets = [(n, r, a, min(b, int(cap * r.source_size) - n * r.source_size - r.start)) for n, r, a, b in packets]
            heapq.heappush(heap, ((packets[0][0] * packets[0][1].source_size + packets[0][1].start + packets[0][3]) / packets[0][1].target, source is None, source or "", 0, id(packets), packets))
    left = int(share * sum(r.size for r in got))
    while heap and left:
        _, last, source, k, key, packets = heapq.heappop(heap)
        _, r, a, b = packets[k]
        words = min(b - a, left)
        left -= words
        taken[r.source, r.doc_id] = taken.get((r.source, r.doc_id), 0) + words
        if k + 1 < len(packets):
            n, r, a, b = packets[k + 1]
            heapq.heappush(heap, ((n * r.source_size + r.start + b) / r.target, last, source, k + 1, key, packets))
    assert {(r.source, r.doc_id): r.taken for r in got if r.taken} == taken


def test_mixing_reshares_what_small_sources_cannot_take(spark):
    rows = [(i, "a b c d e f g h i j", s) for i, s in enumerate(["a"] * 1 + ["b"] * 40 + ["c"] * 40 + [None] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r.source: r.target for r in mixing.mix_sources(df).collect()}
    # weights 3, 1, 2, 3: a and the null source are capped at twice their size, b and c share the rest 1 to 2 up to c's cap
    budget = 1.5 * 860
    assert targets["a"] == 20 and targets[None] == 100
    assert sum(targets.values()) == pytest.approx(budget)
    assert targets["c"] == pytest.approx(min(800, 2 * targets["b"]))


def test_sets_without_anything_in_common_share_few_signatures():
    """Empty segments of long sets are no hot signatures, and sets that link still share one."""
    rng = np.random.default_rng(6)
    n, num, den = 600, 4, 5
    sizes = rng.integers(334, 560, n)
    plan = jaccard.Plan({int(x): 60 for x in range(334, 560)}, num, den)
    base = [np.sort(rng.integers(0, 1 << 63, x).astype(np.uint64) * np.uint64(2)) for x in sizes]
    near = []  # a tenth of the elements replaced: Jaccard 0.818 or a little more
    for x in base[:60]:
        y = x.copy()
        y[rng.choice(len(y), len(y) // 10, replace=False)] = rng.integers(0, 1 << 63, len(y) // 10).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        near.append(np.sort(y))
    every = base + near
    doc, value = np.repeat(np.arange(len(every)), [len(x) for x in every]), np.concatenate(every)
    d, sig = jaccard.signatures(plan, doc, value, np.array([len(x) for x in every]))
    of = [set(sig[d == i].tolist()) for i in range(len(every))]
    for i, x in enumerate(near):
        shared = len(np.intersect1d(base[i], x))
        assert den * shared >= num * (len(base[i]) + len(x) - shared) and of[i] & of[n + i]
    rows = np.unique(np.stack((sig[d < n].view(np.int64), d[d < n])), axis=1)
    assert np.unique(rows[0], return_counts=True)[1].max() < 5 and len(d) < 250 * (n + 60)


def test_kept_columns_take_no_part_in_the_mix(spark, monkeypatch):
    """Written tables hold no texts; equal rows each have a place of their own; a null is not the value beside it."""
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))) + f" {i}", f"s{i % 3}", "en") for i in range(60)]
    rows += [rows[7]] * 4 + [(None, "a b", None, "de"), (None, "a b", None, None), (None, None, "s1", "x"), (61, None, None, None), (61, "", None, None), (61, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    written = []
    monkeypatch.setattr(mixing.core, "checkpointed", lambda d, f=core.checkpointed: written.append(d.columns) or f(d))
    got = mixing.mix_sources(df, keep=("text", "lang")).collect()
    assert written and not any("text" in c or "lang" in c for columns in written for c in columns)
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.text, r.source, r.lang) for r in got) == order(rows)
    assert all(r.size == len((r.text or "").split()) for r in got)
    plain = mixing.mix_sources(df).collect()
    assert order((r.doc_id, r.size, r.source, r.target, r.taken, r.start, r.finish) for r in got) == order((r.doc_id, r.size, r.source, r.target, r.taken, r.start, r.finish) for r in plain)
    assert len({r.start for r in got if r.doc_id == 7}) == 5


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (1, "", None), (None, " \n", "a"), (2, "one two", None), (2, "one two", None)], schema)
    got = sorted((r.source or "", r.size, r.taken) for r in mixing.mix_sources(df).collect())
    assert len(got) == 5 and sum(x[2] for x in got) == 6 and all(t <= 2 * s for _, s, t in got)
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, "b")], schema)
    assert [r.taken for r in mixing.mix_sources(nothing).collect()] == [0, 0]


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    """Every stage on what the one before kept: nulls, empty and long texts, repeated rows, ties and clashing columns."""
    import corpus_pipeline

    rng = random.Random(23)
    item = " ".join(f"bench{i}" for i in range(40))
    secret = "password=b7db7aa4a5fcc78305"
    texts = dict(corpus) | {300 + i: " ".join(rng.choice(["XX!!", "YY!!", "ZZ!!"]) for _ in range(60)) for i in range(15)}
    texts |= {400: f"{corpus[1]} {item} {corpus[2]}"} | {410 + i: f"{corpus[20 + i]} {corpus[30 + i]} {secret} {corpus[40 + i]}" for i in range(5)} | {402: " ".join(corpus[i] for i in range(60)) * 3}
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, "x") for i, t in texts.items()] + [(1, corpus[1], "en", "s1", 1, 1, "x"), (None, f"{corpus[11]} {corpus[13]} {corpus[17]}", None, None, None, 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string"
    spark.createDataFrame([(i, int(i < 300 or i >= 400), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {(r.doc_id, r.text) for r in docs.collect()}
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        empty = stage(spark, before.limit(0), str(tmp_path))
        assert empty.count() == 0
    ids = {name: {i for i, _ in rs} for name, rs in kept.items()}
    good = ids["quality classifier"]
    assert sum(i in good for i in corpus) >= 0.95 * len(corpus) and not any(i in good for i in range(300, 315)) and None in good
    entered = {i: t for i, t in kept["quality classifier"] if i is not None}
    roots = {i for i, (_, root) in jaccard.brute_force(entered, 5, 4, 5).items() if i == root}
    assert ids["n-gram Jaccard join"] - {None} == roots
    clean = decontaminate.brute_force({i: t for i, t in kept["n-gram Jaccard join"] if i is not None}, {1: item})
    assert ids["benchmark decontamination"] - {None} == {i for i, x in clean.items() if not x[4]} and 400 not in ids["benchmark decontamination"]
    masked = dict(kept["secret scans"])
    assert set(masked) & set(range(410, 415)) and all(masked[i] == (t or "").replace(secret.split("=")[1], "[SECRET]") for i, t in texts.items() if i in masked and t)
    last = docs.collect()
    assert kept["mixing sources to target weights"] == kept["secret scans"] and sum(r.taken for r in last) == int(1.5 * sum(r.size for r in last))
