"""Vectors, conversations, licenses and the pipeline."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from gridlake.llm import ann, chat, licenses, pii, quality, registry
from tests.llm import brute


def nearest(rows, queries, k):
    out = []
    for q, v in queries:
        found = sorted((-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def test_vectors_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in vectors.collect()]
    got = ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect()
    expected = nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    pairs = {(q, i) for q, _, i, _ in expected}
    assert len(got) == len(expected)
    assert sum((r.query_id, r.vec_id) in pairs for r in got) >= 0.9 * len(pairs)
    by_id = dict(rows)
    for r in got[:50]:
        a, b = by_id[r.query_id], by_id[r.vec_id]
        assert r.score == pytest.approx(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


def test_awkward_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 8), (102, [math.nan] + [1.0] * 7), (103, [None] + [1.0] * 7), (104, [math.inf] * 8), (105, [1.0, 2.0]), (None, [1.0] * 8), (50, rows[50][1]), (200, rows[0][1]), (201, rows[0][1])]
    shape = "vec_id long, embedding array<double>, v int, rank string"
    vectors = spark.createDataFrame([(*x, 1, "z") for x in rows], shape)
    got = [tuple(x) for x in ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()]
    usable = {i: np.array(v) for i, v in rows if i is not None and i not in range(100, 106)}
    expected = nearest(list(usable.items()), [(i, usable[i]) for i in (0, 50, 200)], 5)
    assert [(q, n, i) for q, n, i, _ in got] == [(q, n, i) for q, n, i, _ in expected]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[:3] for x in ann.search(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_pigeonhole_probing_finds_every_code_in_the_radius(spark):
    """Every row within tables * (reach + 1) - 1 bits of a query is fetched, and nothing beyond the radius is left in."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((20, 16))
    x = np.concatenate([c + rng.standard_normal((20, 16)) * rng.uniform(0.01, 0.6) for c in centers])
    index = ann.Index(ann.learn(ann._unit(x), len(x)).turns, 9, tables=10, reach=1, radius=60)
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "h long, g long, v array<double>")
    bits = index.bits(ann._unit(x))
    apart = (bits[:, None, :90] != bits[None, :, :90]).sum(axis=2)
    far = (bits[:, None, : ann.BITS] != bits[None, :, : ann.BITS]).sum(axis=2)
    for verify in (True, False):
        found = {(r.qh, r.h) for r in ann.fetched(rows, rows.where("h < 40"), index, 16, verify=verify).collect()}
        certain = {(q, i) for q in range(40) for i in range(400) if apart[q, i] <= index.pigeonhole() and (far[q, i] <= 60 or not verify)}
        assert len(certain) > 200 and certain <= found
        assert not verify or all(far[q, i] <= 60 for q, i in found)


def test_near_copies_are_fetched_once(spark):
    """And what is fetched is the same set of pairs as of tables compared one by one, with and without tables beyond the codes' bits."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((200, 32)), rng.standard_normal(32) + 1e-6 * rng.standard_normal((50, 32))])
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "h long, g long, v array<double>")
    for tables, width, reach in ((20, 9, 1), (96, 9, 0), (7, 13, 2)):
        index = ann.Index(ann.learn(ann._unit(x), 400).turns[:, : max(ann.BITS, tables * width)], width, tables=tables, reach=reach, radius=ann.BITS)
        bits = index.bits(ann._unit(x))
        tabled = (bits[:, None] != bits[None])[:, :, : tables * width].reshape(250, 250, tables, width).sum(axis=3) <= reach
        got = [(r.qh, r.h) for r in ann.fetched(rows, rows.where("h >= 190 and h < 210"), index, 32).collect()]
        assert set(got) == {(q, i) for q in range(190, 210) for i in range(250) if tabled[q, i].any()}
        assert sum(q >= 200 and i >= 200 for q, i in got) == 10 * 50
        assert len(got) == len(set(got)) or tables * width > ann.BITS


def test_vectors_that_are_all_one_and_more_than_a_block(spark):
    """A third of the rows are one vector, and ties go to smaller ids."""
    same, rng = [1.0, 2.0, 3.0, 4.0], np.random.default_rng(2)
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(4).tolist()) for i in range(3000)]
    got = ann.search(vectors := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vectors.where("vec_id in (0, 3, 2997)")).collect()
    by = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in (0, 3, 2997)}
    assert by == {0: [3, 6, 9, 12, 15], 3: [0, 6, 9, 12, 15], 2997: [0, 3, 6, 9, 12]}
    only = spark.createDataFrame([(i, same) for i in range(50)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(only, only.where("vec_id = 1")).orderBy("rank").collect()] == [0, 2, 3, 4, 5]


def test_template_is_reversible():
    r = random.Random(2)
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "a:b", "x\\", ""]), "".join(r.choice(["#", "##", "###", "\\", "</turn>", "</turn", ">", ":", "\n", "é", "a"]) for _ in range(r.randint(0, 8)))) for _ in range(r.randint(1, 4))]
        text, mask = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in mask) == "".join(t for role, t in turns if role == "assistant")


def test_linear_conversations(spark, sf):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in registry.op9_chat_format(spark, sf).collect()}
    held = {-7: [("user", registry.HOSTILE), ("assistant", registry.HOSTILE)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        held.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    for i, turns in held.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got.pop(i) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), brute.sha(loss))
    assert not got


def paths_by_hand(rows, branches):
    by = {(t, n): (p, role, text, s) for t, n, p, role, text, s in rows}
    parents = {(t, p) for t, n, p, *_ in rows if (t, p) in by}
    out, leaves = set(), {}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at, seen = [], n, set()
        while (t, at) in by and at not in seen:
            seen.add(at)
            path.append(at)
            at = by[t, at][0]
        if (t, at) in by:
            continue  # a circle
        leaves.setdefault(t, []).append((-sum(by[t, x][3] or 0 for x in path), n, path[::-1]))
    for t, found in leaves.items():
        for k, (_, _, path) in enumerate(sorted(found)[:branches]):
            out |= {(t, k + 1, d + 1, by[t, x][1], by[t, x][2]) for d, x in enumerate(path)}
    return out


@pytest.mark.parametrize("branches", [1, 3])
def test_reply_trees(spark, branches):
    r = random.Random(5)
    rows = [(t, n, None if n == 0 else r.randrange(n), r.choice(["user", "assistant"]), f"m{t}.{n}", r.choice([0.0, 1.0, 2.5, None])) for t in range(6) for n in range(r.randint(1, 25))]
    rows += [(9, 1, 2, "user", "circle", 0.0), (9, 2, 1, "user", "circle", 0.0), (9, 3, 77, None, None, 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {tuple(x) for x in chat.reply_paths(df, branches=branches).collect()}
    assert got == paths_by_hand(rows, branches)


def test_conversations_with_nulls_and_repeats(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, "n"), (2, 5, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: (r.n_turns, r.turns, r.loss_text) for r in chat.read_back(chat.conversations(chat.reply_paths(chat.from_turns(df)))).collect()}
    assert got == {None: (2, "user\na\nassistant\n\n", ""), 1: (3, "\nn\nuser\nx\nuser\nx\n", ""), 2: (1, "assistant\nonly\n", "only")}
    assert chat.conversations(chat.reply_paths(chat.from_turns(df.limit(0)))).count() == 0


def cosine(line):
    idf, other, vectors = licenses.weights()
    terms = licenses.terms(line)
    w = {t: terms.count(t) * idf.get(t, other) for t in terms}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return max(((round(sum(w[t] * v.get(t, 0) for t in w) / norm if norm else 0.0, 6), name.removesuffix(" notice")) for name, v in vectors.items()), default=None)


def test_licenses(spark):
    import re

    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "int x;"), ("a/b/c/y.c", "This work is licensed under the GNU General Public License, version 3.\nint y;"), ("a/b/c/COPYING", licenses.TEMPLATES["Apache-2.0"]),
        ("a/b/c/d/z.c", None), ("top.txt", "nothing"), ("q/w.c", "license to thrill"), (None, "Licensed under CC BY-NC 4.0."), ("r/e.c", ""), ("a/b/c/d/z.c", None), ("LICENSE-other/f.c", "no"),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, found string")
    got = {r.id: r for r in licenses.scan(df).collect()}
    for i, (_, text) in enumerate(files):
        lines = [x for x in (text or "").split("\n") if re.search(licenses.CUE, x)]
        best = max((cosine(x) for x in lines), default=(0.0, None))
        assert got[i].own_score == pytest.approx(best[0], abs=2e-6) and got[i].own_license == (best[1] if best[0] >= licenses.LEAST else None)
    assert [(got[i].license, got[i].inherited_from) for i in range(len(files))] == [
        ("MIT", None), ("MIT", "a"), ("GPL-3.0", None), ("Apache-2.0", None), ("Apache-2.0", "a/b/c"), (None, None), (None, None), ("CC-BY-NC-4.0", None), (None, None), ("Apache-2.0", "a/b/c"), (None, None),
    ]
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def near_leads(rows):
    """For each (id, text) the smallest id of its group: SimHashes within 2 bits, or 5-word shingle sets at a Jaccard similarity of 0.8."""
    words = [brute.WORD.findall(t.lower()) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    leads = brute.groups([i for i, _ in rows], [brute.simhash(t) for _, t in rows])
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and leads[a] != leads[b] and len(x & y) / len(x | y) >= 0.8:
                low, high = sorted((leads[a], leads[b]))
                leads = [low if lead == high else lead for lead in leads]
    return leads


def test_pipeline_on_awkward_rows(spark, sf):
    """Nulls, empty and repeated rows, an empty table, and columns with names that stages use: nothing crashes, all columns stay."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, `_id` string, `_spans` string, doc string, row long"
    good = next(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if not brute.base_rules(r.text)[-1] and len(r.text) > 500)
    rows = [(i, t, None, "s", len(t or ""), "a", "b", "c", 1) for i, t in [(1, None), (2, ""), (None, good), (3, good), (3, good), (4, "too short"), (None, None)]]
    for given in (rows, []):
        docs = spark.createDataFrame(given, shape)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), shape)
            assert docs.columns == [x.split()[0].strip("`") for x in shape.split(", ")], name
        assert {r.doc_id for r in docs.collect()} <= {3, None} and docs.count() <= 1
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len(packed) == docs.count()


def test_pipeline_against_its_stages_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns, name
    rows = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}

    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    first = sorted((r.doc_id, r.text) for r in docs.collect() if not brute.base_rules(r.text)[-1] and model.score(r.text.encode()) >= model.threshold)
    second = [(i, t) for (i, t), lead in zip(first, near_leads(first)) if i == lead]
    automaton = pii.anchors()
    expected = {}
    for (i, text), gone in zip(second, brute.covered([t for _, t in second])):
        left = brute.without(text, gone)
        expected[i] = pii.redact(left, pii.find(left, automaton))
    assert rows == {i: (t, len(t)) for i, t in expected.items()}
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in last} == set(rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_near_duplicates_reach_jaccard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    leads = near_leads(rows)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == set(leads) and not {145, 177} & kept


def test_sibling_licenses_are_told_apart(spark):
    lgpl = "/* This library is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Lesser General Public License as published\n * by the Free Software Foundation, either version 3 of the License. */"
    isc = "# Permission to use, copy, modify, and/or distribute this software for\n# any purpose with or without fee is hereby granted, provided that"
    files = [
        ("GNU Lesser General Public License, version 3", "LGPL-3.0"), ("GNU Affero General Public License, version 3", "AGPL-3.0"), ("GNU General Public License, version 3", "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Released under the BSD 2-Clause License.", "BSD-2-Clause"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Released under the ISC License.", "ISC"), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        (lgpl, "LGPL-3.0"), (isc, "ISC"), ("// SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"), ("x\nReleased under the MIT License.\ny\nReleased under the MIT License.", "MIT"),
        ("word " * 20000 + "\nReleased under the MIT License.\n" + "more " * 20000, "MIT"),
    ]
    df = spark.createDataFrame([(i, f"d{i}/f.c", t) for i, (t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.id: r.own_license for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(files))] == [x for _, x in files]


def test_wrapped_headers_and_identifiers(spark):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nint x;"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\nint x;"
    mit = "# Permission is\n# hereby granted, free of charge, to any\n# person obtaining a copy of this\n# software and associated documentation\n# files, to deal\nx = 1"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nx'
    files = [
        ("m/LICENSE", mpl, "MPL-2.0"), ("g/a.c", gpl, "GPL-3.0"), ("t/a.py", mit, "MIT"), ("p/a.py", apache, "Apache-2.0"), ("s/a.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("s/b.c", "/* SPDX-License-Identifier: MPL-2.0 */", "MPL-2.0"), ("s/c.c", "# SPDX-License-Identifier: (GPL-3.0-or-later OR LGPL-2.1)\r\nx", "GPL-3.0"), ("s/d.c", "SPDX-License-Identifier: LGPL-2.1", None),
        ("s/e.c", "a license\nto thrill\nor not", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)] + [(99, "m/b/x.c", "int x;")], "doc_id long, path string, text string")
    got = {r.id: r for r in licenses.scan(df).collect()}
    assert [got[i].own_license for i in range(len(files))] == [x for *_, x in files]
    assert (got[99].license, got[99].inherited_from) == ("MPL-2.0", "m")
