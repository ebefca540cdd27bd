"""Each operator on hand-made rows, against brute force or the vocabulary's own library, with nulls, repeats and clashing names."""

import argparse
import collections
import decimal
import doctest
import hashlib
import inspect
import random
import re
import textwrap
import typing

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from patternloom.llm import bpe, chat, components, decontaminate, licenses, neighbours, quality, secrets, simhash, suffixes, url_filter

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "a", None, "Hello world, it's 2024!\n\n  don't  'll", "ÀÉ ñ ß 東京 🙂 x", "a" * 5000, "\t\x0b x\r\n", "tail   "]


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "n": F.lit(1), "spans": F.lit("x"), "fp": F.lit(0), "code": F.lit(2)})


def test_bpe_equals_the_library_and_decodes(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    table = docs(spark, TEXTS)
    got = {r.doc_id: list(r.token_ids) for r in bpe.encode(table, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(table, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in bpe.round_trip(table, PATH, public_tokenizers.PATTERN).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, got[r.doc_id])).encode()).hexdigest()
    assert bpe.encode(table.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_stays_bounded():
    small, large = (bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN, most) for most in (50, 10**6))
    for i in range(60):
        text = " ".join(f"word{j}x common{j % 7}" for j in range(i, i + 20))
        assert small.encode(text) == large.encode(text)
        assert len(small.cache) <= 50 + 2 * len(text.split()) and len(small.old) <= 50 + 2 * len(text.split())


def test_bpe_cache_is_not_walked_for_a_text():
    class Old(dict):
        def __iter__(self):
            raise AssertionError("all old pre-tokens are walked")

    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    ids = codec.encode("common words in old texts")
    codec.cache, codec.old = {}, Old(codec.cache)
    assert codec.encode("common words in old texts") == ids and "common" in codec.cache
    assert codec.decode(codec.encode("common words in newer texts")) == b"common words in newer texts"


def test_bpe_of_long_texts_leaves_in_runs(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 3)
    column = pa.array(["a b", None, "", "a b c d", "e"])
    assert list(bpe._runs(column, lambda t: (t or "").split())) == [(0, [["a", "b"], [], [], ["a", "b", "c", "d"]]), (4, [["e"]])]
    texts = ["one two three " * 200_000, None, "", "four", "one two three " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: r.decoded.decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_of_random_texts():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    codec, r = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN), random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab e's \n\tÉ9₂ 東🙂.,'  \x1c") for _ in range(r.randint(0, 60)))
        assert codec.encode(text) == library.encode_ordinary(text), text


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert table.find(keys) == list(range(5000)) and table.find([b"", b"x", b"k5001"]) == [-1, -1, -1]
    assert sorted(table.key_at.tolist()) == list(range(5000))


def test_secrets_base_spans_follow_the_patterns(spark):
    texts = ["TOKEN = 'abcdefghijkl' x", "secret=token:abcdefghijklmnop", "toKen: abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIAX", "0123456789abcdef0 0123", None, "", "api_key==abcdefghijklm"]
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan_digests(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), m.end(), 0) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, _, k in spans) for i in range(3))


def test_grammar_tells_held_out_credentials_from_words(spark):
    grammar = secrets.Grammar(secrets.labelled_credentials(seed=1))
    held = secrets.labelled_credentials(n=80, seed=99)
    long = [(f, t) for f, t in held if len(t) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_.=-]+", t)]
    _, lift = grammar.score([t for _, t in long])
    caught = [x > secrets.MARGIN for (f, _), x in zip(long, lift, strict=True) if f not in (secrets.PLAIN, "access")]
    false = [x > secrets.MARGIN for (f, _), x in zip(long, lift, strict=True) if f == secrets.PLAIN]
    assert np.mean(caught) > 0.97 and np.mean(false) < 0.01
    text = "key ghp_16C7e42F292c6912E7710c838347Ae178B4a and token = 0123456789abcdef0123 end"
    clean = secrets.redact(docs(spark, [text, None])).orderBy("doc_id").collect()
    assert clean[0].text == "key [SECRET] and [SECRET] end" and clean[1].text is None and clean[0].source == "s"


@pytest.fixture(scope="module")
def grammar():
    return secrets.Grammar(secrets.labelled_credentials())


def test_automata_score_as_a_walk_through_them(grammar):
    tokens = ["A" * 40, "ghp_0123456789abcdef01AbCdEfGhIjKl", "plain-looking-words", "x9/Z" * 700, *(f"tok_{i}_{'ab1' * i}" for i in range(30))]
    best, lift = grammar.score(tokens)
    for t, b, x in zip(tokens, best, lift, strict=True):
        totals = []
        for a in grammar.automata:
            at, total = 0, 0.0
            for c in [*(int(secrets.CLASS_OF[ord(c)]) for c in t), secrets.END]:
                total += a.cost[at, c]
                at = a.step[at, c]
            totals.append(total)
        assert abs(max(totals[1:]) - totals[0] - x) < 1e-6 * abs(x) + 1e-9 and abs(totals[b] - max(totals[1:])) < 1e-9
    for a in grammar.automata:  # of every state, classes and the end sum to one
        sizes = [*map(len, secrets.CLASSES), 1]
        assert np.allclose((np.exp(a.cost) * sizes).sum(1), 1)


def test_merging_finds_the_states_of_a_known_automaton():
    r = random.Random(2)
    # (a b)* in pairs: two states, told apart by what follows
    auto = secrets.infer("".join("0" + "g" for _ in range(r.randint(1, 9))) for _ in range(500))
    zero, g = (next(k for k, c in enumerate(secrets.CLASSES) if x in c) for x in "0g")
    at = int(auto.step[0, zero])
    assert np.exp(auto.cost[at, g]) * len(secrets.CLASSES[g]) > 0.97 and auto.step[at, g] != at
    after = int(auto.step[at, g])
    assert np.exp(auto.cost[after, secrets.END]) > 0.05 and int(auto.step[after, zero]) in (at, 0) or len(auto.cost) < 25


def test_secrets_around_base_spans_in_paths_and_in_long_runs(spark, grammar):
    key = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    texts = ["ghp_0123456789abcdef01AbCdEfGhIjKl", f"see https://host.example.com/some/path/{key} there", f"GH={key}", f"token = {key}.", "k " + "x9/Z" * 60_000 + " end", None, ""]
    rows = [(0, texts[0]), *enumerate(texts), (None, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("clash"), "kind": F.lit(1)})
    clean = secrets.redact(table)
    assert clean.columns == table.columns
    got = {(r.doc_id, r.text) for r in clean.collect()}
    assert (0, "[SECRET]") in got and (None, "[SECRET]") in got and (4, "k [SECRET] end") in got and (5, None) in got and (6, "") in got
    assert clean.count() == len(rows) and not any(t and ("16C7e42F" in t or "AbCdEf" in t) for _, t in got)
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(table).collect()}
    assert spans[0] == [("grammar", 0, 34), ("hex", 4, 22)] and [k for k, _, _ in spans[3]].count("assign") == 1 and spans[5] == spans[6] == []
    assert secrets.scan(table.limit(0)).count() == secrets.redact(table.limit(0)).count() == secrets.scan_digests(table.limit(0)).count() == 0
    assert secrets.scan_digests(table).count() == len(rows)


def test_secrets_leave_source_code_alone(grammar):
    """Text that the rules of the training rows did not make: modules of the standard library."""
    runs = flagged = 0
    for module in (argparse, collections, decimal, doctest, inspect, typing):
        text = inspect.getsource(module)
        runs += len(secrets.CANDIDATE.findall(text))
        flagged += len(secrets.grammar_spans(text, grammar, secrets.MARGIN))
    assert runs > 500 and flagged / runs < 0.02


def brute_hits(texts, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, named = cut(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit |= set(range(k, k + size))
                    named |= grams[g]
        out[d] = (len(w), len(hit), sorted(named))
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice(["the", "Éa", "b9", "x", "yes"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 2, 5, 12, 15])))) for i in range(12)] + [(99, None), (3, "one two")]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) + " " + r.choice(items[:12])[1].upper() for _ in range(40)] + [None, "", "one, TWO!"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, texts)
    got = {x.doc_id: (x.n_words, x.n_hit, list(x.item_ids)) for x in decontaminate.report(table, bench).collect()}
    want = brute_hits(texts, items)
    assert got == want
    left = {x.doc_id for x in decontaminate.drop_documents(table, bench).collect()}
    assert left == {d for d, v in want.items() if not v[1]}
    again = decontaminate.report(decontaminate.drop_spans(table.where("doc_id = 42"), bench), bench).collect()
    assert [x.n_hit for x in again] == [0]
    assert decontaminate.report(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(table.limit(0), bench).count() == 0 == decontaminate.drop_documents(table.limit(0), bench).count()


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, -1])
def test_decontamination_of_odd_rows_by_broadcast_and_by_shuffle(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast_bytes)
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, leak), (1, leak), (1, "another text"), (None, leak.upper()), (None, None), (2, ""), (3, "w " * 200_000 + leak + " end"), (4, f"x, {leak}! {leak}")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hits": F.lit("clash"), "code": F.lit(1), "_id": F.lit(2), "w": F.lit(3)})
    bench = spark.createDataFrame([("b", leak), ("a", leak + " lambda"), ("c", leak), (None, leak)], "item_id string, text string").withColumn("at", F.lit(0))
    got = sorted(((x.doc_id, x.n_words, x.n_hit, list(x.item_ids)) for x in decontaminate.report(table, bench).collect()), key=str)
    some = ["a", "b", "c"]
    want = [(1, 10, 10, some), (1, 10, 10, some), (1, 2, 0, []), (None, 10, 10, some), (None, 0, 0, []), (2, 0, 0, []), (3, 200_011, 10, some), (4, 21, 20, some)]
    assert got == sorted(want, key=str)
    left = decontaminate.drop_documents(table, bench)
    assert left.columns == table.columns and sorted((str(x.doc_id), x.text) for x in left.collect() if x.text is not None) == [("1", "another text"), ("2", "")]
    spans = decontaminate.drop_spans(table, bench)
    texts = {x.doc_id: x.text for x in spans.where("doc_id > 1").collect()}
    assert spans.columns == table.columns and spans.count() == len(rows) and texts == {2: "", 3: "w " * 200_000 + "end", 4: "x, "}


def test_url_rules_and_templates(spark):
    urls = ["http://A.Example.ORG/en/1?x", "https://b.example.org/es/7", "http://x.org/a", "http://x.com/de/1", "ftp://c.net", None, "no scheme", "http://x.com/de", "http://org/"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert got[1].rule == "example.org/es/" and got[2].rule == "org/" and got[3].verdict == "block"
    assert (got[4].host, got[4].path, got[4].rule) == ("c.net", "", None) and (got[5].host, got[6].host, got[5].path) == ("", "", "")
    assert got[7].rule is None and got[8].rule == "org/"
    labelled = spark.createDataFrame([("h", ["bad", "{n}"], 1)] * 40 + [("h", ["good", "{n}"], 0)] * 40 + [("h", ["rare"], None)], "host string, shape array<string>, label int")
    tree = {tuple(r["shape"]): (r.template, r.purity) for r in url_filter.templates(labelled).distinct().collect()}
    assert tree[("bad", "{n}")][1] > 0.9 > 0.1 > tree[("good", "{n}")][1] and tree[("rare",)][0] == "/*"


def brute_templates(rows, z=1.96, prior=4.0):
    """The tree of each host walked by hand: {(host, shape): (template, purity)}."""
    counts = {}
    for host, path, label in rows:
        k, b = counts.get((host, tuple(path)), (0, 0))
        counts[host, tuple(path)] = (k + (label is not None), b + (label or 0))
    share = lambda b, k: (b + 1) / (k + 2)

    def differ(x, y):
        p = share(x[1] + y[1], x[0] + y[0])
        return abs(share(x[1], x[0]) - share(y[1], y[0])) >= z * (p * (1 - p) * (1 / (x[0] + 2) + 1 / (y[0] + 2))) ** 0.5

    template = dict.fromkeys(counts, "")
    for d in range(max(len(p) for _, p in counts)):
        nodes = {}
        for (h, p), t in template.items():
            c = nodes.setdefault((h, t), {}).setdefault(p[d] if d < len(p) else "", [0, 0])
            c[0] += counts[h, p][0]
            c[1] += counts[h, p][1]
        seg = {}
        for n, children in nodes.items():
            total = [sum(c[i] for c in children.values()) for i in (0, 1)]
            apart = [c for c, v in children.items() if c and differ(v, (total[0] - v[0], total[1] - v[1]))]
            runs, last = [], None
            for c in sorted(apart, key=lambda c: (share(children[c][1], children[c][0]), children[c][0])):
                if last is None or differ(children[c], last):
                    runs.append([])
                runs[-1].append(c)
                last = children[c]
            for c in children:
                run = next((i for i, r in enumerate(runs) if c in r), None)
                alone = len(children) == 1 or not c
                seg[n, c] = c if alone else "*" if run is None else f"*{run + 1}" if len(runs[run]) > 1 else c
        template = {(h, p): t if d >= len(p) else f"{t}/{seg[(h, t), p[d]]}" for (h, p), t in template.items()}
    per, hosts = {}, {}
    for (h, p), t in template.items():
        for table, key in ((per, (h, t)), (hosts, h)):
            k, b = table.get(key, (0, 0))
            table[key] = (k + counts[h, p][0], b + counts[h, p][1])
    base = share(sum(b for _, b in hosts.values()), sum(k for k, _ in hosts.values()))
    of = lambda h, t: (per[h, t][1] + prior * (hosts[h][1] + prior * base) / (hosts[h][0] + prior)) / (per[h, t][0] + prior)
    return {(h, p): (t, of(h, t)) for (h, p), t in template.items()}


def test_templates_equal_a_tree_walked_by_hand(spark):
    r = random.Random(11)
    rows = []
    for host in "hg":
        for _ in range(60):
            path = [r.choice("abcdefg")] + [r.choice("xyz") for _ in range(r.randint(0, 9))]
            bad = 0.95 if path[0] in "ab" else 0.05 if path[0] in "cd" else 0.5
            rows += [(host, path, r.choice([None, int(r.random() < bad)]) if path[0] != "g" else None) for _ in range(r.randint(1, 12))]
    deep = ["a"] * 8
    rows += [("deep", [*deep, "bad"], 1)] * 30 + [("deep", [*deep, "good"], 0)] * 30 + [("deep", [*deep, "vile"], 1)] * 30 + [(None, [], None)]
    table = spark.createDataFrame(rows, "host string, shape array<string>, label int")
    got = {(x.host, tuple(x["shape"])): (x.template, round(x.purity, 9)) for x in url_filter.templates(table.where("host is not null")).collect()}
    assert got == {k: (t, round(p, 9)) for k, (t, p) in brute_templates([x for x in rows if x[0] is not None]).items()}
    assert got["deep", (*deep, "bad")][0] == got["deep", (*deep, "vile")][0] == "/a" * 8 + "/*2" and got["deep", (*deep, "good")][1] < 0.2


def test_urls_of_odd_pages(spark):
    rows = [(1, "http://n.net/a/1"), (1, "http://n.net/a/1"), (None, "http://n.net/a/2"), (2, None), (3, ""), (4, "http://n.net/" + "/".join("abcdefgh" * 40)), (5, "://"), (6, "http://n.net/" + "x" * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({"template": F.lit("t"), "verdict": F.lit("v"), "shape": F.lit(1)})
    got = url_filter.judge(table).collect()
    assert len(got) == len(rows) and sum(x.page_id == 1 for x in got) == 2 and all(x.verdict in ("allow", "block") for x in got)
    assert {x.page_id: x.host for x in got}[5] == "" and url_filter.judge(table.limit(0)).count() == 0


def test_licences_of_wrapped_texts_and_other_names(spark):
    wrap = lambda s: "\n * ".join(textwrap.wrap(s, 40))
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(wrap(s) for s in (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"))
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. {}\n2. {}".format(
        wrap("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        wrap("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."))
    cases = [
        ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
        ("This work is licensed under a Creative Commons\r\nAttribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
        (mit, {"MIT"}),
        (mit.replace("\n", "\r\n"), {"MIT"}),
        (wrap(gnu.format("program", ":", "General Public License", ",", 3)), {"GPL-3.0-or-later"}),
        (wrap(gnu.format("program", ";", "General Public License", ";", 2)), {"GPL-2.0-or-later"}),
        (wrap(gnu.format("library", ";", "Lesser General Public License", ";", "2.1")), {"LGPL-2.1-or-later"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", {"MPL-2.0"}),
        (wrap("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."), {"ISC"}),
        (bsd, {"BSD-2-Clause"}),
        ("Some title\nReleased under the MIT License\nMore text", {"MIT"}),
        ("Licensed under\n\nCC BY-NC 4.0.", None),
    ]
    got = {r.doc_id: set(r.licenses) for r in licenses.scan(docs(spark, [t for t, _ in cases])).collect()}
    assert [got.get(i) for i in range(len(cases))] == [want for _, want in cases]


def test_licences_need_their_sentences_in_order(spark):
    grant, notice, as_is = (next(s for i, s in licenses.SENTENCES if i == k) for k in ("mit-grant", "mit-notice", "as-is"))
    texts = ["Some text.\nReleased under the MIT License.\nMore", f"{grant.upper()}. {notice}; other words. {as_is}.", f"{as_is}. {notice}. {grant}.", None, "", "Licensed under the Apache License, Version 2.0."]
    got = {r.doc_id: list(r.licenses) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {0: ["MIT"], 1: ["MIT"], 5: ["Apache-2.0"]}


def test_chat_can_be_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\l<t>]b"), (1, 2, "assistant", None), (1, 1, "assistant", "a\\l<t>]b"), (2, None, None, "x"), (2, 0, "[r]", ""), (None, 3, "assistant", "é🙂")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_conversations(turns)
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    pairs = lambda c: [(t.role, t.text) for t in back[c].turns]
    assert pairs(1) == [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\l<t>]b"), ("assistant", "a\\l<t>]b"), ("assistant", "")]
    assert pairs(2) == [("", "x"), ("[r]", "")] and back[1].loss_text == "a\\l<t>]b" * 2 and back[None].loss_text == "é🙂" and back[2].loss_text == ""
    assert {r.conv_id: r.n_blocks for r in out.collect()} == {1: 2, 2: 2, None: 1}


@pytest.mark.parametrize("shard_bytes", [800, 1 << 20])
def test_repeats_equal_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard_bytes)
    r = random.Random(7)
    base = ["".join(r.choice("ab éc") for _ in range(r.randint(40, 300))) for _ in range(6)]
    rows = [(r.choice([i, i, i - 1, None]), "".join(r.choice(base)[r.randint(0, 80) : r.randint(80, 300)] for _ in range(r.randint(0, 4)))) for i in range(40)]
    rows += [(70, "a" * 400), (71, "a" * 300), (72, "a" * 49), (5, "ab" * 300), (80, "ab" * 200), (90, None), (4, rows[3][1])]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 60), i)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.remove_repeats(table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.remove_repeats(table.limit(0)).count() == 0


def test_a_short_common_string_holds_no_window_open():
    r = random.Random(3)
    noise = lambda n: "".join(chr(r.randint(33, 126)) for _ in range(n))
    common, long_ = noise(25), noise(60)
    texts = [noise(100) + common + noise(100) + long_ * (i < 2) + noise(100) for i in range(4)]
    shard = suffixes._Shard(pd.DataFrame({"doc_id": range(4), "text": texts}), 50, 20)
    hashes, twice = shard.distinct()
    first, last = shard.segments(hashes[twice])
    assert set(shard.row[first].tolist()) == {0, 1}
    inside = [range(225, 236), range(225, 236)]  # the windows that lie in the long string
    opened = [{w - shard.start[k] for a, z in zip(first, last, strict=True) for w in range(a, z) if shard.row[w] == k} for k in (0, 1)]
    assert all(set(want) <= got for want, got in zip(inside, opened, strict=True))


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for k in range(40):
        n = int(r.integers(1, 50))
        data, stops = r.integers(0, 2 + k % 3, n).astype(np.uint8), np.unique(np.append(r.integers(0, n, 2), n - 1))
        end = lambda i: int(stops[np.searchsorted(stops, i)])  # noqa: B023, E731
        key = lambda i: ([int(x) + 1 for x in data[i : end(i)]], end(i))  # noqa: B023, E731
        order = suffixes.suffix_array(data, stops)
        assert order.tolist() == sorted(range(n), key=lambda i: (*key(i)[0], 0, key(i)[1]))
        shared = suffixes.common_prefixes(data, stops, order, 1000)
        for a, b, s in zip(order, order[1:], shared[1:], strict=False):
            x, y = key(a)[0], key(b)[0]
            assert s == next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_fingerprints_follow_the_definition():
    for text in ["", "  ", "One", "one two", "A b c d e f", "É x\x0by z w q", "the " * 100, None]:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_join_as_all_pairs_would(spark):
    r = random.Random(3)
    values = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for chunk in (4096, 3):
        got = {x.vertex: x.component for x in components.connected_components(simhash.links(nodes, chunk=chunk)).collect()}
        want = {}
        for v in values:
            want.setdefault(find(v), []).append(signed(v))
        for group in want.values():
            assert {got.get(v, v) for v in group} == {min(group)}


def test_near_duplicates_on_odd_rows(spark):
    table = docs(spark, ["same text here", "same text here", None, "", "other words entirely now"])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_neighbours_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(16)]) for i in range(400)] + [(500 + i, [1.0] * 16) for i in range(20)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (None, [1.0] * 16), (904, []), (905, [1.0] * 3), (500, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {}
    for x in neighbours.search(table, table.where("vec_id % 50 = 0 or vec_id = 905")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in good if i % 50 == 0}
    found = 0
    for q, answers in got.items():
        best = sorted((-round(float(good[q] @ v), 12), i) for i, v in good.items() if i != q)[:5]
        found += len({i for _, i in best} & {i for _, i, _ in answers})
        assert [k for k, _, _ in sorted(answers)] == list(range(1, len(answers) + 1))
    assert found / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in sorted(got[500])] == [501, 502, 503, 504, 505]


def test_quality_keeps_clean_documents(spark):
    r = random.Random(4)
    word = lambda: r.choice("the and of river stone light under walking slowly green".split())
    texts, marks = [], []
    for i in range(600):
        words = [word() for _ in range(r.randint(5, 80))]
        kind = i % 6
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words[r.randrange(len(words))] = r.choice(["nasty", "vile"])
        texts.append(" ".join(words))
        marks.append((i, int(kind != 0), int(kind == 1)))
    table = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([m for m in marks if m[0] < 400] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality.select(table, labels).collect()}
    held = range(400, 600)
    clean, bad = [i for i in held if i % 6 > 1], [i for i in held if i % 6 < 2]
    assert np.mean([i in kept for i in clean]) > 0.97 and np.mean([i in kept for i in bad]) < 0.03
    assert quality.select(table, labels.limit(0)).count() == table.count()
    odd = table.withColumns({"tail": F.lit("mine"), "set": F.lit(1)})
    odd = odd.union(odd.where("doc_id < 3")).union(odd.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))).union(odd.where("doc_id = 3").withColumn("text", F.repeat("text", F.lit(20_000))))
    left = quality.keep(odd, labels)
    assert left.columns == odd.columns and {x.tail for x in left.collect()} == {"mine"}
    assert left.where("doc_id = 2").count() == 2 and left.where("doc_id is null").count() == 1 and left.where("doc_id in (0, 1)").count() == 0
    assert quality.keep(odd.limit(0), labels).count() == 0
    few = quality.train(table, labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")), max_bytes=20_000)
    assert few.thresholds[0] < few.thresholds[1] and few.weights.any()


def test_ordinal_fit_is_the_maximum():
    r = np.random.default_rng(3)
    sets = [np.flatnonzero(r.random(12) < 0.3) for _ in range(400)]
    grades = np.clip(np.round([0.8 * (0 in s) - 0.9 * (1 in s) + 1 + r.normal(0, 0.7) for s in sets]), 0, 2).astype(np.int64)
    model = quality.fit(sets, grades, slope=1e-9)
    x = np.array([[k in s for k in range(12)] for s in sets], dtype=float)

    def gain(w, theta):
        tail = np.hstack([np.ones((400, 1)), 1 / (1 + np.exp(theta[None] - (x @ w)[:, None])), np.zeros((400, 1))])
        at = np.arange(400)
        return np.log(tail[at, grades] - tail[at, grades + 1]).sum() - 0.15 * (w**2).sum()

    w, theta = model.weights[:12], model.thresholds
    best = gain(w, theta)
    for _ in range(300):
        d, e = r.normal(0, 0.02, 12), r.normal(0, 0.02, 2)
        assert gain(w + d, theta + e) < best
    assert not model.weights[12:].any() and theta[0] < theta[1]
    assert quality.fit([], np.zeros(0, dtype=np.int64)).tails("x")[-1] > 0.99 and quality.fit(sets, np.full(400, 2)).tails("")[-1] > 0.99
