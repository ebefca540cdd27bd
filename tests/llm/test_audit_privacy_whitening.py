"""Filter audit, personal data and whitening against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternloom.llm import filter_audit, privacy, whitening


def played(rows, labels):
    """Every order played through row by row; rows are (doc_id, text, lang)."""
    marks = {}
    for i, quality, toxic in labels:
        old = marks.get(i, (False, False))
        marks[i] = (old[0] or quality == 1, old[1] or toxic == 1)
    facts = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in rows)
        facts.append((lang or "", fails, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], {x: 0 for x in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                rest = [f for f in left if x not in f[1]]
                out[part, order, k] = [len(rest), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == x for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                total[x] += len(gone)
                left = rest
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order, 1):
                out[part, order, k].append(total[x])
    return out


def test_audit_equals_orders_played_through(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["ab", "Cd", "ef", "x#", "gh"] + [f"w{j}" for j in range(r.choice((1, 300)))]) for _ in range(r.choice((0, 3, 150, 260)))) for _ in range(60)]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en") for i in range(9)] + [(5, texts[5], "en"), (5, texts[5], "en"), (5, "other", "fr"), (None, texts[4], "en"), (None, None, None), (90, None, "en"), (91, "", "en"), (92, "\u000b  É\t", "x")]
    rows += [(93, "long " * 50_000, "en")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 110, 3)] + [(6, 1, 1), (9, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("part", "mask", "key", "own", "n", "salt", "quality", "step")})
    marks = spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in filter_audit.audit(docs, marks).collect()}
    assert got == played(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0 and filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        filter_audit.audit(docs.drop("lang"), marks)
    with pytest.raises(ValueError):
        filter_audit.survivors(filter_audit.masks(docs, marks), 9)


def test_zeta_sums_over_submasks(spark):
    counts = [random.Random(3).randrange(50) for _ in range(32)]
    got = spark.createDataFrame([(counts,)], "c array<long>").select(filter_audit.zeta(F.col("c"), 5).alias("z")).first().z
    assert list(got) == [sum(counts[m] for m in range(32) if m & s == m) for s in range(32)]


def plain_spans(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def check(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (2 if i % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m.group())) <= 19 and check(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(found)


def test_base_spans_follow_the_patterns():
    r = random.Random(4)
    for k in range(4000):
        text = "".join(r.choice(("ab@.c-_ %+é", "0123.9 25", "0123456789 -", "+0 9().-12", "a@b.c +12 3.4-")[k % 5]) for _ in range(r.randint(0, 60)))
        assert privacy.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111 4111-1111-1111-1112", "x@y", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.02.3.255", "+49 (30) 1234-5678", "٣٤@a.b"):
        assert privacy.base_spans(text) == plain_spans(text), text
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a.b@" * 80_000, "+1" + " " * 300_000, "12 " * 100_000):
        privacy.base_spans(long)  # ends


def sanitised(texts, threshold=privacy.THRESHOLD, window=privacy.WINDOW, support=privacy.SUPPORT):
    """The words that disclose an entity, and the classes that do, by counting in plain loops."""
    words, near, spots = [], [], []
    for t in texts:
        base = plain_spans(t)
        free = [m for m in re.finditer(r"[^\W_]{2,}", t) if not any(a < m.end() and m.start() < b for a, _, b in base)]
        words.append({m.group().lower() for m in re.finditer(r"[^\W_]{2,}", t)} | {"~" + privacy.word_class(m.group()) for m in re.finditer(r"[^\W_]{2,}", t)})
        spots.append([(m.start(), m.end(), m.group()) for m in free])
        pairs = set()
        for a, k, b in base:
            name = privacy.entity(k, t[a:b])
            for m in [m for m in free if m.start() < a][-window:] + [m for m in free if m.start() >= b][:window]:
                pairs |= {(name, m.group().lower()), (name, "~" + privacy.word_class(m.group()))}
            pairs.add((name, ""))
        near.append(pairs)
    count = lambda sets, x: sum(x in s for s in sets)
    shares = {}
    for e, w in set().union(*near):
        ne, n = count(near, (e, "")), count(near, (e, w))
        if w and ne < len(texts) and (w[0] == "~" or n >= support):
            shares[e, w] = np.log(n * len(texts) / ne / count(words, w)) / np.log(len(texts) / ne)
    over = {p for p, s in shares.items() if s >= threshold - 1e-9}
    out = []
    for spot in spots:
        marks = []
        for a, b, w in spot:
            of = {e for e, x in over if x == w.lower()}
            if of:
                marks.append((a, b, "" if any((e, "~" + privacy.word_class(w)) in over for e in of) else f"[{privacy.word_class(w).upper()}]"))
        out.append(marks)
    return out


def test_disclosing_words_equal_plain_counts(spark):
    r = random.Random(5)
    common = [f"word{c}" for c in "abcdefghij"] + ["Monday"]
    people = [("Zorbium", "zo@x.org"), ("Quill77", "+49 30 1234567"), ("1987", "10.0.0.7")]
    texts = []
    for i in range(160):
        words = [r.choice(common) for _ in range(r.randint(5, 30))]
        if i % 4 == 0:
            name, value = people[i // 4 % 3]
            at = r.randrange(len(words))
            words[at:at] = [name, "mail", value] if i % 8 else [value, name]
        if i == 13:
            words.append("Zorbium")
        texts.append(" ".join(words))
    texts += ["ZORBIUM alone", "", "no one", "lonely@q.de Hapax here", "word " * 30_000 + " Zorbium"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("key", "base", "near", "terms", "__x", "term", "n")})
    want = sanitised([t or "" for _, t in rows])
    assert any(want) and {m for w in want for _, _, m in w} >= {"[NAME]"} and not want[texts.index("lonely@q.de Hapax here")]
    got = sorted((x.doc_id if x.doc_id is not None else -1, [(t.start, t.end, t.mark) for t in x.terms], [tuple(s) for s in x.base]) for x in privacy.scan(docs).collect())
    assert got == sorted((i if i is not None else -1, w, plain_spans(t or "")) for (i, t), w in zip(rows, want, strict=True))
    digests = {x.doc_id: x for x in privacy.scan_digests(docs).collect()}
    for i in (0, 4, 8, 164):
        base = plain_spans(texts[i])
        said = lambda spans: ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        x = digests[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert x.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest() and x.spans == said([*base, *((a, 4, b) for a, b, _ in want[i])])
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns
    cleaned = {x.doc_id: x.text for x in clean.collect()}
    assert not any(v in t for t in cleaned.values() if t for v in ("zo@x.org", "10.0.0.7", "1234567", "Zorbium")) and cleaned[None] is None and cleaned[162] == "no one"
    assert privacy.scan(docs.limit(0)).count() == 0 and privacy.sanitise(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        privacy.scan(docs, threshold=0.0)


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(6)
    vectors = (r.normal(size=(500, 24)) @ np.diag(np.linspace(2, 0.2, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(600, None), (601, []), (602, [None] * 24), (603, [float("nan")] * 24), (604, [float("inf")] * 24), (605, [1.0]), (606, [3e30] * 24), (None, vectors[0].tolist()), (7, vectors[7].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("x", "n", "deviation", "w", "at", "label")})
    got = whitening.whiten(table).toPandas()
    kept = np.vstack([vectors, vectors[:1], vectors[7:8]])
    x = np.floor(kept.astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    w = c @ axes / np.sqrt(values)
    assert len(got) == n * 8 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    exact = ((n * x - s).astype(object) ** 2).sum(axis=1)
    for i in (0, 7, 499):
        for _, g in got[got.vec_id == i].groupby("component"):
            k = g.component.iloc[0] - 1
            assert np.allclose(np.abs(g.whitened), abs(w[i, k]), atol=1e-9) and set(g.deviation) == {exact[i]}
            assert abs(g.explained.iloc[0] - values[k] / (c**2).sum() * n) < 1e-12
    signs = [np.sign(got[(got.component == k + 1) & (got.vec_id == i)].whitened.iloc[0] * w[i, k]) for k in range(8) for i in range(20)]
    assert all(len(set(signs[k * 20 : k * 20 + 20])) == 1 for k in range(8))
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.where("vec_id in (0, 600, 601)")).count() == 0
    few = whitening.whiten(table.where("vec_id < 4 and vec_id != 3"))
    assert {x.component for x in few.collect()} == {1, 2}
    with pytest.raises(ValueError):
        whitening.whiten(table, 0)


def test_lanczos_of_repeated_and_missing_eigenvalues():
    r = np.random.default_rng(7)
    q = np.linalg.qr(r.normal(size=(60, 60)))[0]
    for values in (np.r_[np.full(12, 5.0), np.ones(48)], np.r_[3.0, 2.0, np.zeros(58)], np.linspace(10, 1, 60), np.r_[1e6, np.linspace(1, 0.99, 59)]):
        m = (q * values) @ q.T
        asked = []
        found, axes = whitening.components(lambda v, m=m: asked.append(1) or m @ v, 60, 6)
        assert np.allclose(found, np.sort(values)[::-1][:6], atol=1e-9 * values.max()) and np.allclose(axes.T @ axes, np.eye(6), atol=1e-12)
        assert np.linalg.norm(m @ axes - axes * found, axis=0).max() < 1e-11 * values.max() and len(asked) <= 10
    wide = np.r_[np.linspace(100, 50, 6), np.full(394, 1.0)]
    q = np.linalg.qr(r.normal(size=(400, 400)))[0]
    asked = []
    whitening.components(lambda v: asked.append(1) or (q * wide) @ (q.T @ v), 400, 6)
    assert len(asked) < 20  # of 67 blocks that span the space
