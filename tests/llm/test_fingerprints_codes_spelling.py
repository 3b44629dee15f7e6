"""Order MinHash, vector codes and spelling variants against brute force, on small tables with everything that must not crash them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tessella.llm import catalog, order_minhash, spelling, vector_codes
from tessella.llm.common import documents

WORD = 2**64


def _mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % WORD
    return x ^ (x >> 31)


def _signature(text, k=order_minhash.K, n=order_minhash.COORDINATES, chosen=order_minhash.CHOSEN):
    """Order MinHash by the definition, in Python's integers."""

    def hashed(points):
        h = 0
        for c in points:
            h = (h + ord(c)) * 0xD6E8FEB86659FD93 % WORD
        return _mixed(h)

    grams = [hashed(text[i : i + k]) for i in range(len(text) - k + 1)] if len(text) >= k else [_mixed((hashed(text) + len(text)) % WORD)] if text else []
    seen, ids = Counter(), []
    for g in grams:
        ids.append(_mixed((g + seen[g] * 0x9E3779B97F4A7C15) % WORD) if seen[g] else g)
        seen[g] += 1
    out = []
    for a in order_minhash.multipliers(n).tolist():
        least = sorted(range(len(ids)), key=lambda i: ((ids[i] >> 32) * a % 2**32, i))[:chosen]
        h = 0
        for i in sorted(least):
            h = _mixed((h * 0xC2B2AE3D27D4EB4F + ids[i]) % WORD)
        out.append(h >> 32 if ids else 0)
    return out


def _texts():
    rng = random.Random(4)
    return ["", "a", "seven..", "12345678", "abababababababababab", "é漢字\U0001f600 é漢字\U0001f600 é漢字\U0001f600", "x" * 9000, *(" ".join(rng.choice("tea sleep study water stone green river".split()) for _ in range(n)) for n in (3, 40, 300, 1500))]


def test_signatures_by_definition():
    texts = _texts()
    assert order_minhash.signatures(texts).tolist() == [_signature(t) for t in texts]
    for t, got in zip(texts, order_minhash.signatures(texts, k=3, coordinates=5, chosen=3), strict=True):
        assert got.tolist() == _signature(t, 3, 5, 3)


def test_colliding_keys_are_put_in_order_by_the_whole_hash(monkeypatch):
    texts = _texts()
    want = order_minhash.signatures(texts)
    monkeypatch.setattr(order_minhash, "mixed", lambda x: x if x.ndim and len(x) < 0 else _array_mixed(x))
    assert (order_minhash.signatures(texts) == want).all()
    hashes, text = np.array([5, 7, 5, 7, 5], np.uint64), np.array([0, 0, 0, 0, 1])
    monkeypatch.setattr(order_minhash, "mixed", lambda x: x * np.uint64(0))
    assert order_minhash._grouped(hashes, text).tolist() == [0, 2, 1, 3, 4]


def _array_mixed(x):
    from tessella.llm.common import mixed

    return mixed(x)


def test_order_and_edits_show():
    rng = random.Random(8)
    a = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    near = a[:]
    for i in range(0, 600, 60):
        near[i] = "changed"
    sig = order_minhash.signatures([" ".join(x) for x in (a, near, a[300:] + a[:300], [f"v{rng.randrange(10**6)}" for _ in range(600)])], coordinates=512)
    one, swapped, other = (order_minhash.likeness(sig[0], sig[i]) for i in (1, 2, 3))
    assert one > swapped > 0.3 and one > 0.6 and other == 0
    # the same sets of k-mers but at the seams: a plain MinHash would not tell the halves apart
    plain = order_minhash.signatures([" ".join(a), " ".join(a[300:] + a[:300])], coordinates=512, chosen=1)
    assert order_minhash.likeness(*plain) > 0.9 > swapped


def _edits_by_hand(rows):
    """Rows of (id, text) in their order."""
    out = Counter()
    for i, (doc_id, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        changed = text[: len(text) - q] + other[:q]
        a, b, c = _signature(text), _signature(changed), _signature(other)
        share = [sum(x == y for x, y in zip(a, z, strict=True)) / len(a) for z in (b, c)]
        out[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *("".join(f"{x:08x}" for x in s) for s in (a, b)), *share] += 1
    return out


_EDITS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_op11_by_hand(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents(spark, SMALL).collect())[:60]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    assert Counter(tuple(r[c] for c in _EDITS) for r in order_minhash.edits(docs).collect()) == _edits_by_hand(rows)
    whole = catalog.queries()["op11_order_minhash"](spark, SMALL).toPandas()
    assert whole.near_edited.mean() > 0.25 > whole.near_next.mean()
    texts = dict(documents(spark, SMALL).select("doc_id", F.coalesce("text", F.lit(""))).collect())
    of = defaultdict(set)
    for i, f in zip(whole.doc_id, whole.fingerprint, strict=True):
        of[texts[i]].add(f)
    assert {len(x) for x in of.values()} == {1} and len(whole) == len(texts)


@pytest.mark.parametrize("slice_", [1, 1 << 20])
def test_edits_of_odd_rows(spark, monkeypatch, slice_):
    monkeypatch.setattr(order_minhash, "SLICE", slice_)
    rows = [(1, None), (2, ""), (3, "short"), (5, "b" * 5000), (8, "tea and water, tea and water"), (9, "tea and water, tea and water"), (7, "xé\U0001f600" * 50)]
    docs = spark.createDataFrame([(i, t, 1, 2, "w") for i, t in rows], "doc_id long, text string, key long, bucket int, visitor string")
    got = order_minhash.edits(docs)
    assert Counter(tuple(r[c] for c in _EDITS) for r in got.collect()) == _edits_by_hand(sorted((i, t or "") for i, t in rows))
    # null and repeated ids come after the others
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "none"), (None, None), (9, "another"), (5, "b" * 5000)], "doc_id long, text string"))
    got = {(r.doc_id, r.n_chars): r for r in order_minhash.edits(odd).collect()}
    assert order_minhash.edits(odd).count() == 11
    assert got[3, 5].edited_sha256 == hashlib.sha256(b"shorx").hexdigest()
    assert order_minhash.edits(odd.where("doc_id = 8")).collect()[0].near_next == 1.0
    assert order_minhash.edits(odd.limit(0)).count() == 0
    assert {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs).collect()} == {r.doc_id: r.fingerprint for r in order_minhash.edits(docs).collect()}


def _codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector) in order; every part is compared with every entry."""
    points = [[[math.floor(4096 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v in rows]
    books = [[points[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            by = defaultdict(list)
            for v in points:
                by[nearest(v[p], books[p])[1]].append(v[p])
            for k, xs in by.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    got = [[nearest(v[p], books[p]) for p in range(parts)] for v in points]
    return Counter((i, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g)) for (i, _), g in zip(rows, got, strict=True)), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("block", "leaf", "steps"), [(1 << 15, 32, 0), (40, 2, 0), (64, 1, 3), (50, 4, 1000)])
def test_codes_by_hand(spark, monkeypatch, block, leaf, steps):
    """steps: few different values make ties and empty entries; large ones leave 64 bits."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    x = rng.normal(size=(300, 32)) if not steps else rng.integers(-steps, steps, (300, 32)) / 4096 if steps < 10 else rng.normal(size=(300, 32)) * 1e30
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(300), x, strict=True)]
    rows += [rows[3], rows[4], (None, rows[9][1])]
    frame = spark.createDataFrame([(i, v, None if i is None or i % 3 else "hot", 1.5) for i, v in rows], "vec_id long, embedding array<float>, label string, error double")
    broken = spark.createDataFrame([(1000 + i, v) for i, v in enumerate((None, [], [float("nan")] * 32, [float("inf")] + [0.0] * 31, [None] + [0.0] * 31, [0.5] * 31))], "vec_id long, embedding array<float>")
    got, books = vector_codes.codes(frame.unionByName(broken, allowMissingColumns=True).repartition(3))
    want, digest = _codes_by_hand(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])))
    assert vector_codes.digest(books) == digest
    assert Counter((r.vec_id, r.code, r.error) for r in got.collect()) == Counter({(i, c, min(e, 2**63 - 1)): n for (i, c, e), n in want.items()})


def test_trees_assign_like_all_comparisons():
    rng = np.random.default_rng(2)
    for spread in (3, 50, 5000):
        points, book = rng.integers(-spread, spread, (1000, 5)), rng.integers(-spread, spread, (9, 5))
        sums, counts, got = vector_codes.KdTree(points).assigned(book, codes=True)
        tree = vector_codes.KdTree(points)
        want = vector_codes.squared(tree.points, book).argmin(1)
        assert (got == want).all() and (counts == np.bincount(want, minlength=9)).all()
        assert (sums == np.stack([tree.points[want == k].sum(0) for k in range(9)])).all()


def test_subtrees_are_assigned_whole(monkeypatch):
    """Clusters apart from each other: no point is compared at the leaves."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-10**6, 10**6, (8, 4))
    points = np.concatenate([c + rng.integers(-5, 5, (500, 4)) for c in centres])
    tree = vector_codes.KdTree(points)
    compared = []
    real = vector_codes.squared
    monkeypatch.setattr(vector_codes, "squared", lambda p, b: compared.append(len(p)) or real(p, b))
    tree.assigned(centres)
    assert sum(compared) < len(points) / 4


def test_codes_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    empty, books = vector_codes.codes(spark.createDataFrame([], schema))
    assert empty.count() == 0 and books == [] and empty.columns == ["vec_id", "label", "code", "error"]
    three = spark.createDataFrame([(5, [0.25] * 12, 1), (7, [1.5] * 12, None), (6, [1.5] * 12, 1)], schema)
    got, books = vector_codes.codes(three)
    assert {(r.vec_id, r.code, r.error) for r in got.collect()} == {(5, "00" * 8, 0), (6, "010101010101" + "0000", 0), (7, "010101010101" + "0000", 0)}
    assert [b.shape for b in books] == [(3, 2)] * 8  # twelve components fill eight parts of two, the last ones with zeros
    back = {r.vec_id: r.vector for r in vector_codes.decoded(got, books).collect()}
    assert back[5][:12] == pytest.approx([0.25] * 12, abs=1e-3) and back[7][:12] == pytest.approx([1.5] * 12, abs=1e-3)


def test_label_errors(spark):
    got = catalog.queries()["op12_vector_codes"](spark, SMALL).toPandas()
    labels = documents(spark, SMALL, "embeddings").select("vec_id", "label").toPandas()
    both = got.merge(labels, on="vec_id")
    assert (both.groupby("label", dropna=False).error.transform("sum") == both.label_error).all() and len(both) == len(got)


def _variants_by_hand(docs, every=None):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {}
    for w, xs in by.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(by[w]), words[form[w]] if form[w] else None))
    return out


_VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("trie", [10, 300, 200_000])
def test_variants_by_hand(spark, trie, monkeypatch):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (trie,))
    monkeypatch.setattr(spelling.forms, "__defaults__", (2, trie))
    rng = random.Random(trie)
    words = ["water", "stone", "study", "étude", "Straße", "aaaaaa", "aaaaaaa", "ababababab", "x" * 300, "x" * 301, "Étude"]
    for w in words[:]:
        for _ in range(12):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aexz") + w[i:], w[:i] + rng.choice("aexz") + w[i + 1 :]]))
    hot = ["prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)]  # one beginning for a third of all words
    docs = [(i if i % 9 else None, " ".join(rng.choices(words + hot, k=60)) + rng.choice([" ", "\n", "1", "×", "ő"])) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "12 , 漢字"), (1, docs[0][1]), (1, docs[0][1])]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    for every in (None, 7):
        got = {tuple(r[c] for c in _VARIANTS) for r in spelling.variants(frame, every=every).collect()}
        assert got == _variants_by_hand(docs, every)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_chains_of_forms_end_in_their_root(spark):
    chain = ["chaina" + "b" * i for i in range(9)]
    text = " ".join(" ".join([w] * (3 * 2**i)) for i, w in enumerate(chain))
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def test_near_pairs_equals_all_comparisons():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})

    def deleted(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or a in deleted(b) or b in deleted(a))}
    got = list(spelling.near_pairs(words))
    assert len(got) == len(set(got)) and set(got) == want
