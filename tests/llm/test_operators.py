"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from tessella.llm import catalog, exact_dedup, language_id, license_scan, minhash, mixing, packing, quality_rules, suffix_blocks, token_counts, token_ids
from tessella.llm.common import LOWER
from tessella.llm.graph import components

BPE = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
WORDS = "the of and tea sleep study water stone green river light house small under never ring blue".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, token string, winner string, label string, kept string"


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with everything that must not crash an operator."""
    rng = random.Random(11)
    base = [_text(rng, 80) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "two words", "A" * 5000, "x " * 4000, "a b 漢字 \U0001f600 é", "line\nline\nline\n\n", base[0], base[0].replace(" ", "\n "), base[0].upper(), *base, base[1], base[1] + " end", " ".join(base[2].split()[5:]), _text(rng, 3000)]
    for b in base[3:6]:
        for k in range(6):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    passage = _text(rng, 60)
    texts += [f"{_text(rng, 30)} {passage} {_text(rng, 30)}" for _ in range(6)]
    rows = [(i if i != 7 else None, t, ["en", "fr", None][i % 3], ["hot", "hot", "b", None][i % 4], 1, 2, "t", "w", "l", "k") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(odd):
    norm = {}
    for i, t in _pairs(odd):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {}
    for t, ids in norm.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, hashlib.sha256(t.encode()).hexdigest()] = (min(known) if known else None, len(ids))
    got = exact_dedup.exact_dedup(odd).collect()
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in got} == want
    assert len(got) == odd.count()
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(norm)


def test_exact_dedup_against_given_history(odd):
    got = exact_dedup.exact_dedup(odd, history=F.col("doc_id") < 20)
    assert {(r.doc_id, r.keep_id) for r in got.collect()} == {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(odd).collect()}


def test_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    table = exact_dedup.PerfectHash.build(keys)
    table = exact_dedup.PerfectHash.loads(*table.dumps())
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert len(exact_dedup.PerfectHash.build(keys[:0]).slots(keys)) == 5000


def _similar(rows, k):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingle(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(odd, k):
    got = minhash.minhash_dedup(odd, shingle_words=k).collect()
    want = _similar(_pairs(odd), k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == odd.count()


def test_minhash_chain_and_many_copies(spark):
    rng = random.Random(4)
    base = _text(rng, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == {i: c for i, (_, c) in _similar(rows, 2).items()}


def test_minhash_of_parts_and_shared_passages(spark):
    """Truncated copies, which have nothing outside their pivot; copies with the same edits; texts that share most of a passage."""
    rng = random.Random(14)
    base, edits = _text(rng, 150).split(), [f"e{i}" for i in range(6)]
    texts = [" ".join(base[a:b]) for a in (0, 20, 40) for b in range(90, 151, 7)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(5, 25)):
            w[rng.randrange(len(w))] = rng.choice(edits)
        texts.append(" ".join(w))
    texts += [" ".join(base[:110] + _text(rng, rng.randrange(20, 60)).split()) for _ in range(30)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == {i: c for i, (_, c) in _similar(rows, 2).items()}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label[i] == x for i, x in got.items()) and set(got) == {i for i, x in label.items() if x != i}


def test_suffix_dedup(odd):
    got = sorted(map(str, [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_blocks.suffix_dedup(odd).collect()]))
    assert got == sorted(map(str, suffix_blocks.brute_force(_pairs(odd))))


def test_suffix_dedup_of_periodic_text(spark):
    rng = random.Random(8)
    rows = [(i, ("ab" * 100)[: rng.randrange(40, 200)] + "".join(rng.choice("ab") for _ in range(200)) + "He " * rng.randrange(60)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_blocks.suffix_dedup(df).collect())
    assert got == sorted(suffix_blocks.brute_force(rows))


@pytest.mark.parametrize("bucket", [50, suffix_blocks.BUCKET])
def test_suffixes_are_sorted_bucket_by_bucket(monkeypatch, bucket):
    monkeypatch.setattr(suffix_blocks, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    for letters in (2, 8):
        block = rng.integers(97, 97 + letters, 400).astype(np.uint8)
        t = np.concatenate([block, block[:300], block[100:], rng.integers(97, 97 + letters, 500).astype(np.uint8), np.full(300, 97, np.uint8)])
        strings = []
        for order, equal in suffix_blocks.suffix_order(t, np.arange(len(t) - suffix_blocks.LENGTH)):
            assert len(order) <= max(bucket, 260) or bucket == suffix_blocks.BUCKET
            own = [t[i : i + suffix_blocks.LENGTH].tobytes() for i in order]
            assert equal.tolist() == [k > 0 and own[k] == own[k - 1] for k in range(len(own))]
            strings += own
        assert strings == sorted(strings) and len(strings) == len(t) - suffix_blocks.LENGTH


def test_suffix_dedup_in_small_blocks_and_parts(monkeypatch):
    """Every limit is reached: documents over the size of a block, seeds in often more blocks, parts over what is held."""
    rng = random.Random(21)
    passage = _text(rng, 40)
    rows = [(i, f"{_text(rng, rng.randrange(30))} {passage} {_text(rng, rng.randrange(30))}") for i in rng.sample(range(200), 120)]
    rows += [(300, _text(rng, 900)), (301, None), (None, passage)]
    rows += [(302, rows[-3][1][700:4000]), (302, rows[-3][1])]
    for name, value in {"BLOCK": 3000, "PIECE": 500, "HELD": 4000, "SORTED": 2000, "BUCKET": 100, "OFTEN": 3}.items():
        monkeypatch.setattr(suffix_blocks, name, value)
    rng.shuffle(rows)
    table = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t or "" for _, t in rows])})
    blocks = list(suffix_blocks._blocks(iter([table])))
    assert len(blocks) > 20
    pick = lambda b, *names: pa.RecordBatch.from_arrays([b.column(n) for n in names], names=list(names))
    announced = pa.Table.from_batches(suffix_blocks._announce(3)(pick(b, "block", "text") for b in blocks)).to_pandas()
    marks = {}
    for _, part in announced.groupby("part"):
        for r in suffix_blocks._shared(part).itertuples():
            marks.setdefault(r.block, []).append({"part": r.part, "marks": r.marks})
    assert any((suffix_blocks._unpacked(m["marks"], np.uint8)[0] == 2).any() for x in marks.values() for m in x)
    kind = pa.list_(pa.struct([("part", pa.int64()), ("marks", pa.binary())]))
    sent = suffix_blocks._send(3)(pa.RecordBatch.from_arrays([*b.columns, pa.array([marks.get(b.column(0)[0].as_py())], kind)], names=["block", "ids", "text", "marks"]) for b in blocks)
    sent = pa.Table.from_batches(sent).sort_by("part").to_batches()
    runs = {}
    for batch in suffix_blocks._sort_parts(iter(sent)):
        for r in batch.to_pylist():
            runs.setdefault(r["block"], []).append(r["blob"])
    out = suffix_blocks._remove(pa.RecordBatch.from_arrays([*b.columns, pa.array([runs.get(b.column(0)[0].as_py())], pa.list_(pa.binary()))], names=["block", "ids", "text", "runs"]) for b in blocks)
    got = [tuple(r[k] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for b in out for r in b.to_pylist()]
    assert sorted(map(str, got)) == sorted(map(str, suffix_blocks.brute_force(rows)))


def test_token_ids(spark, odd, tmp_path):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    uri = f"file://{tmp_path}/ids"
    got = token_ids.read_token_ids(token_ids.write_token_ids(docs, BPE, uri, shards=3, sequence=64), uri).collect()
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(BPE), 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(_pairs(docs)), strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = token_ids.Shard(uri, "shard-000000")
    ids, mask = shard.sequence_and_mask(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata


def test_token_ids_of_null_and_repeated_ids(odd, tmp_path):
    uri = f"file://{tmp_path}/odd"
    got = token_ids.read_token_ids(token_ids.write_token_ids(odd, BPE, uri, shards=2, sequence=64), uri).collect()
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(BPE), 0
    rows = sorted(_pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        n = len(plain.encode(t or "", add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, n)
        start += n


def test_stores_that_shards_cannot_be_written_to():
    with pytest.raises(ValueError, match="dbfs"):
        token_ids._place("dbfs:/x")


def test_cached_bpe_equals_the_library():
    bpe, rng = token_ids.CachedBpe(BPE, kept=50), random.Random(6)
    signs = ["a", "b", " a", "\u00a0", "\u2003", "\u2019", "É", "1", ".", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "　", "漢", "<|endoftext|>", "\U0001f600", "\r", "_"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(4000)]
    got = [x.tolist() for at in range(0, 4000, 40) for x in token_ids.encoded_texts(bpe, texts[at : at + 40])]
    assert got == [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_license_scan(spark, odd):
    texts = ["Licensed under the Apache License, Version 2.0.", "CC BY then cc  by; ALL RIGHTS RESERVED", "cc\nby", "licensed apache", None, "Permission is hereby granted, free of charge, to any person obtaining a copy of software"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert got[0].labels == "apache-2.0" and got[0].n_base == 0 and got[0].score == 1.0
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert got[2].base_labels == "cc-by" and got[3].labels == "" and got[4].n_words == 0
    assert got[5].labels == "mit" and 0.8 <= got[5].score <= 1
    assert license_scan.license_scan(odd).count() == odd.count()


def test_license_join_equals_all_comparisons(spark):
    rng = random.Random(1)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["x", "y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(300)]
    for _, t in license_scan.TEMPLATES:
        w = t.split()
        texts += [" ".join(rng.sample(w, max(len(w) - k, 0)) + ["x"] * k) for k in range(4)]
        for k in range(12):  # other words, repeats and line ends between
            out = [x for w_ in w for x in (w_, *rng.choices(["x", "the", "\n", rng.choice(w)], k=rng.randrange(2)))]
            texts.append(" ".join(["y"] * rng.randrange(3) + [x for x in out if rng.random() > 0.02 * k]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))), r) for r in license_scan.license_scan(df).collect()}
    met = 0
    for i, text in enumerate(texts):
        w, want, best = text.split(), set(), 0
        for label, t in license_scan.TEMPLATES:
            all_, wide = set(t.split()), license_scan.window(t)
            share = max(len(all_ & set(w[at : at + wide])) for at in range(max(len(w), 1)))
            if 100 * share >= 80 * len(all_):
                want, best = want | {label}, max(best, share / len(all_))
        met += len(want)
        assert got[i][0] - want == set() and want - got[i][0] <= {"gpl"}
        assert got[i][1].score == (1 if got[i][1].n_base else best)
    assert met > 300


def test_packing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 30, 700, 2048, 2049, 9000, None]), rng.choice(["hot", "hot", "b", None]), bytes([rng.randrange(40)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster binary")
    got = packing.pack(df, shard=500).collect()
    total, bins = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert total == {i: max(n or 1, 1) for i, n, *_ in rows}
    for pieces in bins.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset >= end
            end = r.bin_offset + r.n_tokens
        assert end <= packing.CAPACITY
        if len(pieces) > 1:
            for key in (2, 3):
                seen = [rows[r.doc_id][key] for r in pieces if rows[r.doc_id][key] is not None]
                assert len(seen) == len(set(seen))


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    items = [(rng.randrange(1, 60), rng.choice("abc"), rng.choice([None, 1, 2])) for _ in range(400)]
    bins, want = [], []
    for n, s, c in items:
        fits = [(left, b) for b, (left, ss, cc) in enumerate(bins) if left >= n and s not in ss and (c is None or c not in cc)]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, set(), set()])
        want.append((b, 100 - bins[b][0]))
        bins[b][0] -= n
        bins[b][1].add(s)
        bins[b][2].add(c)
    assert packing.best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 100) == want


def _deviates_by_less_than_a_block(weights, end):
    plan, seen = mixing.Pfair(weights), dict.fromkeys(weights, 0)
    total = sum(Fraction(repr(w)) for w in weights.values())
    for t, (s, k) in enumerate(plan.slots(end), 1):
        source = plan.sources[s]
        assert k == seen[source]
        seen[source] += 1
        assert all(abs(n - Fraction(repr(weights[x])) / total * t) < 1 for x, n in seen.items())
    return seen


def test_schedule_deviates_by_less_than_a_block():
    _deviates_by_less_than_a_block({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 50_000)
    _deviates_by_less_than_a_block({"a": 0.36, "b": 0.2, "c": 0.001, **{f"s{i}": 0.03 for i in range(14)}}, 3000)
    _deviates_by_less_than_a_block({"a": 0.4, "b": 0.4, **{f"t{i}": 0.005 for i in range(40)}}, 2000)
    rng = random.Random(5)
    for _ in range(20):
        _deviates_by_less_than_a_block({f"s{i}": rng.choice([1, 2, 0.001, 100, rng.random()]) for i in range(rng.randrange(1, 25))}, 400)
    seen = _deviates_by_less_than_a_block({"big": 1, **{f"s{i}": 1e-6 for i in range(20)}}, 3000)
    assert seen["big"] >= 2999


def _mixed_by_hand(rows, weights, end, block):
    """{(id, position)}: each slot goes to the source whose next block is released and due first, found by looking at all of them."""
    queues, at = {}, {}
    for i, s in rows:
        queues.setdefault(s, []).append((xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() >> 1, i))
    total, out = sum(weights.values()), set()
    share = {s: Fraction(w) / total for s, w in weights.items()}
    for t in range(end):
        released = [s for s in share if math.floor(at.get(s, 0) / share[s]) <= t]
        s = min(released, key=lambda s: (math.ceil((at.get(s, 0) + 1) / share[s]), s))
        k = at.get(s, 0)
        at[s] = k + 1
        out |= {(i, t * block + x) for x, (_, i) in enumerate(sorted(queues[s])[k * block : (k + 1) * block])}
    return out


def test_mixing_by_hand(spark, tmp_path):
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    counts = Counter(s for _, s in docs)
    blocks = {s: -(-n // mixing.BLOCK) for s, n in counts.items()}
    got = {(r.doc_id, r.mix_position) for r in mixing.op9_mixing(spark, SMALL).collect()}
    assert got == _mixed_by_hand(docs, blocks, sum(blocks.values()), mixing.BLOCK)
    named = dict(zip(sorted(counts), (5, 3, 1), strict=False))
    end = min(math.ceil(Fraction(-(-counts[s] // 2) * 9, w)) for s, w in named.items())
    got = {(r.doc_id, r.mix_position) for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, source string"), targets=named, stop="first", block=2).collect()}
    assert got == _mixed_by_hand(docs, named, end, 2)


def test_mixing(spark, odd, empty):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=4, most=0.25).collect()
    counts = {}
    for r in got:
        counts[r.source] = counts.get(r.source, 0) + 1
    assert len({r.doc_id for r in got}) == len(got) and len({r.mix_position for r in got}) == len(got)
    assert abs(counts["hot"] / len(got) - 0.25) < 0.01
    assert all(counts[s] == sum(1 for _, x in rows if x == s) for s in counts if s != "hot")
    for at in (400, 900, 1500):
        upto = [r for r in got if r.mix_position < at]
        assert abs(sum(r.source == "hot" for r in upto) - at * 0.25) <= 2 * 4
    exact = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), targets={"hot": 1, "s0": 1}, stop="first", block=4).collect()
    assert {r.source for r in exact} == {"hot", "s0"} and abs(sum(r.source == "hot" for r in exact) * 2 - len(exact)) <= 8
    assert mixing.mix(empty).count() == 0 and set(mixing.mix(odd).columns) >= set(odd.columns)


def test_mixing_of_odd_rows(spark, odd):
    """Null ids and sources, repeated rows, and columns named like the operator's own: all rows stay."""
    clash = odd.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("lane", "hash", "row", "part", "nth", "rank", "slots", "before", "block", "slot", "a.b", "mix_slot"))))
    got = mixing.mix(clash, block=3)
    assert sorted(got.columns) == sorted([*clash.columns, "mix_block", "mix_position"])
    rows = got.collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source), r.part, r["a.b"])
    assert sorted(map(key, rows)) == sorted(map(key, clash.collect()))
    assert len({r.mix_position for r in rows}) == len(rows)
    assert {r.source for r in mixing.mix(odd, targets={None: 1, "b": 2}).collect()} == {None, "b"}


def test_token_ledger(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, None, "s", "en"), (3, "d", "t", None)], "doc_id long, text string, source string, lang string")
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    entries = token_counts.token_counts(docs, BPE, "bpe")
    assert ledger.commit("1", entries) and not ledger.commit("1", entries)
    get = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert get() == {("s", "en", "words/1"): (2, 3), ("t", None, "words/1"): (1, 1), ("s", "en", "bpe"): (2, 3), ("t", None, "bpe"): (1, 1)}
    words = token_counts.token_counts(docs)
    longer = token_counts.token_counts(docs.withColumn("text", F.concat("text", F.lit(" x"))).where("doc_id = 1"))
    assert ledger.commit("2", deletes=words.where("doc_id = 3"), revised=(words.where("doc_id = 1"), longer))
    assert get()["s", "en", "words/1"] == (2, 4) and ("t", None, "words/1") not in get()
    assert ledger.commit("3") and get()["s", "en", "words/1"] == (2, 4)


def test_token_ledger_takes_one_of_several_attempts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en")], "doc_id long, text string, source string, lang string")
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    entries = token_counts.token_counts(docs)
    real, late = ledger._publish, []

    def slow(staged, batch):
        """The other attempt begins and ends between this one's writing and its rename."""
        if not late:
            late.append(staged)
            late.append(ledger.commit(batch, entries))
        return real(staged, batch)

    ledger._publish = slow
    assert not ledger.commit("1", entries) and late[1]
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "words/1", 1, 3)]
    assert sorted(x.name for x in (tmp_path / "ledger").iterdir()) == ["batch=1"]
    assert not [x for x in (tmp_path / "ledger" / "batch=1").iterdir() if x.is_dir()]


def test_op5_counts_what_the_tokenizers_library_counts(spark):
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(BPE), Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        for name, n in (("words/1", len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), ("byte_bpe_50k/1", len(plain.encode(r.text or "", add_special_tokens=False).ids))):
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += n
    got = Counter()
    for r in token_counts.op5_token_counts(spark, SMALL).collect():
        got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
    assert got == want


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model, host=F.col("source")).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    right, kept, n = got.agg(F.avg((F.col("lang") == F.col("true")).cast("double")), F.avg(F.col("kept").cast("double")), F.count(F.lit(1))).first()
    assert n == 500 and right > 0.97 and kept > 0.98


def test_language_id_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in language_id.identify(odd, language_id.fit(odd), declared=F.col("lang"), host=F.col("source")).collect()}
    assert not got[0].kept and not got[1].kept and got[0].lang is None
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert language_id.identify(odd, language_id.fit(empty)).where("kept").count() > 10


def test_language_prior_and_declaration_decide_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    few = docs.where("lang = 'fr'").limit(40).select("doc_id", "text", F.lit("h").alias("host")).unionByName(docs.where("lang = 'de'").limit(40).select("doc_id", "text", F.lit("g").alias("host")))
    one = spark.createDataFrame([(-1, "a", "h", "fr"), (-2, "a", "new", "de")], "doc_id long, text string, host string, said string")
    got = {r.doc_id: r.lang for r in language_id.identify(few.withColumn("said", F.lit(None).cast("string")).unionByName(one), model, declared=F.col("said"), host=F.col("host")).collect()}
    assert got[-1] == "fr" and got[-2] == "de"


def test_quality_rules(odd, empty):
    got = {r.doc_id: r for r in quality_rules.ledger(odd).collect()}
    assert got[0].n_words == 0 and got[0].failed_bits & 1 and got[8].n_dup_lines == 2 and got[6].failed_bits & 2
    rules = quality_rules.ledger(odd)
    rows = [r.failed_bits for r in rules.collect()]
    for r in quality_rules.ablations(rules).collect():
        mask, bit = quality_rules.POLICIES[r.policy], quality_rules.BITS[r.rule]
        assert (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) == (sum(bool(b & bit) for b in rows), sum(b & mask == bit for b in rows), sum(not b & mask for b in rows), sum(not b & mask & ~bit for b in rows))
    assert quality_rules.ledger(empty).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, minhash.minhash_dedup, suffix_blocks.suffix_dedup, license_scan.license_scan, quality_rules.ledger, lambda d: packing.pack(packing.measured(d)), token_counts.token_counts])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_empty_token_ids(empty, tmp_path):
    uri = f"file://{tmp_path}/none"
    assert token_ids.read_token_ids(token_ids.write_token_ids(empty, BPE, uri), uri).count() == 0


def test_odd_rows_pass_all(odd):
    assert packing.pack(packing.measured(odd)).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert token_counts.token_counts(odd, BPE, "b").count() == 2 * odd.count()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, same_rows, name):
    same_rows(catalog.queries()[name](spark, SMALL).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


def test_every_number_has_its_query():
    names = {n.split("_")[0] for n in catalog.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)}


def _packed_by_hand(rows, capacity=2048):
    """{(id, piece): (bin, offset, tokens)} of (id, tokens, source, cluster) in one shard, trying every open bin; whole pieces aren't in a bin of the shard."""
    rest = sorted(((n - (n - 1) // capacity * capacity, i, c, s, (n - 1) // capacity) for i, n, s, c in rows), key=lambda r: (-r[0], r[1], r[2]))
    bins, out = [], {}
    for n, i, c, s, piece in rest:
        fits = [(left, b) for b, (left, ss, cc) in enumerate(bins) if left >= n and s not in ss and c not in cc]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        out[i, piece] = (b, capacity - bins[b][0], n)
        bins[b][0] -= n
        bins[b][1] |= {s} - {None}
        bins[b][2].add(c)
    return out


def _measured_by_hand(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    squeezed = lambda t: hashlib.md5(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()
    return [(r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1, r.source, squeezed(r.text)) for r in rows]


def _is_packed_as(got, want, lengths):
    assert {(r.doc_id, r.piece): (r.bin_id, r.bin_offset, r.n_tokens) for r in got if r.bin_id >= 0} == want
    whole = [r for r in got if r.bin_id < 0]
    assert Counter(r.doc_id for r in whole) == Counter({i: (n - 1) // packing.CAPACITY for i, n in lengths.items() if n > packing.CAPACITY})
    assert len({r.bin_id for r in whole}) == len(whole) and all((r.bin_offset, r.n_tokens) == (0, packing.CAPACITY) for r in whole)


def test_op3_by_hand(spark):
    rows = _measured_by_hand(spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert len(rows) <= packing.SHARD
    _is_packed_as(packing.op3_packing(spark, SMALL).collect(), _packed_by_hand(rows), {i: n for i, n, *_ in rows})


def _identified_by_hand(docs):
    """{id: (language, probability, kept)}: the posterior of every language, in plain Python from the bytes on."""
    size, temper, declared, smoothing, k = language_id.BUCKETS, language_id.TEMPER, language_id.DECLARED, language_id.SMOOTHING, 0
    fold = lambda b: b + 32 if 65 <= b <= 90 else b
    letter = lambda b: 97 <= fold(b) <= 122 or b >= 128
    said = lambda b: letter(b) or b == 32 or 9 <= b <= 13

    def grams(text):
        b = (text or "").encode()
        return Counter((((fold(x) * 65599 + fold(y)) * 65599 + fold(z)) * 2654435761 % 2**32) >> 17 for x, y, z in zip(b, b[1:], b[2:], strict=False) if said(x) and said(y) and said(z))

    of = {r.doc_id: grams(r.text) for r in docs}
    n = Counter(r.lang for r in docs if r.text is not None and r.lang is not None)
    languages = sorted(x for x in n if n[x] >= language_id.LEAST_ROWS)
    assert max(n.values()) <= language_id.SAMPLE_ROWS
    sums = {x: Counter() for x in languages}
    for r in docs:
        if r.lang in sums:
            sums[r.lang].update(of[r.doc_id])
    logs = {x: (lambda c, total: lambda g: math.log((c[g] + 0.5) / total))(sums[x], sums[x].total() + size / 2) for x in languages}
    fits = {i: {x: sum(m * logs[x](g) for g, m in c.items()) for x in languages} for i, c in of.items()}
    p = {}
    for i, f in fits.items():
        top = max(f.values()) * temper
        e = {x: math.exp(v * temper - top) for x, v in f.items()}
        p[i] = {x: v / sum(e.values()) for x, v in e.items()}
    by_host = {}
    for r in docs:
        by_host.setdefault(r.source, []).append(r.doc_id)
    total = {x: sum(q[x] for q in p.values()) for x in languages}
    hosts = {h: {x: sum(p[i][x] for i in ids) for x in languages} for h, ids in by_host.items()}
    k, out = len(languages), {}
    for r in docs:
        own, w = p[r.doc_id], {}
        for x in languages:
            parent = (total[x] - own[x] + smoothing * total[x] / len(docs)) / (len(docs) - 1 + smoothing)
            prior = (hosts[r.source][x] - own[x] + smoothing * parent) / (len(by_host[r.source]) - 1 + smoothing)
            evidence = 1 if r.lang not in languages else declared if r.lang == x else (1 - declared) / max(k - 1, 1)
            w[x] = fits[r.doc_id][x] * temper + math.log(max(prior, 1e-12)) + math.log(evidence)
        best = max(w, key=w.get)
        probability = 1 / sum(math.exp(v - w[best]) for v in w.values())
        letters = any(letter(b) for b in (r.text or "").encode())
        likely = max(fits[r.doc_id].values()) / max(of[r.doc_id].total(), 1) >= -math.log(size)
        lacking = letters and r.lang is not None and r.lang not in languages
        out[r.doc_id] = (None if not letters else r.lang if lacking and not likely else best, probability, lacking or (letters and likely and probability >= language_id.LEAST_PROBABILITY))
    return out


def test_op7_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = _identified_by_hand(docs)
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, SMALL).collect()}
    assert set(got) == set(want)
    for i, (lang, probability, kept) in want.items():
        assert (got[i].lang, got[i].kept) == (lang, kept)
        assert got[i].probability is None or got[i].probability == pytest.approx(probability, abs=2e-6)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:3]:
        kept = stage(spark, kept, SMALL).cache()
        assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    told = {i for i, (_, _, ok) in _identified_by_hand(list(rows.values())).items() if ok}
    first, left = {}, []
    for i, t in sorted(_pairs(docs)):
        if i in told and first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i) == i:
            left.append((i, t))
    near = _similar(left, 5)
    want = {i for i, (_, c) in near.items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    mixed = [r.doc_id for r in p.STAGES[3][1](spark, kept, SMALL).collect()]
    counts = Counter(rows[i].source for i in want)
    blocks = {s: -(-n // mixing.BLOCK) for s, n in counts.items()}
    assert mixed == [i for i, _ in sorted(_mixed_by_hand([(i, rows[i].source) for i in want], blocks, sum(blocks.values()), mixing.BLOCK), key=lambda x: x[1])]
    pieces = _measured_by_hand([rows[i] for i in want])
    _is_packed_as(p.run(spark, SMALL).collect(), _packed_by_hand(pieces), {i: n for i, n, *_ in pieces})


def test_pipeline_of_odd_rows(spark):
    """Null and repeated ids, null sources, clashing columns and an empty table."""
    import corpus_pipeline as p

    stage, rng = dict(p.STAGES), random.Random(17)
    a, b = _text(rng, 60), _text(rng, 60)
    rows = [(None, "a b c"), (1, "d e f"), (2, "d e  f"), (2, "g h"), (5, "x y"), (5, "x y"), (None, "g  h"), (None, None), (7, ""), (10, a), (None, a + " more"), (11, b), (11, a.replace("tea", "tea", 1) + " end"), (12, b + " z")]
    docs = spark.createDataFrame([(i, t, "en", None if n % 2 else "s", 1, 2, "k") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, lane long, _n long, label string")
    got = [(r.doc_id, r.text) for r in stage["exact dedup"](spark, docs, SMALL).collect()]
    norm = lambda t: re.sub(r"\s+", " ", t or "")
    assert len(got) == len({norm(t) for _, t in got}) == len({norm(t) for _, t in rows})
    assert {(None, "a b c"), (1, "d e f"), (2, "g h"), (5, "x y"), (7, "")} <= set(got) or (None, "g  h") in got
    assert (1, "d e f") in got and (7, "") in got and got.count((5, "x y")) == 1
    left = [(r.doc_id, r.text) for r in stage["near dedup"](spark, docs.where("length(text) > 100"), SMALL).collect()]
    assert sorted(left, key=str) == sorted([(10, a), (12, b + " z")], key=str)
    said = stage["language ID"](spark, docs, SMALL)
    assert said.columns == docs.columns and {(r.doc_id, r.text) for r in said.collect()} >= {(None, "a b c"), (2, "g h")}
    mixed = stage["mixing"](spark, docs, SMALL)
    assert mixed.columns == docs.columns and Counter(map(str, mixed.collect())) == Counter(map(str, docs.collect()))
    assert stage["packing"](spark, docs, SMALL).groupBy().sum("n_tokens").first()[0] > len(rows)
    none = docs.where("false")
    for name, f in p.STAGES:
        assert f(spark, none, SMALL).count() == 0, name
