"""Packing follows the order of the mix, whatever files it lies in."""

from __future__ import annotations

import random
from functools import partial
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from conftest import SMALL
from tessella.llm import packing
from tessella.llm.common import file_order

STAGE = dict(corpus_pipeline.STAGES)


def _docs(spark):
    rng = random.Random(23)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice([3, 40, 200, 900, 2500]))), rng.choice(["hot", "hot", "b", None])) for i in range(300)]
    return spark.createDataFrame([*rows, (None, "a b", "b"), (None, "a b", "b"), (7, None, "hot")], "doc_id long, text string, source string").repartition(3)


def _written(docs, path):
    """The table of docs, and its rows as they lie in its files."""
    docs.write.parquet(path)
    rows = [r for f in sorted(Path(path).glob("part-*")) for r in pq.read_table(f).to_pylist()]
    return docs.sparkSession.read.parquet(path), rows


def _by_hand(spark, rows, shard, capacity=packing.CAPACITY):
    """Sorted (doc_id, piece, bin_id, bin_offset, n_tokens, bin_place) of rows in order, a stretch at a time."""
    at = [{**r, "at": i} for i, r in enumerate(rows)]
    told = packing.tokenized(spark.createDataFrame([(r["at"], r["text"], r["source"]) for r in at], "doc_id long, text string, source string")).collect()
    told = {r.doc_id: r for r in told}
    shards, out, before, stretches = max(1, -(-len(rows) // shard)), [], 0, {}
    for r in at:
        whole = (told[r["at"]].n_tokens - 1) // capacity
        out += [(r["doc_id"], k, -1 - before - k, 0, capacity, r["at"] + before + k) for k in range(whole)]
        stretches.setdefault(r["at"] * shards // len(rows), []).append((told[r["at"]].n_tokens - whole * capacity, r["doc_id"], whole, r["source"], told[r["at"]].cluster, r["at"] + before + whole))
        before += whole
    for k, stretch in stretches.items():
        stretch.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        got = packing.best_fit([r[0] for r in stretch], [r[3] for r in stretch], [r[4] for r in stretch])
        first = {}
        for (b, _), r in zip(got, stretch, strict=True):
            first[b] = min(first.get(b, r[5]), r[5])
        out += [(r[1], r[2], k * 2**32 + b, x, r[0], first[b]) for (b, x), r in zip(got, stretch, strict=True)]
    return out


def _rows(packed):
    return [tuple(r[c] for c in ("doc_id", "piece", "bin_id", "bin_offset", "n_tokens", "bin_place")) for r in packed.collect()]


@pytest.mark.parametrize("shard", [40, packing.SHARD])
def test_packing_follows_the_mix(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(corpus_pipeline, "pack", partial(packing.pack, shard=shard))
    docs = _docs(spark).where("doc_id <> 7 OR text IS NOT NULL").dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    mixed, order = _written(STAGE["mixing"](spark, docs, SMALL), f"{tmp_path}/mixed")
    plain, other = _written(docs.orderBy("doc_id"), f"{tmp_path}/plain")
    assert len(order) == len(other) == 300 and order != other and len(set(Path(f"{tmp_path}/mixed").glob("part-*"))) > 1
    got, without = (_rows(STAGE["packing"](spark, x, SMALL)) for x in (mixed, plain))
    assert sorted(got) == sorted(_by_hand(spark, order, shard))
    assert sorted(without) == sorted(_by_hand(spark, other, shard))
    assert sorted(got) != sorted(without)
    bins = {b: p for _, _, b, _, _, p in got}
    assert len(set(bins.values())) == len(bins)
    # The first pieces of bins, by bin_place, are in the order of the mix.
    at = {r["doc_id"]: i for i, r in enumerate(order)}
    firsts = [min(at[i] for i, _, b, *_ in got if b == x) for x in sorted(bins, key=bins.get)]
    assert firsts == sorted(firsts)


def test_rows_that_repeat_are_told_by_their_place(spark, tmp_path):
    mixed, order = _written(STAGE["mixing"](spark, _docs(spark), SMALL), f"{tmp_path}/mixed")
    got = _rows(packing.pack(packing.tokenized(file_order(mixed, "place"), order="place"), shard=25, order="place"))
    want = _by_hand(spark, order, 25)
    assert sorted((str(r[0]), r[1], r[4]) for r in got) == sorted((str(r[0]), r[1], r[4]) for r in want)
    ends = {}
    for _, _, b, at, n, _ in sorted(got, key=lambda r: r[3]):
        assert at >= ends.get(b, 0)
        ends[b] = at + n
    assert max(ends.values()) <= packing.CAPACITY and len({(r[2], r[5]) for r in got}) == len(ends) == len({r[5] for r in got})


def test_a_frame_without_files_is_in_its_own_order(spark):
    docs = _docs(spark).where("doc_id <> 7 OR text IS NOT NULL").where("doc_id IS NOT NULL")
    mixed = STAGE["mixing"](spark, docs, SMALL)
    assert sorted(_rows(STAGE["packing"](spark, mixed, SMALL))) == sorted(_by_hand(spark, [r.asDict() for r in mixed.collect()], packing.SHARD))


def test_order_of_files(spark, tmp_path):
    names = ["part-2-x-c000.snappy.parquet", "part-00010-x-c999.snappy.parquet", "part-00010-x-c1000.snappy.parquet", "part-99999-x-c000.snappy.parquet", "part-100000-x-c000.snappy.parquet", "a.parquet", "b.parquet"]
    for i, name in enumerate(names):
        pq.write_table(pa.table({"i": [10 * i + k for k in range(3)], "_metadata": ["x"] * 3}), f"{tmp_path}/{name}")
    docs = spark.read.parquet(str(tmp_path))
    assert [r.i for r in file_order(docs, "place").orderBy("place").collect()] == [10 * i + k for i in range(len(names)) for k in range(3)]


def test_sequences_keep_the_place_of_their_bin(spark, tmp_path):
    tokenizer = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = _docs(spark).where("doc_id <> 7 AND doc_id < 60")
    mixed, _ = _written(STAGE["mixing"](spark, docs, SMALL), f"{tmp_path}/mixed")
    packed = STAGE["packing"](spark, mixed, SMALL)
    got = packing.packed_sequences(packed, mixed, tokenizer).select("bin_id", "bin_place").collect()
    assert sorted(got) == sorted(packed.select("bin_id", "bin_place").distinct().collect())
