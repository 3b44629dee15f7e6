"""Inputs of which an operator once did only a part."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from tessella.llm import language_id, license_scan, mixing, packing


def test_small_sources_beyond_the_lanes_stay_in_the_mix(spark):
    n = 2 * mixing.LANES
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % n).cast("string").alias("source"))
    assert mixing.mix(docs, block=1).select("doc_id").distinct().count() == 2 * n


def test_a_named_source_beyond_the_lanes_is_mixed(spark):
    large = spark.range(3 * mixing.LANES).select(F.col("id").alias("doc_id"), (F.col("id") % mixing.LANES).cast("string").alias("source"))
    small = spark.createDataFrame([(-1, "small"), (-2, "small")], "doc_id long, source string")
    got = mixing.mix(large.unionByName(small), targets={"7": 1, "small": 1}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"7": 3, "small": 2}


def test_the_mix_keeps_a_hot_source(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    assert dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SMALL).select("doc_id").distinct().count() == 4000
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op9_mixing(spark, str(tmp_path)).select("doc_id").distinct().count() == 4000


def test_rare_languages_are_known_and_kept(spark):
    text, lang = F.concat(F.lit("the small green river is under the house "), F.col("id")), F.lit("en")
    for at, label, own in ((20000, "el", "το μικρό πράσινο ποτάμι είναι κάτω από το σπίτι"), (20006, "ka", "პატარა მწვანე მდინარე სახლის ქვეშ არის")):
        text, lang = F.when(F.col("id") >= at, F.lit(own)).otherwise(text), F.when(F.col("id") >= at, F.lit(label)).otherwise(lang)
    docs = spark.range(20008).select(F.col("id").alias("doc_id"), text.alias("text"), lang.alias("lang"))
    model = language_id.fit(docs)
    assert model.languages == ["el", "en"]
    got = language_id.identify(docs, model, declared=F.col("lang")).where("doc_id >= 19990").collect()
    assert all(r.kept and r.lang == ("ka" if r.doc_id >= 20006 else "el" if r.doc_id >= 20000 else "en") for r in got)


def test_bins_are_filled_by_token_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    texts = ["".join(chr(0x4E00 + i * 7 % 5000) for i in range(3000)), "tea", "a b  c", "", None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert want[0] > packing.CAPACITY
    for out in (packing.op3_packing(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, docs, SMALL)):
        got = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()
        assert {r.doc_id: r.n for r in got} == want and max(r.most for r in got) <= packing.CAPACITY


def test_each_license_line_of_documents(spark):
    want = {
        "Released under the MIT License.": {"mit"},
        "Licensed under the MIT license": {"mit"},
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
        "Released under the Apache License": set(),
        "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
        "All rights reserved.": {"reserved"},
    }
    docs = spark.createDataFrame([(i, f"tea and water\n{line}\nmit dem Haus") for i, line in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan.license_scan(docs).collect()}
    for i, (line, labels) in enumerate(want.items()):
        assert labels <= got[i] and ("mit" in got[i]) == ("mit" in labels), line


def test_wrapped_notices(spark):
    """Any line breaks of notices; but none is put together from two documents."""
    want = {
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": {"mpl-2.0"},
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided": {"bsd"},
        "x\n * Permission is hereby granted, free\n * of charge, to any person obtaining\n * a copy of this software": {"mit"},
        "Permission is hereby granted, free\nof charge, to any\n\n\n person obtaining a\ncopy of this software": {"mit"},
        "under the\nmit license": {"mit"},
        "This Source Code Form\nis subject to the terms\nof the Mozilla Public\nLicense, v. 2.0.": {"mpl-2.0"},
        "licensed under\nthe Apache License\nversion 2.0": {"apache-2.0"},
        "Licensed under the Apache License (the \"License\"),\nVersion 2.0": {"apache-2.0"},
        "// SPDX-License-Identifier: MIT": {"mit"},
        "# SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
        "MIT License\n\nCopyright (c) 2020": {"mit"},
        "Mozilla Public License 2.0": {"mpl-2.0"},
        "this source code form is subject to the terms": set(),
        "of the mozilla public license v 2 0": set(),
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan.license_scan(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_packed_sequences_hold_the_tokens_of_their_pieces(spark):
    import numpy as np
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(1, "tea and water " * 40, "a"), (2, None, "b"), (3, "\u6f22\u5b57 " * 90, "a"), (4, "one more", "c")], "doc_id long, text string, source string")
    want = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = packing.pack(packing.measured(docs, tokenizer=path), capacity=64)
    where = {(r.bin_id, r.bin_offset): (r.doc_id, r.piece, r.n_tokens) for r in pieces.collect()}
    found = {}
    for r in packing.packed_sequences(pieces, docs, path, capacity=64).collect():
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == 64 and not ids[r.n_tokens :].any()
        for at in r.starts:
            doc, piece, n = where.pop((r.bin_id, at))
            found[doc, piece] = ids[at : at + n].tolist()
    assert not where
    assert {d: sum((found[d, k] for k in sorted(k for x, k in found if x == d)), []) for d in want} == want
