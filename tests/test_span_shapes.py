"""Quantities by the shape of a text against those of the text itself."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tessella.operators import spans as S
from test_spans import CASES


def test_a_shape_has_the_places_of_its_text():
    rng = random.Random(11)
    words = "HR OR aOR MD beta p p= n n= to and - – / % ‰ percent CI mg mg/kg weeks sessions , . ( ) : = < −".split() + [" ", "  ", "\n", "_", "x", "é", "ICD-", "DSM-5-TR-", "Figure ", "phase ", "level-", "risk ratio ", "٣"]
    number = lambda: "".join(rng.choice("0123456789012") for _ in range(rng.choice([1, 1, 2, 3, 4, 4, 5]))) + rng.choice(["", "", ".5", ",5", ",050", ",0000", ".", ","])
    year = lambda: str(rng.choice([1599, 1600, 1999, 2000, 2099, 2100, 1000, 999]))
    texts = [text for text, _ in CASES] + ["".join(rng.choice([number, number, year, lambda: rng.choice(words), lambda: rng.choice(words)])() + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(6000)]
    found = 0
    for text in texts:
        want = S.owned_quantities(text)
        assert [(r[0], r[2], r[3]) for r in S.owned_quantities(S.shape_of(text))] == [(r[0], r[2], r[3]) for r in want]
        assert all(text[r[2] : r[3]] == r[1] for r in want)
        found += len(want)
    assert found > 20_000


def test_notes_of_keys(spark):
    rows = [(1, "5 mg, 12%"), (1, None), (1, "7 in 2019"), (2, None), (4, "none"), (None, "n = 3"), (None, "2 of"), (5, "v2"), (5, "8"), (5, "9")]
    frame = spark.createDataFrame(rows, "id int, text string").repartition(4)
    for size in (1, 2000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.id: (r.n, r.q) for r in S.quantity_notes(frame, "id", F.col("text")).collect()}
        assert got == {1: (4, "number:7@0|unit:5 mg@0|year:2019@5|percent:12%@6"), None: (2, "count:n = 3@0|number:2@0"), 5: (2, "number:8@0|number:9@0")}


def test_many_texts_of_few_shapes_are_read_in_time(spark):
    """Twelve quantities in each of 300,000 texts; searched one by one these took more than the limit."""
    text = F.concat(F.lit("In 2003, HR 0.4 (95% CI 0.1 to 3.5), p < 0.01; of n = "), (F.col("id") % 900).cast("string"), F.lit(" some 3/17 (21.5%) took 5 mg for 6 or 3 weeks, see Figure 2; 10-20% and 1,234 or "), F.col("id").cast("string"))
    began = time.perf_counter()
    got = S.quantity_notes(spark.range(300_000), "id", text).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    assert got.rows == 300_000 and got.n == 300_000 * len(S.owned_quantities("In 2003, HR 0.4 (95% CI 0.1 to 3.5), p < 0.01; of n = 5 some 3/17 (21.5%) took 5 mg for 6 or 3 weeks, see Figure 2; 10-20% and 1,234 or 77"))
    assert time.perf_counter() - began < 15
