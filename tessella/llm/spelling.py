"""Spelling variants: words one edit apart by a self-join of vocabulary tries with active-node sets, and the form each goes back to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, partitions, stored, whole_text

#: A word has this many code points and occurrences at least; its form is this many times as frequent.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a code point.
EVERY = 97
#: Code points of the words of one trie; a larger one is split by where the edit lies.
TRIE = 200_000
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lower-cased, of LEAST_LENGTH code points and LEAST_COUNT occurrences at least.

    Where `every` divides the crc32 of `<id>:<run>`, the run loses the code point at that number modulo its length. A null text has
    no words, a null id is written as nothing. Counts are summed in each task before they are shuffled.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(whole_text(text_col), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.where(F.char_length("run") >= LEAST_LENGTH)
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    runs = runs.select("id", lowered.alias("run"))
    if every is not None:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run"))))
        place = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
        runs = runs.withColumn("run", F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")))
    return runs.where(F.char_length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_COUNT}")


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j), i < j, of distinct words at edit distance one.

    The trie is walked from its root. A node's active nodes are those whose strings are within one edit of its own: at distance
    none itself, and at distance one its parent, its siblings, its children and whatever the parent's active nodes have below
    the same character. Active nodes that end a word make a pair with a node that ends one.
    """
    below: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, word in enumerate(words):
        node = 0
        for c in word:
            to = below[node].get(c)
            if to is None:
                to = below[node][c] = len(below)
                below.append({})
                ends.append(-1)
            node = to
        ends[node] = i
    stack = [(0, set(below[0].values()))]
    while stack:
        node, active = stack.pop()
        for c, to in below[node].items():
            near = {y for x in active if (y := below[x].get(c)) is not None}
            near.update(below[node].values())
            near.update(below[to].values())
            near.add(node)
            near.discard(to)
            if ends[to] >= 0:
                for other in near:
                    if ends[other] > ends[to]:
                        yield ends[to], ends[other]
            stack.append((to, near))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a[:low] == b[:low], a[:n] != b[:n]
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _cells(words: DataFrame) -> DataFrame:
    """(word, n, m, low, high, cell): where a word can meet one that is an edit away.

    Of two such words m is the lesser length and the first position at which they differ lies in [0, m]. If it lies in [low, high),
    both have the same first `low` and last m - high code points; the cell is a hash of those.
    """
    length = F.char_length("word")
    lengths = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(f"m >= {LEAST_LENGTH}")
    return _halves(lengths.withColumn("low", F.lit(0)).withColumn("high", F.col("m") + 1))


def _halves(cells: DataFrame) -> DataFrame:
    middle = F.expr("(low + high) div 2").cast("int")
    both = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    rows = cells.select("word", "n", "m", F.explode(both).alias("at")).select("word", "n", "m", "at.low", "at.high")
    tail = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    return rows.withColumn("cell", F.xxhash64("m", "low", "high", F.substring(F.col("word"), F.lit(1), F.col("low")), F.substring(F.col("word"), F.char_length("word") - tail + 1, tail)))


def near_words(words: DataFrame, trie: int = TRIE) -> DataFrame:
    """(word, near, near_n): each word with each other one that is exactly one inserted, deleted or replaced code point away, and that one's n.

    Words are dealt by a part that an edit leaves alone: their beginning or their end, at half of the length. A cell of more than
    `trie` code points is split by the half in which the edit lies, again and again until one position is left, where only
    words that differ there meet, an alphabet at most. Each cell becomes one trie; a pair is taken where its first difference lies in
    the cell, so it comes out once. Words are distinct and not null.
    """
    cells = _cells(words)
    while True:
        large = cells.groupBy("cell").agg(F.sum(F.char_length("word")).alias("size"), F.min(F.col("high") - F.col("low")).alias("wide")).where(f"size > {trie} AND wide > 1").select("cell")
        if not large.limit(1).count():
            break
        large = stored(large)
        cells = stored(cells.join(large, "cell", "left_anti").unionByName(_halves(cells.join(large, "cell", "left_semi"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        cell, held = None, {}

        def flush() -> None:
            words = sorted(held)
            if len(words) < 2:
                return
            m, low, high = at
            for i, j in near_pairs(words):
                a, b = words[i], words[j]
                if min(len(a), len(b)) == m and low <= common_prefix(a, b) < high:
                    for x, y in ((a, b), (b, a)):
                        out[0].append(x)
                        out[1].append(y)
                        out[2].append(held[y])

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])
            for x in out:
                x.clear()
            return made

        at = (0, 0, 0)
        for batch in batches:
            for key, word, n, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, *where) != cell:
                    flush()
                    cell, at, held = (key, *where), tuple(where), {}
                    if len(out[0]) > 10_000:
                        yield batch_of()
                held[word] = n
        flush()
        yield batch_of()

    dealt = cells.select("cell", "word", "n", "m", "low", "high").repartition(partitions(words.sparkSession), "cell").sortWithinPartitions("cell", "m", "low", "high")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def forms(words: DataFrame, ratio: int = RATIO, trie: int = TRIE) -> DataFrame:
    """(word, n, n_near, form, form_n) of (word, n): the near word of the largest n, of equal ones the smallest, if that n is `ratio` times the word's at least."""
    best = near_words(words, trie).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    found = -F.col("best.less") >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.less")).alias("form_n"))


def roots(words: DataFrame) -> DataFrame:
    """words with root: the last of the forms that follow each other from the word, itself if it has none.

    Each form is more frequent than what it is the form of, so there are no circles; each round doubles how far a word sees.
    """
    steps = stored(words.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    while True:
        further = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        joined = stored(steps.join(further, "to", "left").select("word", "to", "next"))
        if not joined.where("next IS NOT NULL").limit(1).count():
            break
        steps = joined.select("word", F.coalesce("next", "to").alias("to"))
    return words.join(steps.select(F.col("word").alias("w"), "to"), F.col("word") == F.col("w"), "left").withColumn("root", F.coalesce("to", "word")).drop("w", "to")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of documents.

    Null texts have no words, rows of null or repeated ids count like others, other columns are ignored, an empty table has no
    vocabulary. Words of any length are compared whole.
    """
    return roots(stored(forms(stored(vocabulary(docs, id_col, text_col, every))))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir), every=EVERY)


def _sql() -> str:
    """Words by deleting each code point in turn; crc32 by half bytes."""

    def step(b: int) -> int:
        for _ in range(4):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return b

    key = "hex(coalesce(doc_id::VARCHAR, '') || ':' || run)"
    halves = f"list_transform(range(0, length({key})), lambda i: strpos('0123456789ABCDEF', substr({key}, (i // 2 * 2 + 2 - i % 2)::INT, 1)) - 1)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, b: xor(c >> 4, [{', '.join(str(step(b)) for b in range(16))}][(xor(c, b) & 15) + 1])), 4294967295)"
    return f"""WITH RECURSIVE l AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH}),
h AS MATERIALIZED (SELECT run, c, {crc} AS h FROM (SELECT doc_id, run, count(*) AS c FROM l GROUP BY ALL)),
w AS MATERIALIZED (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(c) >= {LEAST_COUNT}),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
o AS (SELECT d.word AS longer, w.word AS shorter FROM d JOIN w ON d.rest = w.word),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT longer, shorter FROM o UNION SELECT shorter, longer FROM o),
q AS (SELECT p.word, count(*) AS n_near, min({{'less': -x.n, 'near': p.near}}) AS best FROM p JOIN w x ON p.near = x.word GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= {RATIO} * w.n THEN best.near END AS form, CASE WHEN -best.less >= {RATIO} * w.n THEN (-best.less)::BIGINT END AS form_n FROM w LEFT JOIN q USING (word)),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, t.root, n, n_near, form_n FROM f JOIN t USING (word) WHERE t.root IN (SELECT word FROM f WHERE form IS NULL)"""


SQL = {"op13_spelling": _sql()}
