"""Token-ID output: Arrow files of fixed-size-list batches, read back by memory map without a copy."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, byte_class, documents, gather, partitions, raw, shared_dir, slices, small_batches, stored, word_hashes

#: Ids in a sequence, sequences in a record batch.
SEQUENCE, BATCH = 2048, 512
#: A byte-level BPE never joins across white space that follows something else: none of its pre-tokens has white space
#: within, and its only look-ahead stands at the end of white space. So texts may be cut before each white space that
#: stands alone.


_SPACE = byte_class(inside=SPACES)


class CachedBpe:
    """The tokenizers library over pieces of text, each different piece once while the cache lasts.

    Texts are cut before each white space into pieces, which are looked up by a hash and compared byte by byte. What is kept
    of a piece is its bytes and its ids, some 40 bytes; beyond `kept` pieces only those of the present batch stay.
    """

    def __init__(self, path: str, kept: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = json.loads(self.tokenizer.to_str())
        before = plain.get("pre_tokenizer") or {}
        #: Only then may texts be cut into pieces.
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not plain.get("normalizer")
        #: Bytes of text that each id stands for: a byte-level vocabulary has one character a byte.
        self.widths = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.widths[i] = len(token)
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.keys, self.text_at, self.text_n, self.ids_at, self.ids_n = (np.zeros(0, t) for t in (np.uint64, *[np.int64] * 4))
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _encode_pieces(self, d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece). Pieces that begin with white space and end with none are encoded as one text, where no token crosses from one to the next, and cut where the tokens' widths add up to the pieces'."""
        joins = _SPACE[d[starts]] & ~_SPACE[d[ends - 1]]
        parts: list[np.ndarray] = [np.zeros(0, self.kind)] * len(starts)
        plain = np.flatnonzero(joins)
        runs = [plain[at : at + 2000] for at in range(0, len(plain), 2000)]
        sizes = [ends[r] - starts[r] for r in runs]
        texts = [gather(d, starts[r], n).tobytes().decode() for r, n in zip(runs, sizes, strict=True)]
        for r, n, e in zip(runs, sizes, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(n)) + 1
            at = 0
            for i, cut in zip(r.tolist(), cuts.tolist(), strict=True):
                parts[i] = ids[at:cut]
                at = cut
        rest = np.flatnonzero(~joins).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([d[starts[i] : ends[i]].tobytes().decode() for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, self.kind)
        return np.concatenate([*parts, np.zeros(0, self.kind)]), np.fromiter(map(len, parts), np.int64, len(parts))

    def _learn(self, h: np.ndarray, d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, n = self._encode_pieces(d, starts, ends)
        text = gather(d, starts, ends - starts)
        keys = np.concatenate([self.keys, h])
        order = np.argsort(keys, kind="stable")
        sizes = ends - starts
        self.text_at = np.concatenate([self.text_at, len(self.text) + np.cumsum(sizes) - sizes])[order]
        self.text_n = np.concatenate([self.text_n, sizes])[order]
        self.ids_at = np.concatenate([self.ids_at, len(self.ids) + np.cumsum(n) - n])[order]
        self.ids_n = np.concatenate([self.ids_n, n])[order]
        self.keys, self.text, self.ids = keys[order], np.concatenate([self.text, text]), np.concatenate([self.ids, ids])

    def _simple(self, d: np.ndarray, o: np.ndarray) -> np.ndarray:
        """For each row whether it may be cut before each white space: no two of these together, none beyond ASCII, and no added token."""
        if not self.cuts:
            return np.zeros(len(o) - 1, bool)
        bad = np.zeros(len(d) + 1, bool)
        if len(d) > 1:
            space, x, y = _SPACE[d], d[:-1], d[1:]
            bad[: len(d) - 1] = space[:-1] & space[1:]
            bad[: len(d) - 1] |= ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A)) | ((x == 0xE2) & (y == 0x81)) | ((x == 0xE3) & (y == 0x80))
            if len(d) > 2:
                z = d[2:]
                bad[: len(d) - 2] |= (d[:-2] == 0xE2) & (d[1:-1] == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            bad[o[1:][o[1:] > 0] - 1] = False  # a pair across two rows is none
        total = np.concatenate([[0], np.cumsum(bad[:-1])])
        out = total[o[1:]] == total[o[:-1]]
        if self.added:
            whole = d.tobytes()
            for token in self.added:
                at = whole.find(token)
                while at >= 0:
                    out[max(np.searchsorted(o, at, "right") - 1, 0)] = False
                    at = whole.find(token, at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of texts as bytes and offsets, some at a time: (ids one after another, their number by row)."""
        for _, _, d, o in slices(data, offsets):
            simple = self._simple(d, o)
            n = np.zeros(len(o) - 1, np.int64)
            row = np.repeat(np.arange(len(o) - 1), np.diff(o))
            begin = _SPACE[d].copy()
            begin[o[:-1][o[1:] > o[:-1]]] = True
            starts = np.flatnonzero(begin & simple[row])
            nothing = np.zeros(0, self.kind)
            pieces = nothing
            of = row[starts]
            if len(starts):
                cut = np.append(np.flatnonzero(begin), len(d))
                ends = cut[np.searchsorted(cut, starts) + 1]
                h = word_hashes(d, starts, ends)
                order = np.argsort(h)
                new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
                first = order[new]
                if len(self.keys) + len(first) > self.kept:
                    self._forget()
                at = np.searchsorted(self.keys, h[first])
                known = at < len(self.keys)
                known[known] = self.keys[at[known]] == h[first][known]
                if not known.all():
                    fresh = first[~known]
                    self._learn(h[fresh], d, starts[fresh], ends[fresh])
                    at = np.searchsorted(self.keys, h[first])
                slot = np.empty(len(h), np.int64)
                slot[order] = at[np.cumsum(new) - 1]
                sizes = ends - starts
                wrong = self.text_n[slot] != sizes
                right = np.flatnonzero(~wrong)
                unlike = gather(d, starts[right], sizes[right]) != gather(self.text, self.text_at[slot[right]], sizes[right])
                wrong[right[np.add.reduceat(unlike, np.cumsum(sizes[right]) - sizes[right]) > 0]] = True
                for i in np.unique(of[wrong]):  # two pieces of one hash: the row is encoded whole
                    simple[i] = False
                keep = simple[of]
                slot, of = slot[keep], of[keep]
                pieces = gather(self.ids, self.ids_at[slot], self.ids_n[slot])
                n += np.bincount(of, self.ids_n[slot], len(n)).astype(np.int64)
            if simple.all():
                yield pieces, n
                continue
            edge = np.concatenate([[0], np.cumsum(n)])
            out = []
            for i in range(len(n)):
                if simple[i]:
                    out.append(pieces[edge[i] : edge[i + 1]])
                else:
                    out.append(self.whole(d[o[i] : o[i + 1]].tobytes().decode()))
                    n[i] = len(out[-1])
            yield np.concatenate([*out, nothing]), n


def encoded_texts(bpe: CachedBpe, texts: list[str | None]) -> list[np.ndarray]:
    """The ids of each text; null is empty."""
    out = []
    for flat, n in bpe.encode(*raw(pa.array(texts, pa.string()))):
        out += np.split(flat, np.cumsum(n)[:-1])
    return out


_LOADED: dict[str, CachedBpe] = {}


def loaded(path: str) -> CachedBpe:
    """The tokenizer of this Python worker, whose caches last from task to task."""
    if path not in _LOADED:
        _LOADED[path] = CachedBpe(path)
    return _LOADED[path]


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of a full URI: file, hdfs, gs, abfs and s3, of which s3a is Spark's name. Other stores raise an error, here and not half-way."""
    try:
        return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
    except pa.ArrowInvalid as error:
        raise ValueError(f"shards can't be written to {uri}: {error}") from error


def _schema(kind: np.dtype, sequence: int) -> pa.Schema:
    ids = pa.from_numpy_dtype(kind)
    return pa.schema([("ids", pa.list_(pa.field("item", ids, False), sequence)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence))])


def write_shard(uri: str, name: str, docs: Iterator[tuple[int | None, bytes]], kind: np.dtype, sequence: int = SEQUENCE) -> Iterator[tuple[int | None, int, int]]:
    """Writes one shard, `name`.arrow, in the Arrow file format, and yields (doc_id, start in the shard, ids) as it goes.

    Each record batch has BATCH sequences of `sequence` ids; mask, of bits, is true for an id, false for the padding after the last. A task
    writes under a name of its own attempt and then renames, so a task that runs again replaces the shard whole.
    """
    fs, folder = _place(uri)
    fs.create_dir(folder, recursive=True)
    context = TaskContext.get()
    temporary = f"{folder}/_{name}-{context.taskAttemptId() if context else 0}"
    schema, room = _schema(kind, sequence), sequence * BATCH
    waiting, held, start = [], 0, 0

    def batch(ids: np.ndarray) -> pa.RecordBatch:
        padded = np.zeros(-(-len(ids) // sequence) * sequence, kind)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=schema.field(i).type) for i, x in enumerate((padded, mask))], schema=schema)

    with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, schema) as writer:
        for doc, ids in docs:
            n = len(ids) // kind.itemsize
            yield doc, start, n
            start += n
            waiting.append(ids)
            held += n
            if held >= room:
                flat = np.frombuffer(b"".join(waiting), kind)
                full = held // room * room
                for at in range(0, full, room):
                    writer.write_batch(batch(flat[at : at + room]))
                waiting, held = [flat[full:].tobytes()], held - full
        if held:
            writer.write_batch(batch(np.frombuffer(b"".join(waiting), kind)))
    fs.move(temporary, f"{folder}/{name}.arrow")


class Shard:
    """Random access to a shard: ids(start, n) and sequence_and_mask(i) are views into the mapped file where the store allows it."""

    def __init__(self, uri: str, name: str):
        fs, folder = _place(uri)
        path = f"{folder}/{name}.arrow"
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self._last: tuple = (-1, None)

    def _flat(self, i: int) -> np.ndarray:
        if self._last[0] != i:
            self._last = (i, self.reader.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True))
        return self._last[1]

    def sequence_and_mask(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """A sequence as a view of its ids and a view of its mask's bits."""
        b, r = divmod(i, BATCH)
        return self._flat(b)[r * self.sequence : (r + 1) * self.sequence], self.reader.get_batch(b).column(1)[r].values

    def ids(self, start: int, n: int) -> np.ndarray:
        room, parts = self.sequence * BATCH, []
        while n > 0:
            b, r = divmod(start, room)
            take = min(n, room - r)
            parts.append(self._flat(b)[r : r + take])
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])


def write_token_ids(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the shards of `uri` and returns the stored index (shard, doc_id, start in the shard, n_tokens).

    Documents are range-partitioned and sorted by id, so shard after shard their ids stand in ascending order of id (nulls
    first; rows that repeat an id in the order of their texts). Each shard has sequences of its own and starts a new one.
    Ids take 2 bytes where the vocabulary allows. A null or empty text is its end id alone; no rows make no shards.
    """
    small_batches(docs.sparkSession, 500)
    _place(uri)
    n = shards or partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], bpe.kind).tobytes()
        first = next(batches, None)
        while first is not None and not len(first):
            first = next(batches, None)
        if first is None:
            return

        def rows() -> Iterator[tuple[int | None, bytes]]:
            batch = first
            while batch is not None:
                ids = iter(batch.column(0).to_pylist())
                for flat, n in bpe.encode(*raw(batch.column(1))):
                    packed, edges = flat.tobytes(), (np.cumsum(n) * bpe.kind.itemsize).tolist()
                    at = 0
                    for edge in edges:
                        yield next(ids), packed[at:edge] + end
                        at = edge
                batch = next(batches, None)

        made: list[tuple] = []
        for row in write_shard(uri, f"shard-{shard:06d}", rows(), bpe.kind, sequence):
            made.append((shard, *row))
            if len(made) == 50_000:
                yield _index(made)
                made = []
        yield _index(made)

    def _index(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.int64()) for i in range(4)], names=["shard", "doc_id", "start", "n_tokens"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = plain.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(run, "shard long, doc_id long, start long, n_tokens long"))


def read_token_ids(index: DataFrame, uri: str) -> DataFrame:
    """Reads the shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, first_id, last_id.

    A shard's place among all ids is the sum of those before it: totals by shard, one row each, are added up and joined back.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each file
    before, base = 0, {}
    for shard, n in sorted(map(tuple, totals)):
        base[shard], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file = -1, None
        for batch in batches:
            made = []
            for s, doc, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, file = s, Shard(uri, f"shard-{s:06d}")
                ids = file.ids(start, n).astype("<u4")
                made.append((doc, base[s] + start, n, zlib.crc32(ids.tobytes()), int(ids[0]), int(ids[-1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.int64()) for i in range(6)], names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "last_id"])

    dealt = index.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = shared_dir(spark)
    return read_token_ids(write_token_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), uri), uri)
