"""Suffix-array dedup of repeated byte strings: blockwise suffix sorting, with long ties resolved by precomputed difference-cover ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, gather, mixed, partitions, raw, small_batches, stored, word_hashes

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: The least hash of a string's runs of SEED bytes decides on the part it goes to.
SEED = 20
#: A perfect difference cover: every residue modulo PERIOD is the difference of two of COVER.
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: Bytes of a text block (a longer document is a block of its own), and of what is cut into segments at a time.
BLOCK, PIECE = 4 << 20, 1 << 20
#: Parts for each shuffle partition; bytes of segments of a part that are held, and of those that are sorted together.
PARTS, HELD, SORTED = 4, 16 << 20, 1 << 20
#: Suffixes of a bucket; a larger one is split again by its next bytes.
BUCKET = 1 << 16
#: A key that more blocks have is sent string by string, so that no part gets all that surrounds it: beyond about HELD bytes.
OFTEN = 20_000
_NO_ID = 2**63 - 1
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
#: By the residues of two positions: the least shift after which both are in the cover.
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)], np.int32)


def _seeds(d: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each position on."""

    def after(a: np.ndarray, b: np.ndarray, gap: int, size: int) -> np.ndarray:
        n = max(min(len(a), len(b) - gap), 0)
        return a[:n] * np.uint64(pow(0x9E3779B97F4A7C15, size, 2**64)) + b[gap : gap + n]

    one = _BYTE[d]
    two = after(one, one, 1, 1)
    four = after(two, two, 2, 2)
    eight = after(four, four, 4, 4)
    return mixed(after(after(eight, eight, 8, 8), four, 16, 4))


def _least(h: np.ndarray) -> np.ndarray:
    """The least seed hash in the string of LENGTH bytes from each position on."""
    width, size = LENGTH - SEED + 1, 1
    while 2 * size <= width:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, document, key) of runs of starts in one document whose strings have the same least hash; the key is 48 bits made of it. Equal strings have the same, so they meet in one part."""
    edge = np.zeros(len(d) + 1, np.int8)
    inside = o[1:] - o[:-1] >= LENGTH
    edge[o[:-1][inside]] += 1
    np.add.at(edge, o[1:][inside] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a in range(0, max(len(d) - LENGTH + 1, 0), PIECE):
        least = _least(_seeds(d[a : a + PIECE + LENGTH - 1]))
        ok = valid[a : a + len(least)]
        same = np.zeros(len(least) + 1, bool)
        same[1:-1] = ok[1:] & ok[:-1] & (least[1:] == least[:-1])
        first = np.flatnonzero(ok & ~same[:-1])
        out.append((first + a, np.flatnonzero(ok & ~same[1:]) - first + 1, mixed(least[first]) >> np.uint64(16)))
    first, count, key = (np.concatenate(x) for x in zip(*out, strict=True))
    return first, count, np.searchsorted(o, first, "right") - 1, key


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """A range of keys, so that the differences between a part's sorted keys are small."""
    return (((key >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def same_pieces(d: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least_first: np.ndarray) -> np.ndarray:
    """For each piece the number of the first equal one in the order of `least_first`; bytes are compared, hashes only lead to them."""
    h = word_hashes(d, starts, starts + lengths)
    order = np.lexsort((least_first, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    head = np.empty(len(h), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    twin = np.flatnonzero(head != np.arange(len(h)))
    if len(twin):
        fits = lengths[twin] == lengths[head[twin]]
        head[twin[~fits]] = twin[~fits]
        twin = twin[fits]
    if len(twin):
        unlike = gather(d, starts[twin], lengths[twin]) != gather(d, starts[head[twin]], lengths[twin])
        bad = np.logical_or.reduceat(unlike, np.cumsum(lengths[twin]) - lengths[twin])
        head[twin[bad]] = twin[bad]
    return head


def _packed(*arrays: np.ndarray) -> bytes:
    plain = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(plain, asbytes=True)


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    view = memoryview(blob)
    plain = pa.Codec("zstd").decompress(view[8:], int.from_bytes(view[:8], "little"))
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    sizes = np.frombuffer(plain, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(plain, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, np.int64)


def _rows(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names.split())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents in blocks of about BLOCK bytes: (block, ids, text), the text compressed, with each document's size."""
    held: list[tuple] = []
    context = TaskContext.get()
    size, number = 0, (context.partitionId() if context else 0) << 32

    def block() -> pa.RecordBatch:
        ids, data, sizes = zip(*held, strict=True)
        ids = pa.concat_arrays(ids)
        blob = _packed(np.concatenate(sizes), np.concatenate(data))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, pa.array([blob], pa.binary())], names=["block", "ids", "text"])

    for batch in batches:
        data, o = raw(batch.column(1))
        at, n = 0, len(batch)
        while at < n:
            end = min(n, max(at + 1, int(np.searchsorted(o, o[at] + BLOCK - size, "right")) - 1))
            if size and o[end] - o[at] + size > BLOCK:
                yield block()
                held, size, number = [], 0, number + 1
                continue
            held.append((batch.column(0).slice(at, end - at), data[o[at] : o[end]].copy(), np.diff(o[at : end + 1])))
            size, at = size + o[end] - o[at], end
    if held:
        yield block()


def _text(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes, data = _unpacked(blob, np.int64, np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def _distinct(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's segments in the order of part and key: that order, and where each different pair begins."""
    order = np.lexsort((key, part))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
    return order, np.flatnonzero(new)


def _announce(parts: int):
    """First pass: each block's different keys, by part, and whether two documents of the block have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d, o = _text(blob.as_buffer())
                _, _, doc, key = segments(d, o)
                part = _part(key, parts)
                order, first = _distinct(part, key)
                if not len(first):
                    continue
                of, keys = part[order[first]], key[order[first]]
                several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
                edges = _edges(of)
                yield _rows([(int(of[a]), block, _packed(np.diff(keys[a:b], prepend=np.uint64(0)), np.packbits(several[a:b]))) for a, b in zip(edges[:-1], edges[1:], strict=True)], "part block blob", (pa.int64(), pa.int64(), pa.binary()))

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block's list of a part, which of its keys other documents have, too: 0 none, 1 some, 2 in more than OFTEN blocks."""
    lists = [(np.cumsum(x, dtype=np.uint64), bits) for x, bits in (_unpacked(b, np.uint64, np.uint8) for b in rows["blob"])]
    values, counts = np.unique(np.concatenate([x for x, _ in lists]), return_counts=True)
    mark = (counts > 1).astype(np.uint8) + (counts > OFTEN)
    for x, bits in lists:
        at = np.searchsorted(values, x[np.unpackbits(bits, count=len(x)).astype(bool)])
        mark[at] = np.maximum(mark[at], 1)
    out = rows[["block", "part"]].copy()
    out["marks"] = [_packed(mark[np.searchsorted(values, x)]) for x, _ in lists]
    return out


def _runs_rows(block: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs (document of its block, start, number of starts) by block."""
    order = np.argsort(block, kind="stable")
    edges = _edges(block[order])
    some = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return _rows([(int(block[x[0]]), _packed(row[x].astype(np.uint32), at[x].astype(np.uint32), n[x].astype(np.uint32))) for x in some], "block blob", (pa.int64(), pa.binary()))


def _send(parts: int):
    """Second pass: segments whose key another document has, by part. Of equal segments in a block only those of the smallest id go; the others are repeats already, and are passed on as such (a negative part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, blob, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if not marks.is_valid or not len(marks.values):
                    continue
                d, o = _text(blob.as_buffer())
                ids = ids.values.fill_null(_NO_ID).to_numpy()
                first, count, doc, key = segments(d, o)
                part = _part(key, parts)
                order, new = _distinct(part, key)
                found = sorted((m["part"].as_py(), m["marks"].as_buffer()) for m in marks.values)
                mark = np.empty(len(order), np.uint8)
                mark[order] = np.repeat(np.concatenate([_unpacked(m, np.uint8)[0] for _, m in found]), np.diff(np.append(new, len(order))))
                sub = (mixed(key) >> np.uint64(56)).astype(np.uint8)
                once, often = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
                if len(often):
                    n = count[often]
                    starts = np.arange(n.sum()) + np.repeat(first[often] - np.cumsum(n) + n, n)
                    h = mixed(word_hashes(d, starts, starts + LENGTH))
                    first, count, doc = np.concatenate([first[once], starts]), np.concatenate([count[once], np.ones(len(starts), np.int64)]), np.concatenate([doc[once], np.repeat(doc[often], n)])
                    part, sub = np.concatenate([part[once], _part(h >> np.uint64(16), parts)]), np.concatenate([sub[once], (mixed(h) >> np.uint64(56)).astype(np.uint8)])
                else:
                    first, count, doc, part, sub = first[once], count[once], doc[once], part[once], sub[once]
                if not len(first):
                    continue
                head = same_pieces(d, first, count + LENGTH - 1, ids[doc])
                repeat = ids[doc] > ids[doc[head]]
                at = first - o[doc]
                rows = []
                if repeat.any():
                    x = np.flatnonzero(repeat)
                    rows.append((-1 - block % parts, block, _packed(doc[x].astype(np.uint32), at[x].astype(np.uint32), count[x].astype(np.uint32))))
                order = np.flatnonzero(~repeat)
                order = order[np.lexsort((sub[order], part[order]))]
                edges = _edges(part[order])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    x = order[a:b]
                    used, which = np.unique(doc[x], return_inverse=True)
                    rows.append((int(part[x[0]]), block, _packed(ids[used], used.astype(np.uint32), which.astype(np.uint32), at[x].astype(np.uint32), count[x].astype(np.uint32), sub[x], gather(d, first[x], count[x] + LENGTH - 1))))
                yield _rows(rows, "part block blob", (pa.int64(), pa.int64(), pa.binary()))

    return run


def _words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number that orders like them; zeros follow the end."""
    x = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = (x[:-1] << np.uint64(8)) | x[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[: len(t)]


_PREFIX = (0, 8, 16, PERIOD - 8)


def _ranked(parts: list[np.ndarray]) -> np.ndarray:
    """The dense rank, from 1 on, of each key (of several words) among all."""
    order, new = np.argsort(parts[0], kind="stable"), None
    for x in parts:
        word = x[order]
        if new is not None and len(order):
            order, word = _refined(order, new, word)
        change = np.concatenate([[True], word[1:] != word[:-1]])[: len(order)]
        new = change if new is None else new | change
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def _refined(order: np.ndarray, new: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts runs (which begin where `new`) of the order by word; runs of one word stay."""
    run = np.cumsum(new)
    mixed_up = np.zeros(run[-1] + 1, bool)
    mixed_up[run[1:][(word[1:] != word[:-1]) & ~new[1:]]] = True
    x = np.flatnonzero(mixed_up[run])
    if len(x):
        by = x[np.lexsort((word[x], run[x]))]
        order, word = order.copy(), word.copy()
        order[x], word[x] = order[by], word[by]
    return order, word


def cover_ranks(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For the positions of the cover in the PERIOD bytes from each start on, the rank of their suffixes by 2 * PERIOD bytes; 0 elsewhere.

    Ranks by PERIOD bytes come first; PERIOD further on is a position of the cover, too, so pairs of these ranks give
    those by twice as many bytes.
    """
    wanted = np.zeros(len(word), bool)
    for x in range(PERIOD):
        wanted[starts + x] = True
    at = np.flatnonzero(wanted)
    at = at[_IN_COVER[at % PERIOD]]
    wanted[:] = False
    wanted[at] = wanted[at + PERIOD] = True
    both = np.flatnonzero(wanted)
    ranks = np.zeros(len(word), np.int32)
    ranks[both] = _ranked([word[both + x] for x in _PREFIX])
    pair = (ranks[at].astype(np.uint64) << np.uint64(32)) | ranks[at + PERIOD].astype(np.uint64)
    double = _ranked([pair])
    ranks[:] = 0
    ranks[at] = double
    return ranks


def _ranges(word: np.ndarray, starts: np.ndarray, level: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of suffixes in alphabetical order: ranges of the word at this level, between splitters taken from the suffixes themselves. A word that alone fills a bucket is split by the next one. With each bucket the level up to which its suffixes are equal."""
    if len(starts) <= BUCKET or level == len(_PREFIX):
        yield starts, level
        return
    lead = word[starts + _PREFIX[level]]
    sample = np.sort(lead[:: max(1, len(lead) // 4096)])
    cuts = sample[:: max(1, len(sample) * BUCKET // (2 * len(lead)))]
    heavy = cuts[:-1][cuts[1:] == cuts[:-1]]
    splitters = np.unique(np.concatenate([cuts, heavy + np.uint64(1)]))
    of = np.searchsorted(splitters, lead, "right").astype(np.uint16)
    by = np.argsort(of, kind="stable")
    edges = _edges(of[by])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x = by[a:b]
        if b - a > BUCKET and (lead[x] == lead[x[0]]).all():
            yield from _ranges(word, starts[x], level + 1)
        else:
            yield starts[x], level


def _sort_bucket(word: np.ndarray, ranks: np.ndarray, s: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's suffixes sorted, and whether each has LENGTH bytes in common with the one before.

    First by words up to PERIOD bytes. Longer ties are sorted by the ranks of the cover, by quicksort on all of them at once:
    each is compared with a pivot of its tie after the shift that takes both into the cover. Suffixes that even these ranks
    don't tell apart have more than LENGTH bytes in common, and stay beside each other.
    """
    new = np.zeros(len(s), bool)
    new[:1] = True
    for x in _PREFIX[level:]:
        w = word[s + x]
        if new.sum() == 1:
            by = np.argsort(w)
            s, w = s[by], w[by]
        else:
            s, w = _refined(s, new, w)
        new[1:] |= w[1:] != w[:-1]
    tie = np.cumsum(new)
    live = np.flatnonzero(~(new & np.append(new[1:], True)))
    of = tie[live]
    while len(live):
        here = s[live]
        step = np.concatenate([[True], of[1:] != of[:-1]])
        begins = np.flatnonzero(step)
        sizes = np.diff(np.append(begins, len(live)))
        pivot = np.repeat(here[begins + sizes // 2], sizes)
        shift = _SHIFT[here % PERIOD, pivot % PERIOD]
        key = np.cumsum(step) * 3 + np.sign(ranks[here + shift] - ranks[pivot + shift])
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            s[live], key = here[by], key[by]
        sizes = np.bincount(key)[key]
        more = (key % 3 != 0) & (sizes > 1)
        live, of = live[more], key[more]
    equal = np.zeros(len(s), bool)
    near = np.flatnonzero(~new)
    for x in (LENGTH - 24, LENGTH - 16, LENGTH - 8):
        near = near[word[s[near] + x] == word[s[near - 1] + x]]
    equal[near] = True
    return s, equal


def suffix_order(t: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The starts in the alphabetical order of their suffixes, one bucket at a time, and whether each has LENGTH bytes in common with the one before in its bucket.

    The ranks of the cover are computed once for the text t, before any bucket is sorted. Equal strings have the same words,
    so no two buckets share one.
    """
    word = _words(np.concatenate([t, np.zeros(5 * PERIOD, np.uint8)]))
    ranks = cover_ranks(word, starts)
    for bucket, level in _ranges(word, starts.astype(np.int32) if len(word) < 2**31 else starts):
        yield _sort_bucket(word, ranks, bucket, level)


def repeated(ids: np.ndarray, counts: np.ndarray, subs: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each start of the segments, one after another, whether a start of a smaller id has the same string. Segments that share no string by their hash (subs) are sorted apart, about SORTED bytes at a time."""
    sizes = counts + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    to = np.cumsum(counts) - counts
    gone = np.zeros(counts.sum(), bool)
    by = np.argsort(subs, kind="stable")
    ends = _edges(subs[by])[1:]
    filled = np.cumsum(sizes[by])
    at = 0
    while at < len(by):
        upto = ends[np.searchsorted(ends, at, "right") :]
        fits = upto[filled[upto - 1] - (filled[at - 1] if at else 0) <= SORTED]
        end = int(fits[-1]) if len(fits) else int(upto[0])
        some = by[at:end]
        at = end
        n, size = counts[some], sizes[some]
        t = gather(text, begins[some], size)
        shift = np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n)  # from a start's number to its place in t
        starts = np.arange(n.sum()) + shift
        owner, number = np.repeat(ids[some], n), np.repeat(to[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.zeros(len(t), np.int32)
        place[starts] = np.arange(len(starts), dtype=np.int32)
        for order, equal in suffix_order(t, starts):
            which = place[order]
            of = owner[which]
            runs = np.flatnonzero(~equal)
            gone[number[which[of > np.minimum.reduceat(of, runs)[np.cumsum(~equal) - 1]]]] = True
    return gone


def _pieces(gone: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first start in it, number) of the runs of starts that are set."""
    to = np.cumsum(counts) - counts
    edge = np.zeros(len(gone) + 1, bool)
    edge[to] = True
    edge[-1] = True
    before = np.concatenate([[False], gone[:-1]]) & ~edge[:-1]
    after = np.concatenate([gone[1:], [False]]) & ~edge[1:]
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    segment = np.searchsorted(to, first, "right") - 1
    return segment, first - to[segment], last - first + 1


def _sort_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts one after another: the runs of repeated strings by block. Where more than HELD bytes of a part come in, what is held is sorted, and only strings that no smaller id has had so far stay."""
    now, limit, size = None, HELD, 0
    held: list[tuple] = []

    def sort(last: bool) -> pa.RecordBatch:
        nonlocal held, limit, size
        ids, block, row, at, counts, subs, text = (np.concatenate(x) for x in zip(*held, strict=True))
        gone = repeated(ids, counts, subs, text)
        segment, start, n = _pieces(gone, counts)
        out = _runs_rows(block[segment], row[segment], at[segment] + start, n)
        held, size = [], 0
        if not last:
            begins = np.cumsum(counts + LENGTH - 1) - counts - LENGTH + 1
            segment, start, n = _pieces(~gone, counts)
            kept = gather(text, begins[segment] + start, n + LENGTH - 1)
            held, size = [(ids[segment], block[segment], row[segment], at[segment] + start, n, subs[segment], kept)], len(kept)
            limit = max(HELD, 2 * size)
        return out

    for batch in batches:
        for part, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            blob = blob.as_buffer()
            if part < 0:
                yield _rows([(block, blob.to_pybytes())], "block blob", (pa.int64(), pa.binary()))
                continue
            if part != now and held:
                yield sort(True)
            if part != now:
                now, limit = part, HELD
            ids, row, doc, at, counts, subs, text = _unpacked(blob, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)
            held.append((ids[doc], np.full(len(doc), block, np.int64), row[doc], at.astype(np.int64), counts.astype(np.int64), subs, text))
            size += len(text)
            if size > limit:
                yield sort(False)
    if held:
        yield sort(True)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, blob, runs in zip(*batch.columns[1:], strict=True):
            data, o = _text(blob.as_buffer())
            found = [_unpacked(x.as_buffer(), np.uint32, np.uint32, np.uint32) for x in runs.values] if runs.is_valid else []
            row, at, n = (np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, o[row] + at, 1)
            np.add.at(edge, o[row] + at + n + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            touched = np.zeros(len(o) - 1, bool)
            touched[row] = True
            out = []
            for i in range(len(o) - 1):
                d = data[o[i] : o[i + 1]]
                if touched[i]:
                    g = gone[o[i] : o[i + 1]]
                    kept = d[~g].tobytes()
                    out.append((len(d), int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
                else:
                    out.append((len(d), 0, 0, hashlib.sha256(d).hexdigest(), d.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids.values, *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Removes each byte of a text, taken as UTF-8, that a string of LENGTH bytes covers which also starts in a document with
    a smaller id. Strings don't cross documents; overlaps count, and all is judged on the input.

    1. Documents are written as text blocks of about BLOCK bytes.
    2. What is worth sorting: a string is announced by the least hash of its runs of SEED bytes, so neighbouring starts mostly
       share a key and travel as one segment of text. A first pass finds the keys that two documents have; only their
       segments go on. A key in more than OFTEN blocks is sent string by string, spread by hashes of whole strings. Equal
       segments become one within their block before the shuffle, so a passage that a third of all documents have comes in
       once a block.
    3. A task takes one part at a time: ranks of the difference cover are computed once for the text in hand, and its suffixes
       are dealt into alphabetical buckets, which are sorted one after another (suffix_order). A bucket over its limit is
       split again. Of strings found equal all but those of the smallest id go.

    Memory is bounded by a block, by HELD bytes of a part and by SORTED bytes that are sorted together, besides a single
    document. A null text is empty. A null id comes after all others. Rows with the same id don't count as smaller than each
    other; each is a row of the result. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    parts = PARTS * n
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = stored(plain.mapInArrow(_blocks, "block long, ids array<long>, text binary"))

    announced = blocks.select("block", "text").mapInArrow(_announce(parts), "part long, block long, blob binary")
    marks = announced.groupBy("part").applyInPandas(_shared, "block long, part long, marks binary")
    by_block = marks.groupBy("block").agg(F.collect_list(F.struct("part", "marks")).alias("marks"))
    sent = blocks.join(by_block, "block", "left").select("block", "ids", "text", "marks").mapInArrow(_send(parts), "part long, block long, blob binary")
    runs = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_sort_parts, "block long, blob binary")
    by_block = runs.groupBy("block").agg(F.collect_list("blob").alias("runs"))
    # the same shuffle of the blocks serves both joins
    return blocks.join(by_block, "block", "left").select("block", "ids", "text", "runs").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """What suffix_dedup returns without kept, by a table of all strings; for tests."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    order = [_NO_ID if i is None else i for i, _ in texts]
    for i, t in zip(order, (t for _, t in texts), strict=True):
        for x in range(len(t) - LENGTH + 1):
            w = t[x : x + LENGTH]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, (real, t) in zip(order, texts, strict=True):
        gone = bytearray(len(t))
        for x in range(len(t) - LENGTH + 1):
            if first[t[x : x + LENGTH]] < i:
                gone[x : x + LENGTH] = b"\1" * LENGTH
        spans = sum(gone[x] and not (x and gone[x - 1]) for x in range(len(t)))
        out.append((real, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


SQL = {
    "op6_suffix_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first_id < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM r),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS b FROM k GROUP BY doc_id, k),
cut AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last_b, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY k) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last_b, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
