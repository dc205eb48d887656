"""Suffix-array dedup: Burrows-Wheeler transforms of shards are merged by refining their interleave."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

#: Bytes of a repeated string, and of the content hash that deals windows out.
LENGTH = 400
GRAM = 32
_TABLE = np.random.RandomState(20240607).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POS = np.uint64((1 << 28) - 1)


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A hash of the ``k`` bytes (a power of two) from each position; the last ``k - 1`` are of no use."""
    h, step, power = _TABLE[data], 1, _BASE
    while step < k:
        nxt = h.copy()
        nxt[:-step] = h[:-step] * np.uint64(power) + h[step:]
        h, step, power = nxt, 2 * step, power * power & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _window_least(v: np.ndarray, w: int) -> np.ndarray:
    m, span = v, 1
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def window_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int = LENGTH, k: int = GRAM):
    """Runs of windows of ``length`` bytes that choose the same two grams: ``(doc, lo, hi, key)`` arrays.

    A window chooses its gram of least hash and that of greatest, the leftmost of equal ones: what it chooses, and
    where in it, follows from its bytes alone, so equal windows have equal keys wherever they stand. ``lo .. hi``
    (inclusive) are window starts in ``data``; ``doc`` indexes ``starts``. No window crosses a document's end.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length or not (lengths >= length).any():
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, k)
    pos = np.arange(len(data), dtype=np.uint64)
    picks = []
    for v in (h, ~(h * np.uint64(0xD6E8FEB86659FD93))):
        m = _window_least((v & ~_POS) | pos, length - k + 1)[: len(data) - length + 1]
        picks.append((m & _POS).astype(np.int64))
    p, q = picks
    big = np.flatnonzero(lengths >= length)
    first, last = starts[big], starts[big] + lengths[big] - length
    change = np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
    doc_of = np.searchsorted(first, change, side="right") - 1
    inside = (doc_of >= 0) & (change <= last[np.maximum(doc_of, 0)])
    lo = np.concatenate([first, change[inside & (change > first[np.maximum(doc_of, 0)])]])
    lo.sort()
    doc = np.searchsorted(first, lo, side="right") - 1
    hi = np.append(lo[1:], len(data)) - 1
    hi = np.minimum(hi, last[doc])
    key = h[p[lo]] * np.uint64(3) + (h[q[lo]] ^ (h[q[lo]] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + (p[lo] - q[lo]).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    key ^= key >> np.uint64(32)
    return big[doc], lo, hi, key


#: Bytes of text that are hashed at a time, and of one slice of a longer text.
CHUNK = 400_000
SLICE = 8_000_000
#: Bytes of contexts in a shard, and about so many in a batch of whole keys.
SHARD = 250_000
BATCH = 750_000
#: A key whose different contexts have more bytes than this is dealt out again, by runs of at most so many windows.
HOT_BYTES = 1_200_000
WIDTHS = (32, 4, 1)
#: A key that more places hold is looked up where its runs are (``_frequent``), not joined to them.
FREQUENT = 32
#: Keys of 16 bytes up to which such a look-up table is sent, and rows or list entries of a broadcast side of a join.
LOOKUP_KEYS = 500_000
BROADCAST_ROWS = 1_000_000


class Transform:
    """Burrows-Wheeler transform of a shard of contexts, its rows in order of ``(group, suffix)``.

    ``bwt`` is the symbol before each suffix: a byte and one, or 0 where a context starts; each context ends in a
    terminator 0 and equal suffixes stand in order of their contexts. ``at`` says which place of the shard's text a row
    is, to report it; merging reads the symbols and groups alone.
    """

    def __init__(self, bwt: np.ndarray, group: np.ndarray, at: np.ndarray):
        self.bwt, self.group, self.at = bwt, group, at

    @classmethod
    def build(cls, contexts: list[bytes], groups: np.ndarray) -> Transform:
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
        data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
        ends = np.cumsum(sizes) - 1
        sym = data.astype(np.int32) + 1
        sym[ends] = 0
        end, group = np.repeat(ends, sizes).astype(np.int32), np.repeat(groups, sizes)
        place = np.arange(len(sym), dtype=np.int32)
        code, padded = group.astype(np.int64), np.append(sym, np.zeros(3, np.int32))
        for i in range(4):
            code = code * 257 + np.where(place + i <= end, padded[i : i + len(sym)], 0)
        order = np.argsort(code, kind="stable").astype(np.int32)
        rank, live, _ = _buckets(order, code[order])
        k, longest = 4, int(sizes.max(initial=0))
        while len(live) and k < longest:
            after = np.where(place + k <= end, place + k, -1)
            live, _ = _refine(order, rank, live, after)
            k *= 2
        before = np.append(np.int32(0), sym[:-1])  # a context's first symbol comes after the last one's terminator
        return cls(before[order], group[order], order)

    def next_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row its first symbol, and the row of the suffix that follows it (the inverse of the LF mapping).

        The n-th row of a group that starts with a symbol is followed by the n-th row that the symbol comes before.
        """
        code = self.group.astype(np.int64) * 257 + self.bwt
        rows = np.argsort(code, kind="stable").astype(np.int32)
        first = self.bwt[rows]
        return first, np.where(first == 0, np.int32(-1), rows)


def _buckets(order: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in ``order`` of their ``code``: each row's rank (where its bucket starts), places not yet single, the cuts.

    A last rank of -1 stands for no row, the one numbered -1.
    """
    cut = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    places = np.arange(len(code), dtype=np.int32)
    rank = np.full(len(code) + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(cut, places, 0)) if len(code) else 0
    return rank, places[~(cut & np.append(cut[1:], True))] if len(code) else places, np.flatnonzero(cut)


def _refine(order: np.ndarray, rank: np.ndarray, live: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One refinement: the rows of a bucket are told apart by the ranks of the rows ``after`` them (-1: none).

    Ranks and order are changed in place. Returns the places that are still not single, and those that were cut. What
    comes in sorted runs (a shard's rows of a bucket) is merged, not sorted anew: the sort is a stable run merge.
    """
    rows = order[live]
    key = rank[rows].astype(np.int64) << 32 | rank[after[rows]] + 1
    by = np.argsort(key, kind="stable")
    rows, key = rows[by], key[by]
    old, cut = key >> 32, np.append(True, key[1:] != key[:-1])
    order[live] = rows
    rank[rows] = np.maximum.accumulate(np.where(cut, live, 0))
    new = live[1:][cut[1:] & (old[1:] == old[:-1])]
    return live[~(cut & np.append(cut[1:], True))], new


def merge(parts: list[Transform], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms of shards: ``(which, index, common)`` of the rows of all in one order.

    ``which`` is the shard and ``index`` the row in it. The interleave is refined step by step, from the symbols alone:
    it starts in order of (group, first symbol), and each step orders the rows of a bucket by the buckets of the rows
    that follow them in their shards, k symbols on (k doubles, by the powers of the shards' LF mappings; one more
    symbol is a step with k = 1). A shard's rows never change their order among each other. After the last step rows of
    one bucket agree in ``length`` symbols. ``common[i]`` is the common prefix of row i and the one before it as told
    by the step that cut their bucket: at least so many symbols, fewer than at that step's end; ``length`` if none
    did, -1 at a group's first.
    """
    base = np.cumsum([0] + [len(p.bwt) for p in parts])
    group = np.concatenate([p.group for p in parts]).astype(np.int64)
    ahead = [p.next_rows() for p in parts]
    code = group * 257 + np.concatenate([first for first, _ in ahead])
    one = np.concatenate([np.where(to >= 0, to + np.int32(b), np.int32(-1)) for (_, to), b in zip(ahead, base, strict=False)] + [np.full(1, -1, np.int32)])
    order = np.argsort(code, kind="stable").astype(np.int32)
    rank, live, cuts = _buckets(order, code[order])
    common = np.full(len(order), length, np.int32)
    common[cuts] = 0
    common[np.flatnonzero(np.append(True, np.diff(group[order]) != 0))] = -1
    k, after = 1, one
    for bit in bin(length)[3:]:
        if not len(live):
            break
        live, new = _refine(order, rank, live, after)
        common[new] = k
        k, after = 2 * k, after[after]
        if bit == "1" and len(live):
            live, new = _refine(order, rank, live, one)
            common[new] = k
            k, after = k + 1, one[after]
    which = np.searchsorted(base, order, side="right") - 1
    return which, order - base[which], common


def repeated(contexts: list[tuple[int, bytes, int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For contexts ``(key, bytes, windows, weight)``: which of a context's windows occur elsewhere too.

    Windows start at the first ``windows`` bytes. Contexts with a key are compared, those with another never are.
    A weight is the number of places that hold the context.
    """
    shards: list[list[int]] = [[]]
    size = 0
    for i, c in enumerate(contexts):
        if size > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(c[1])
    keys = {k: g for g, k in enumerate(dict.fromkeys(c[0] for c in contexts))}
    windows = np.array([c[2] for c in contexts], np.int64)
    first = np.cumsum(windows) - windows
    parts, owners = [], []
    for shard in shards if contexts else []:
        t = Transform.build([contexts[i][1] for i in shard], np.array([keys[contexts[i][0]] for i in shard], np.int32))
        starts = np.cumsum([0] + [len(contexts[i][1]) + 1 for i in shard])
        own = np.searchsorted(starts, t.at, side="right") - 1
        parts.append(t)
        owners.append((np.array(shard, np.int64)[own], t.at - starts[own]))
    if not parts:
        return []
    which, index, common = merge(parts, length)
    interval = np.cumsum(common < length) - 1  # rows with a common prefix of the whole length
    flat = np.cumsum([0] + [len(p.bwt) for p in parts])[which] + index
    owner, start = (np.concatenate(x)[flat] for x in zip(*owners, strict=True))
    weight = np.where(start < windows[owner], np.array([c[3] for c in contexts], np.int64)[owner], 0)
    often = (np.bincount(interval, weight)[interval] >= 2) & (weight > 0)
    flags = np.zeros(int(windows.sum()), bool)
    flags[(first[owner] + start)[often]] = True
    return [flags[a : a + n] for a, n in zip(first.tolist(), windows.tolist(), strict=True)]


def _utf8(texts: list) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _runs(length: int):
    """Texts -> runs of windows that share a key: key, digest of the context, first window, number of windows."""

    def one(blobs: list[tuple[int, int, bytes]]):
        data = b"\n".join(x[2] for x in blobs)
        sizes = np.array([len(x[2]) for x in blobs], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        doc, lo, hi, key = window_runs(np.frombuffer(data, np.uint8), starts, sizes, length)
        dig = np.array([xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
        row = np.array([x[0] for x in blobs], np.int64)[doc]
        shift = np.array([x[1] for x in blobs], np.int64)[doc] - starts[doc]
        return row, key, dig, lo + shift, hi - lo + 1

    def run(batches):
        for b in batches:
            blobs, size = [], 0
            pieces = ((i, at, t[at : at + SLICE + length - 1]) for i, t in enumerate(_utf8(b.column("text").to_pylist())) if len(t) >= length for at in range(0, max(len(t) - length + 1, 1), SLICE))
            found = []
            for piece in pieces:
                blobs.append(piece)
                size += len(piece[2])
                if size > CHUNK:
                    found.append(one(blobs))
                    blobs, size = [], 0
            if blobs:
                found.append(one(blobs))
            if found:
                row, key, dig, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("th").take(row), pa.array(key.view(np.int64)), pa.array(dig.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "th", "key", "dig", "lo", "n"])

    return run


def narrowed(context: bytes, n: int, key: int, width: int, length: int = LENGTH, k: int = GRAM):
    """A context's ``n`` windows in runs of ``width`` at most: ``(key, first, windows)`` each.

    Windows of a key all hold its gram of least hash, and equal windows hold it at one offset. Runs are cut where that
    offset passes a multiple of ``width``; the bytes that every window of such offsets covers stand at fixed places
    around the gram, and their hash is the new key. So equal windows meet again, and at ``width`` 1 none else do.
    """
    h = gram_hashes(np.frombuffer(context[:length], np.uint8), k)[: length - k + 1]
    p = int(np.argmin(h & ~_POS))
    out, first = [], 0
    while first < n:
        low = (p - first) // width * width
        last = min(p - low, n - 1)
        core = context[p - low : p - low - width + 1 + length]
        out.append((xxhash.xxh3_64_intdigest(core, (key ^ low * _BASE) & 0xFFFFFFFFFFFFFFFF), first, last - first + 1))
        first = last + 1
    return out


def _narrow(width: int, length: int):
    """Texts with requests (key, dig, weight, lo, n) -> the requests' runs of ``width`` windows."""

    def run(batches):
        for b in batches:
            rows, key, dig, lo, n, weight = [], [], [], [], [], []
            for i, (blob, wanted) in enumerate(zip(_utf8(b.column("text").to_pylist()), b.column("wanted").to_pylist(), strict=True)):
                for w in wanted:
                    context = blob[w["lo"] : w["lo"] + w["n"] - 1 + length]
                    for new, first, count in narrowed(context, w["n"], w["key"], width, length):
                        rows.append(i)
                        key.append(new)
                        dig.append(xxhash.xxh3_64_intdigest(context[first : first + count - 1 + length]))
                        lo.append(w["lo"] + first)
                        n.append(count)
                        weight.append(w["weight"])
            row = pa.array(rows, pa.int64())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, dig)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("th").take(row), *longs, pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(weight, pa.int64())], ["doc_id", "th", "key", "dig", "lo", "n", "weight"])

    return run


def _cut_contexts(length: int):
    """Texts with requests (key, dig, weight, lo, n) -> a row with the bytes of each requested context."""

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for blob, wanted in zip(_utf8(b.column("text").to_pylist()), b.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    for col, v in zip(cols, (w["key"], w["dig"], w["weight"], w["n"], blob[w["lo"] : w["lo"] + w["n"] - 1 + length]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "dig", "weight", "n", "context"])

    return run


def _merged(length: int):
    """Contexts in order of key -> the ranges of a context's windows that occur elsewhere."""

    def solve(held):
        cols = [[], [], []]
        for (key, dig, *_), flags in zip(held, repeated([(k, c, n, w) for k, _, w, n, c in held], length), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            if len(edge):
                for col, v in zip(cols, (key, dig, [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]), strict=True):
                    col.append(v)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["key", "dig", "ranges"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size > BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


class _Lookup:
    """A sorted table of 64-bit keys, or of (key, digest) pairs, that workers hold; ``flag`` says something of each."""

    def __init__(self, rows: pa.Table, columns: list[str], flag: str | None = None):
        values = [rows.column(c).to_numpy() for c in columns]
        order = np.lexsort(values[::-1])
        self.values = [v[order] for v in values]
        self.flag = rows.column(flag).to_numpy(zero_copy_only=False)[order] if flag else None

    def find(self, *asked: np.ndarray) -> np.ndarray:
        """The place of each asked key or pair, -1 where the table lacks it."""
        first = self.values[0]
        if len(asked) == 1:
            at = np.minimum(np.searchsorted(first, asked[0]), len(first) - 1)
            return np.where(first[at] == asked[0], at, -1)
        own, which = np.unique(first, return_index=True)  # a key's pairs stand together, in order of digests
        ends, out = np.append(which[1:], len(first)), np.full(len(asked[0]), -1)
        at = np.minimum(np.searchsorted(own, asked[0]), len(own) - 1)
        left = np.flatnonzero(own[at] == asked[0])
        lo, hi = which[at[left]], ends[at[left]]
        while len(left):  # all asked pairs halve their ranges together
            mid = (lo + hi) // 2
            got = self.values[1][mid]
            hit = got == asked[1][left]
            out[left[hit]] = mid[hit]
            less = got < asked[1][left]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            on = ~hit & (lo < hi)
            left, lo, hi = left[on], lo[on], hi[on]
        return out


def _filtered(batches, lookup: _Lookup, columns: list[str]):
    """Runs that ``lookup`` has, as tables of about 100,000 rows, with their places in it."""
    held, size = [], 0
    for b in batches:
        found = lookup.find(*[b.column(b.schema.get_field_index(c)).to_numpy() for c in columns])
        rows = np.flatnonzero(found >= 0)
        if len(rows):
            held.append((b.take(pa.array(rows)), found[rows]))
            size += len(rows)
        if size > 100_000:
            yield pa.Table.from_batches([x for x, _ in held]).combine_chunks(), np.concatenate([f for _, f in held])
            held, size = [], 0
    if held:
        yield pa.Table.from_batches([x for x, _ in held]).combine_chunks(), np.concatenate([f for _, f in held])


def _collapsed(keys):
    """Runs -> for each context of a frequent key its weight and least place, as far as this task has seen."""

    def run(batches):
        lookup = keys.value
        for t, found in _filtered(batches, lookup, ["key"]):
            key, dig, th, lo = (t.column(c).to_numpy() for c in ("key", "dig", "th", "lo"))
            doc = t.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            order = np.lexsort((lo, th, doc, dig, key))
            cut = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(dig[order]) != 0)))
            weight = np.add.reduceat(t.column("weight").to_numpy()[order], cut)
            out = t.take(pa.array(order[cut])).drop_columns(["weight"])
            out = out.append_column("weight", pa.array(weight)).append_column("alone", pa.array(lookup.flag[found[order[cut]]]))
            yield from out.select(["key", "dig", "alone", "weight", "doc_id", "th", "lo", "n"]).to_batches()

    return run


def _covered(pairs, length: int):
    """Runs -> the byte ranges of those whose context is in ``pairs``, neighbours of a text joined."""

    def run(batches):
        for t, _ in _filtered(batches, pairs.value, ["key", "dig"]):
            th, lo = t.column("th").to_numpy(), t.column("lo").to_numpy().astype(np.int64)
            doc = t.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            end = lo + t.column("n").to_numpy() - 1 + length
            order = np.lexsort((lo, th, doc))
            doc, th, lo, end = (x[order] for x in (doc, th, lo, end))
            text = np.append(0, np.cumsum((np.diff(doc) != 0) | (np.diff(th) != 0)))
            shift = text * (int(end.max()) + 1)  # ranges of different texts never touch
            first, last = _joined(lo + shift, end + shift)
            cut = np.searchsorted(lo + shift, first)
            rows = t.take(pa.array(order[cut]))
            back = shift[cut]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("th").combine_chunks(), pa.array((first - back).astype(np.int32)), pa.array((last - back).astype(np.int32))], ["doc_id", "th", "a", "b"])

    return run


def _joined(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of ranges in order of their starts; ranges that touch are one."""
    if not len(lo):
        return lo, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, lo[1:] > reach[:-1])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def _listed(df: DataFrame, col: str) -> int:
    """Rows of ``df`` and entries of its lists ``col``: a bound on its size, where a row's list may be long."""
    return df.agg(F.sum(F.size(col) + 1)).first()[0] or 0


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, spans array<struct<a, b>>``: byte ranges that strings of ``length`` bytes occurring twice cover.

    ``th`` is xxhash64 of the text, so rows of one id with different texts stay apart. Ranges are sorted and maximal;
    texts without any have no row. Null and empty texts and those shorter than ``length`` have none, repeated rows
    repeat each other's strings, a null id is an id of its own, and an empty table gives none.

    Windows are dealt out by a key that follows from their bytes (``window_runs``), so equal ones meet wherever they
    stand; keys seen once are done. Runs of windows with equal contexts are collapsed into one with a weight, which
    settles keys with a single context. The contexts of the other keys are gathered by key into shards, each shard's
    transform is built, and the shards' transforms are merged by interleave refinement: an interval of suffixes
    whose common prefixes reach ``length`` and whose weights sum to two or more is a repeated string. A key with more
    than ``HOT_BYTES`` of different contexts never gathers in a task: its contexts are dealt out again by shorter runs
    and longer shared content (``narrowed``), down to single windows, which collapse.
    """
    spark = docs.sparkSession
    small_batches(spark, 1024)
    base = _base(docs, id_col, text_col)
    runs = materialise(base.mapInArrow(_runs(length), "doc_id long, th long, key long, dig long, lo int, n int"), "runs")
    runs, ranges = runs.withColumn("weight", F.lit(1).cast("long")), []
    for width in (*WIDTHS, None):
        # At a width of 1 a key has one context, but for a clash of 64-bit hashes: what has two is compared in one task.
        found, hot = _settle(base, runs, length, split=width is not None)
        ranges += found
        if hot is None:
            break
        pieces = _asked(base, hot, hot.count()).mapInArrow(_narrow(width, length), "doc_id long, th long, key long, dig long, lo int, n int, weight long")
        runs = materialise(pieces, "narrow")
    each = reduce(DataFrame.union, ranges).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches):
        for b in batches:
            lists, i = b.column("spans"), b.schema.get_field_index("spans")
            a, z, at = lists.values.field("a").to_numpy(), lists.values.field("b").to_numpy(), lists.offsets.to_numpy()
            ends, firsts, lasts = [0], [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                order = np.argsort(a[lo:hi], kind="stable")
                x, y = _joined(a[lo:hi][order], z[lo:hi][order])
                firsts.append(x)
                lasts.append(y)
                ends.append(ends[-1] + len(x))
            pair = pa.StructArray.from_arrays([pa.array(np.concatenate(v or [np.zeros(0, np.int32)]), pa.int32()) for v in (firsts, lasts)], ["a", "b"])
            yield b.set_column(i, "spans", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair))

    return materialise(each.mapInArrow(run, "doc_id long, th long, spans array<struct<a:int,b:int>>"), "spans")


def _asked(base: DataFrame, reps: DataFrame, rows: int) -> DataFrame:
    """The texts that hold ``reps``, each with the list of them."""
    wanted = reps.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "dig", "weight", "lo", "n")).alias("wanted"))
    wanted = wanted.toDF("w_id", "w_th", "wanted")
    return base.join(_small(wanted, rows), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("doc_id", "th", "text", "wanted")


def _frequent(runs: DataFrame, keys: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]] | None:
    """Contexts of frequent keys, and the ranges of runs whose context stands in two places; None if too many keys.

    The keys, then their repeated contexts, go to the workers as sorted tables of at most ``LOOKUP_KEYS`` entries, so a
    place that holds a string of thousands is neither joined nor written on its own: weights are summed and neighbouring
    ranges joined where the runs are read.
    """
    spark = runs.sparkSession
    frequent = keys.where(F.col("c") > FREQUENT)
    if not 0 < frequent.count() <= LOOKUP_KEYS:
        return None
    table_ = spark.sparkContext.broadcast(_Lookup(frequent.select("key", "alone").toArrow(), ["key"], "alone"))
    schema = "key long, dig long, alone boolean, weight long, doc_id long, th long, lo int, n int"
    seen = runs.select("doc_id", "th", "key", "dig", "lo", "n", "weight").mapInArrow(_collapsed(table_), schema)
    seen = seen.groupBy("key", "dig", "alone").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "th", "lo", "n")).alias("r"))
    seen = materialise(seen.select("key", "dig", "alone", "weight", "r.*"), "frequent")
    twice = seen.where("weight > 1").select("key", "dig")
    many = twice.count()
    if many > LOOKUP_KEYS:
        return None
    if not many:
        return seen, []
    pairs = spark.sparkContext.broadcast(_Lookup(twice.toArrow(), ["key", "dig"]))
    return seen, [runs.select("doc_id", "th", "key", "dig", "lo", "n").mapInArrow(_covered(pairs, length), "doc_id long, th long, a int, b int")]


def _settle(base: DataFrame, runs: DataFrame, length: int, split: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables ``doc_id, th, a, b`` of byte ranges that are repeated, and the contexts of hot keys, if any (``split``)."""
    keys = runs.groupBy("key").agg(F.sum("weight").alias("c"), (F.min("dig") == F.max("dig")).alias("alone")).where("c > 1")
    keys = materialise(keys, "keys")
    frequent = _frequent(runs, keys, length)
    rare = keys.where(F.col("c") <= FREQUENT) if frequent else keys
    again = materialise(runs.join(_small(rare.select("key", "alone"), rare.count()), "key"), "again")
    reps = again.where("not alone").groupBy("key", "dig").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "th", "lo", "n")).alias("r"))
    reps, ranges = reps.select("key", "dig", "weight", "r.*"), []
    if frequent:
        reps = reps.union(frequent[0].where("not alone").select(reps.columns))
        ranges += frequent[1]
    reps = materialise(reps, "contexts")
    size = F.sum(F.col("n") + length).alias("bytes")
    crowded = materialise(reps.groupBy("key").agg(size).where(F.col("bytes") > HOT_BYTES).select("key"), "crowded") if split else None
    rows, many = reps.count(), crowded.count() if split else 0
    few, hot = reps, None
    if many:
        few = reps.join(_small(crowded, many), "key", "left_anti")
        hot = materialise(reps.join(_small(crowded, many), "key", "left_semi"), "hot")
    contexts = _asked(base, few, rows).mapInArrow(_cut_contexts(length), "key long, dig long, weight long, n int, context binary")
    contexts = contexts.repartition("key").sortWithinPartitions("key", "dig")
    found = materialise(contexts.mapInArrow(_merged(length), "key long, dig long, ranges array<struct<a:int,b:int>>"), "ranges")

    # A run in a repeated key is repeated as a whole if its context stands alone there or in two places. What stands once in
    # a key with others has one run, the representative itself, which is named by its place: no join by content is needed.
    # Its ranges say what of it is repeated.
    once = reps.where("weight = 1")
    place = ["doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).alias("b")]
    whole = again.select(*place, F.lit(False).alias("once")).union(once.select(*place, F.lit(True)))
    whole = whole.groupBy("doc_id", "th", "a", "b").agg(F.max("once").alias("once")).where("not once").drop("once")
    part = once.join(_small(found, _listed(found, "ranges")), ["key", "dig"]).select("doc_id", "th", "lo", F.explode("ranges").alias("r"))
    part = part.select("doc_id", "th", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b") - 1 + length).alias("b"))
    return [*ranges, whole, part], hot


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a column ``__spans``; a text is matched by its id and its hash."""
    keyed = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    s = _small(spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__h"), F.col("spans").alias("__spans")), _listed(spans, "spans"))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))
    return keyed.join(s, on, "left").drop("__th", "__id", "__h")


def _kept(blob: bytes, spans) -> tuple[bytes, int, int]:
    if not spans:
        return blob, 0, 0
    out, at, gone = [], 0, 0
    for s in spans:
        out.append(blob[at : s["a"]])
        at, gone = s["b"], gone + s["b"] - s["a"]
    out.append(blob[at:])
    return b"".join(out), gone, len(spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` of every row (``kept_sha256`` with ``digest_only``).

    Every byte that a ``length``-byte string covers which also starts elsewhere, in the same text or another, is
    removed, its first occurrence too; strings are judged on the input. A null text is empty; a text shorter than
    ``length`` is kept. Repeated rows repeat each other's strings. A null id is an id of its own; an empty table
    gives an empty result; other columns are not read. What is kept may end within a UTF-8 sequence.
    """
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), spans, "doc_id", "text")

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for blob, s in zip(_utf8(b.column("text").to_pylist()), b.column("__spans").to_pylist(), strict=True):
                kept, gone, n = _kept(blob, s)
                for col, v in zip(cols, (len(blob), gone, n, hashlib.sha256(kept).hexdigest() if digest_only else kept), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest_only else pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest_only else "kept"])

    tail = "kept_sha256 string" if digest_only else "kept binary"
    return rows.select("doc_id", "text", "__spans").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {tail}")


def rewrite(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with all columns and the repeated strings cut out of the texts; ``count_col``, if any, follows.

    Bytes of a character that is cut in the middle go with the cut. A null text stays null.
    """
    rows = _with_spans(docs, repeated_spans(docs, length, id_col, text_col), id_col, text_col)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            spans = b.column(b.schema.get_field_index("__spans")).to_pylist()
            text = [t if not s else _kept(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), spans, strict=True)]
            b = b.set_column(at, b.schema.field(at), pa.array(text, b.schema.field(at).type))
            yield b.drop_columns(["__spans"])

    out = rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__spans").mapInArrow(run, docs.schema)
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest_only=True)
