"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

A 64-bit fingerprint within three bits reaches near copies of about 0.95 and more only. Where a similarity of the shingle
sets is asked for, texts that share a band of minima are compared too, and linked if their sets are that similar.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, small_batches, table, texts, without_rows

#: Node pairs of a trie frontier that are held at once.
FRONTIER = 400_000
#: A block with more fingerprints than this is dealt out as pairs of sub-tries, six bits further down.
HOT_BLOCK = 4096
HOT_BITS = 6
#: Bands of so many minima: texts of similarity s share one with probability 1 - (1 - s ** MINIMA) ** BANDS (0.9996 at 0.8).
BANDS, MINIMA = 20, 5
#: Texts of a band, and bytes of their sets, that a task holds; a larger band is compared in pairs of such blocks.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 16_000_000
#: Such a band is first dealt out again if its texts would make more pairs across components than so many for each ...
PAIRS_EACH = 16
#: ... by so many further bands of more minima (0.975 of the pairs at 0.8 share one), at most so many times.
SUB_BANDS, SUB_MINIMA, LEVELS = 12, 6, 3
#: Rows up to which the texts to compare are named by a broadcast (8 bytes each).
BROADCAST_TEXTS = 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 values of the text's shingles, repeats included; fewer words than a shingle has are one."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    n = len(parts) - span + 1
    hashes = np.empty(n, "<u8")
    for at in range(0, n, 65536):
        pairs = zip(starts[at : min(n, at + 65536)].tolist(), ends[at + span - 1 : at + span - 1 + 65536].tolist(), strict=False)
        part = [digest(joined[a:b], seed) for a, b in pairs]
        hashes[at : at + len(part)] = part
    return hashes


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the values."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """Bits that are set in over half of the XXH64 values of the text's shingles, repeats included."""
    return majority(shingles(text, words, seed))


@cache
def _mixers(level: int) -> tuple[int, np.ndarray]:
    """Bands of a level, and the constants of its minima."""
    bands, minima = (SUB_BANDS, SUB_MINIMA) if level else (BANDS, MINIMA)
    odd = np.random.RandomState(91 + level).randint(1, 1 << 62, (3, bands * minima), dtype=np.int64)
    return bands, odd.astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, level: int = 0) -> np.ndarray:
    """A key for each band of minima of a set of shingles; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    n, mix = _mixers(level)
    least = np.full(mix.shape[1], ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        h = (hashes[at : at + 4096, None] ^ mix[0]) * mix[1]
        h ^= h >> np.uint64(31)
        np.minimum(least, (h * mix[2]).min(axis=0), out=least)
    bands = least.astype("<u8").reshape(n, -1)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, fp`` (the text's hash, the fingerprint as a signed long) of every row; without words it is zero."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _absorb(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of each a and b in place; afterwards every label is the least index of its set."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_join(values: np.ndarray, roots: np.ndarray, budget: int, top: int = 63) -> np.ndarray:
    """Least linked index of each value, where values at ``budget`` or fewer differing bits are linked.

    ``values``: sorted unsigned 64-bit integers. ``roots``: rows ``(lo1, hi1, lo2, hi2, errors)`` of trie-node pairs
    to start from; a node is a range of values that agree in all bits above ``top``. Both nodes of a pair go down
    together, differing branches spend one error, and a pair is left as soon as the budget is exceeded.
    """
    label = np.arange(len(values))
    stack = [(top, roots)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(bit, pairs[half:]), (bit, pairs[:half])]
            continue
        same = pairs[:, 0] == pairs[:, 2]
        n1, n2 = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        if len(pairs) > len(values) // 4:  # nodes whose values are all of one set already have no link to add
            runs = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            settled = (runs[pairs[:, 0]] == runs[pairs[:, 1] - 1]) & (runs[pairs[:, 2]] == runs[pairs[:, 3] - 1]) & (label[pairs[:, 0]] == label[pairs[:, 2]])
            pairs, same, n1, n2 = pairs[~settled], same[~settled], n1[~settled], n2[~settled]
        small = n1 * n2 <= 32 if bit >= 0 else np.ones(len(pairs), bool)
        leaf, size = pairs[small], (n1 * n2)[small]
        if len(leaf):
            row = np.repeat(np.arange(len(leaf)), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            width = (leaf[:, 3] - leaf[:, 2])[row]
            a, b = leaf[row, 0] + k // width, leaf[row, 2] + k % width
            near = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            _absorb(label, a[near], b[near])
        pairs, same = pairs[~small], same[~small]
        if not len(pairs):
            continue
        one = np.uint64(1)
        shift = np.uint64(bit)

        def middle(lo, hi):
            cut = ((values[lo] >> shift) | one) << shift
            return np.clip(np.searchsorted(values, cut), lo, hi)

        m1, m2 = middle(pairs[:, 0], pairs[:, 1]), middle(pairs[:, 2], pairs[:, 3])
        lo1, hi1, lo2, hi2, e = pairs.T
        new = [np.stack(x, 1) for x in ((lo1, m1, lo2, m2, e), (m1, hi1, m2, hi2, e), (lo1, m1, m2, hi2, e + 1))]
        cross = ~same
        new.append(np.stack((m1, hi1, lo2, m2, e + 1), 1)[cross])
        new = np.concatenate(new)
        new = new[(new[:, 1] > new[:, 0]) & (new[:, 3] > new[:, 2]) & (new[:, 4] <= budget)]
        if len(new):
            stack.append((bit - 1, new))
    return label


def _links(budget: int):
    """Stars (least fingerprint of a linked set, another of it) of the blocks that arrive sorted in a partition."""

    def solve(rot, block, a, b, child, value):
        out = []
        order = np.lexsort((value, child, b, a, block, rot))
        rot, block, a, b, child, value = (x[order] for x in (rot, block, a, b, child, value))
        # A group is one block, or one pair of its sub-tries; make its values sort as one trie below the block.
        edge = np.flatnonzero(np.concatenate([[True], (rot[1:] != rot[:-1]) | (block[1:] != block[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        ends = np.append(edge[1:], len(value))
        for lo, hi in zip(edge.tolist(), ends.tolist(), strict=True):
            if hi - lo < 2:
                continue
            v = value[lo:hi]
            if a[lo] == b[lo]:
                root = np.array([[0, hi - lo, 0, hi - lo, 0]])
            else:
                cut = int(np.searchsorted(child[lo:hi], b[lo]))
                if cut in (0, hi - lo):
                    continue
                root = np.array([[0, cut, cut, hi - lo, int(a[lo] ^ b[lo]).bit_count()]])
            label = trie_join(v, root, budget, 63 - 16 - (HOT_BITS if a[lo] >= 0 else 0))
            moved = np.flatnonzero(label != np.arange(len(v)))
            if len(moved):
                r = np.uint64(16 * int(rot[lo]))
                back = lambda x: (x >> r) | (x << (np.uint64(64) - r)) if r else x
                out.append((back(v[moved]), back(v[label[moved]])))
        if out:
            x, y = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["u", "v"])
        return None

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)] + [batch.column(5).to_numpy().view(np.uint64)]
            held = cols if held is None else [np.concatenate(p) for p in zip(held, cols, strict=True)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0))
            if len(new) and len(held[0]) >= 65536:  # the last group may go on in the next batch
                cut = new[-1] + 1
                if (got := solve(*[c[:cut] for c in held])) is not None:
                    yield got
                held = [c[cut:] for c in held]
        if held is not None and (got := solve(*held)) is not None:
            yield got

    return run


def near_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct ``fp`` within ``budget`` (at most 3) differing bits.

    Two such values agree in one of their four 16-bit quarters, so each value goes to four tries, one below each
    quarter; only the trie of one block is walked in a task. A block with many values is dealt out as pairs of the
    sub-tries that lie within the budget. Links come as stars of the sets found, never as all pairs.
    """
    if not 0 <= budget <= 3:
        raise ValueError("four quarters find differences of at most three bits")
    turned = [F.struct(F.lit(r).alias("rot"), (F.shiftleft("fp", 16 * r).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * r)) if r else F.col("fp")).alias("value")) for r in range(4)]
    each = fps.select("fp").distinct().select(F.explode(F.array(*turned)).alias("t")).select("t.*")
    each = each.withColumn("block", F.shiftrightunsigned("value", 48).cast("int"))
    hot = each.groupBy("rot", "block").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BLOCK)
    each = each.join(hot, ["rot", "block"], "left")
    child = F.shiftrightunsigned(F.shiftleft("value", 16), 64 - HOT_BITS).cast("int")
    masks = [m for m in range(1 << HOT_BITS) if m.bit_count() <= budget]
    cold = each.where("n is null").select("rot", "block", F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("child"), "value")
    warm = each.where("n is not null").withColumn("child", child).withColumn("m", F.explode(F.array(*map(F.lit, masks))))
    other = F.col("child").bitwiseXOR(F.col("m"))
    warm = warm.select("rot", "block", F.least("child", other).alias("a"), F.greatest("child", other).alias("b"), "child", "value")
    dealt = cold.union(warm).repartition("rot", "block", "a", "b").sortWithinPartitions("rot", "block", "a", "b")
    return dealt.mapInArrow(_links(budget), "u long, v long")


def _signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``fingerprints`` with ``n``, the number of different shingles, and ``keys``, those of the bands."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps, sizes, keys = [], [], []
            for text in b.column("text").to_pylist():
                hashes = shingles(text, words)
                fps.append(majority(hashes))
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                keys.append(band_keys(hashes))
            columns = [b.column("doc_id"), b.column("th"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "fp", "n", "keys"])

    return texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long, n int, keys array<long>")


def _sets(docs: DataFrame, asked: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``th, found``: the different shingles of the texts that ``asked`` names, as sorted 64-bit integers."""

    def sets(batches):
        for b in batches:
            found = [np.unique(shingles(t, words)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(found, pa.binary())], ["th", "found"])

    asked = materialise(asked.distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TEXTS else asked
    base = texts(docs, id_col, text_col).select(F.xxhash64("text").alias("th"), "text")
    return materialise(base.join(asked, "th", "left_semi").mapInArrow(sets, "th long, found binary").dropDuplicates(["th"]), "sets")


def _alike(docs: DataFrame, pairs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``u, v`` of the ``pairs`` (texts ``a, b``, their fingerprints ``u, v``) whose shingle sets are similar enough."""

    def compare(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both / (len(x) + len(y) - both) >= similarity)
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    pairs = materialise(pairs, "pairs")
    found = _sets(docs, pairs.select(F.col("a").alias("th")).union(pairs.select("b")), words, id_col, text_col)
    side = lambda name, to: found.select(F.col("th").alias(name), F.col("found").alias(to))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("u", "v", "x", "y").mapInArrow(compare, "u long, v long")


def linked_sets(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> np.ndarray:
    """Least linked index of each set, where sets of one ``label`` are linked, and sets that are similar enough.

    Only a set outside the largest class is compared, with all others at once by an index of their elements: of two
    sets in different classes one is outside the largest, so no link is lost.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner, values = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    cut = np.append(True, values[order][1:] != values[order][:-1])
    posting, start = owner[order], np.flatnonzero(cut)
    count = np.diff(np.append(start, len(values)))
    element = np.empty(len(values), np.int64)
    element[order] = np.cumsum(cut) - 1
    first = np.cumsum(size) - size
    _, once, which = np.unique(label, return_index=True, return_inverse=True)
    label = once[which]
    for i in range(len(sets)):
        if label[i] == np.bincount(label).argmax():
            continue
        own = element[first[i] : first[i] + size[i]]
        n = count[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))
        near = np.flatnonzero(both >= similarity * (size + size[i] - both))
        merged = np.unique(label[near])
        label[np.isin(label, merged)] = merged[0]
    return label


def _solved(similarity: float):
    """Members of bands or of pairs of their blocks, in order, with their sets -> links of those that are similar."""

    def solve(rows):
        _, _, _, fp, root, found = zip(*rows, strict=True)
        root = np.array(root, np.int64)
        if (root == root[0]).all():
            return None
        label = linked_sets([np.frombuffer(x, "<u8") for x in found], root, similarity)
        fp = np.array(fp, np.int64)
        moved = fp != fp[label]
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["u", "v"])

    def run(batches):
        held = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and row[:3] != held[0][:3]:
                    if (got := solve(held)) is not None:
                        yield got
                    held = []
                held.append(row)
        if held and (got := solve(held)) is not None:
            yield got

    return run


def _dealt_again(docs: DataFrame, hot: DataFrame, level: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """Members of hot bands in further bands below them: ``key, th, fp, n``."""

    def run(batches):
        for b in batches:
            rows, keys = [], []
            for i, (text, old) in enumerate(zip(b.column("text").to_pylist(), b.column("keys").to_pylist(), strict=True)):
                new = band_keys(np.unique(shingles(text, words)), level)
                for k in old:
                    rows.append(np.full(len(new), i))
                    keys.append((new ^ np.int64(k)) * np.int64(0x2545F4914F6CDD1D))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *(b.column(c).take(at) for c in ("th", "fp", "n"))], ["key", "th", "fp", "n"])

    asked = materialise(hot.groupBy("th", "fp", "n").agg(F.collect_list("key").alias("keys")), "hot")
    asked = F.broadcast(asked) if hot.count() <= BROADCAST_TEXTS else asked
    base = texts(docs, id_col, text_col).select(F.xxhash64("text").alias("th"), "text")
    found = base.join(asked, "th").dropDuplicates(["th"]).select("th", "fp", "n", "keys", "text")
    return found.mapInArrow(run, "key long, th long, fp long, n int")


def _linked_alike(docs: DataFrame, rows: DataFrame, roots: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Components of fingerprints ``(node, root)``: those in ``roots``, joined by pairs of texts that are similar enough.

    Texts with a band in common are compared: first each with the least of its band, then those that the band still
    holds in different components. Pairs in one component have no link to add, so a band of near copies takes about as
    many comparisons as it has texts. The second step's texts meet in a task with their sets (``linked_sets``), never
    as pairs of rows. A band too large for a task is dealt out again by further minima, which texts that share a passage
    and little else hardly have in common; what is still too large after ``LEVELS`` times is compared in pairs of blocks.
    """
    members, level = rows.where("n > 0").select("th", "fp", "n", "keys").dropDuplicates(["th"]).select(F.explode("keys").alias("key"), "th", "fp", "n"), 0

    def rooted():
        return members.join(roots, members.fp == roots.node, "left").select("key", "th", "fp", "n", F.coalesce("root", "fp").alias("root"))

    def with_links(more):
        return materialise(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "roots")

    roots = materialise(roots, "roots")
    while True:
        members = materialise(members, "bands")
        shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        members = materialise(members.join(shared, "key"), "bands")
        now = rooted()
        mixed = now.groupBy("key").agg(F.min(F.struct("th", "fp", "n", "root")).alias("one"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
        pairs = now.join(mixed.select("key", "one"), "key")
        fits = (F.col("one.root") != F.col("root")) & (F.least("n", "one.n") >= similarity * F.greatest("n", "one.n") - 1e-6)
        pairs = pairs.where(fits).select(F.col("one.th").alias("a"), F.col("th").alias("b"), F.col("one.fp").alias("u"), F.col("fp").alias("v")).distinct()
        roots = with_links(_alike(docs, pairs, words, similarity, id_col, text_col))

        now = rooted()
        parts = now.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("k"))
        blocks = F.ceil(F.greatest(F.sum("m") / BLOCK_TEXTS, 8 * F.sum("k") / BLOCK_BYTES))
        many = F.sum("m") ** 2 - F.sum(F.col("m") ** 2) > 2 * PAIRS_EACH * F.sum("m")
        sizes = parts.groupBy("key").agg(blocks.alias("blocks"), (many & F.lit(level < LEVELS)).alias("many"), F.count("*").alias("parts")).where("parts > 1")
        left = materialise(now.join(sizes.select("key", "blocks", (F.col("many") & (F.col("blocks") > 1)).alias("hot")), "key"), "mixed")
        block = F.pmod(F.xxhash64("th", F.lit(level)), F.col("blocks"))
        dealt = left.where("not hot").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp", "root", "th")
        found = _sets(docs, dealt.select("th"), words, id_col, text_col)
        dealt = dealt.join(found, "th").select("key", "x", "y", "fp", "root", "found")
        dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        roots = with_links(dealt.mapInArrow(_solved(similarity), "u long, v long"))
        level += 1
        hot = left.where("hot").select("key", "th", "fp", "n")
        if not hot.limit(1).count():
            return roots
        members = _dealt_again(docs, hot, level, words, id_col, text_col)


def near_groups(docs: DataFrame, words: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``doc_id, th, fp, component_id, root`` of every row: the least ``doc_id`` that links of fingerprints reach.

    With ``similarity``, texts are linked as well if so large a share (Jaccard) of their different shingles is common.

    A null or empty text has fingerprint zero and links like any other. Rows of one fingerprint are linked, repeated
    rows among them; a null ``doc_id`` is the component's id only if all its ids are null. Empty in, empty out.
    """
    rows = materialise(fingerprints(docs, words, id_col, text_col) if similarity is None else _signatures(docs, words, id_col, text_col), "fingerprints")
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(least, budget))
    if similarity is not None:
        roots = _linked_alike(docs, rows, roots, words, similarity, id_col, text_col)
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "component_id", "root")


def keep_first(docs: DataFrame, words: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``docs`` with all columns, and one row of each component: that of least id, then of least text hash."""
    rows = materialise(near_groups(docs, words, budget, id_col, text_col, similarity), "near")
    mark = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    first = rows.groupBy("root").agg(F.min(mark).alias("f"), F.count("*").alias("n")).where("n > 1")
    rest = rows.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))))
    twice = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    return without_rows(docs, materialise(rest.select("doc_id", "th"), "gone"), twice, 500_000, id_col, text_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_groups(table(spark, sf_dir, "documents"), words=3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
