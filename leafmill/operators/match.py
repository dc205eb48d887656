"""Texts against boxed words: occurrence joins, windows, nearest words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_occurrence(content: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th place of a word in the content takes the word's k-th box; without one the box is null.

    ``content(keys, pos, text)``, ``boxes(keys, pos, text, ...)``. Two windows and a left equi-join.
    """
    number = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "text").orderBy("pos")))
    return number(content).join(number(boxes).withColumnRenamed("pos", "box_pos"), [*keys, "text", "k"], "left").drop("k")


@lru_cache(1 << 18)
def _edits(a: str, b: str, most: int) -> int:
    """Edits between two words; more than ``most`` if their lengths tell so."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


_PACKED = pa.schema([("step", pa.int32()), ("text", pa.string())])


def _pack(n_keys: int):
    """Rows ``(keys, pos, text)`` -> one row for each run of a key, its words compressed."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows - 1, bool)
            for k in range(n_keys):
                v = b.column(k).to_numpy(zero_copy_only=False)
                new |= v[1:] != v[:-1]
            cut = np.append(0, np.flatnonzero(new) + 1)
            pos, text, bodies = b.column(n_keys).to_numpy(), b.column(n_keys + 1), []
            for i, j in zip(cut.tolist(), np.append(cut[1:], b.num_rows).tolist(), strict=True):
                words = pa.RecordBatch.from_arrays([pa.array(np.diff(pos[i:j], prepend=np.int32(0))), text.slice(i, j - i)], schema=_PACKED)
                raw = words.serialize()
                bodies.append((raw.size, pa.compress(raw, "zstd", asbytes=True)))
            sizes = pa.array([n for n, _ in bodies], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(cut)) for k in range(n_keys)], sizes, pa.array([x for _, x in bodies], pa.binary())], [*b.schema.names[:n_keys], "bytes", "body"])

    return run


def _nearest(words: list[str], boxes: list[tuple[int, str]], most: int, equal: bool) -> list[int | None]:
    """The box of each word of a page: its k-th place takes its k-th box, then what is left over the nearest left over."""
    places: dict[str, list[int]] = {}
    for p, t in boxes:
        if t is not None:
            places.setdefault(t, []).append(p)
    spare = {t: iter(ps) for t, ps in places.items()}
    got = [next(spare[t], None) if equal and t in spare else None for t in words]
    left = {t: rest for t, ps in spare.items() if (rest := list(ps))}
    for i, b in enumerate(got):
        if b is None and (t := words[i]) is not None and left:
            best, word, least = most + 1, None, 0 if t in left else 1
            for w in left:
                if (d := _edits(t, w, most)) < best:
                    best, word = d, w
                    if d == least:
                        break
            if word is not None:
                got[i] = left[word].pop(0)
                if not left[word]:
                    del left[word]
    return got


def greedy_nearest(content: DataFrame, boxes: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """``by_occurrence``, then each word left over, in order, takes the nearest box left over within ``most`` edits.

    A word's choice depends on what earlier ones took, so a page is worked through in one call; pages are bounded.
    Of equally near words the one whose first box came first wins. Adds ``box_pos`` (null: none). Each side travels once, in
    compressed runs of a page's words. Null words, and words of null keys, have no equal ones.
    """
    kinds = dict(content.dtypes)
    of = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def side(df: DataFrame, n: int) -> DataFrame:
        df = df.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.col("pos").cast("int").alias("pos"), F.col("text").alias("text"))
        return df.mapInArrow(_pack(len(keys)), f"{of}, bytes int, body binary").withColumn("side", F.lit(n))

    def pages(batches):
        key, held, parts = None, ([], []), []

        def words(bodies):
            read = [pa.ipc.read_record_batch(pa.py_buffer(body), _PACKED) for body in bodies]
            pos = np.concatenate([np.cumsum(r.column(0).to_numpy(), dtype=np.int32) for r in read]) if read else np.zeros(0, np.int32)
            text = pa.chunked_array([r.column(1) for r in read], pa.string()).combine_chunks()
            if (pos[1:] < pos[:-1]).any():
                order = np.argsort(pos, kind="stable")
                pos, text = pos[order], text.take(pa.array(order))
            return pos, text

        def solve():
            if not held[0]:
                return
            pos, text = words(held[0])
            at, other = words(held[1])
            got = _nearest(text.to_pylist(), list(zip(at.tolist(), other.to_pylist(), strict=True)), most, None not in key)
            parts.append((key, pos, text, pa.array(got, pa.int32())))

        def flush():
            n = [len(p[1]) for p in parts]
            columns = [pa.array([p[0][k] for p in parts], key_types[k]).take(pa.array(np.repeat(np.arange(len(parts)), n))) for k in range(len(keys))]
            columns += [pa.array(np.concatenate([p[1] for p in parts])), pa.chunked_array([p[2] for p in parts], pa.string()).combine_chunks(), pa.chunked_array([p[3] for p in parts], pa.int32()).combine_chunks()]
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, [*keys, "pos", "text", "box_pos"])

        for b in batches:
            key_types = [b.schema.field(k).type for k in range(len(keys))]
            for *now, size, body, which in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now != key:
                    solve()
                    key, held = now, ([], [])
                    if len(parts) >= 32:
                        yield flush()
                held[which].append(pa.decompress(body, size, "zstd", asbytes=True))
        solve()
        if parts:
            yield flush()

    both = side(content, 0).unionByName(side(boxes, 1))
    both = both.repartition(*keys).sortWithinPartitions(*keys, "side")
    return both.mapInArrow(pages, f"{of}, pos int, text string, box_pos int")


def windows(texts: DataFrame, words_col: str, needle_col: str) -> DataFrame:
    """Places (from 0) where the words of ``needle_col`` stand in a row in ``words_col``; one row each."""
    n, m = F.size(words_col), F.size(needle_col)
    places = F.when((m > 0) & (n >= m), F.filter(F.sequence(F.lit(0), n - m), lambda i: F.slice(F.col(words_col), i + 1, m) == F.col(needle_col)))
    return texts.withColumn("start", F.explode(places))


def fuzzy_windows(needles: DataFrame, texts: DataFrame, most: int = 3) -> DataFrame:
    """For each needle and text the first window of as many words with the least edits, if ``most`` or fewer.

    ``needles(item_id, words)`` of more than ``most`` words, ``texts(doc_id, words)``. Candidate windows come from an
    equi-join: with so few edits one of the needle's words stands unchanged in the window, at its place or, where an
    edit joined or split words, next to it; only windows that share such a word are measured.
    """
    n = needles.select("item_id", F.col("words").alias("nw"), F.size("words").alias("m")).where("m > 0")
    anchors = n.select("item_id", "nw", "m", F.posexplode("nw").alias("k", "anchor"))
    places = texts.select("doc_id", F.posexplode("words").alias("at", "anchor"))
    found = places.join(anchors, "anchor").withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    start = F.col("at") - F.col("k") + F.col("shift")
    found = found.select("item_id", "doc_id", "nw", "m", start.alias("start")).where("start >= 0").distinct()
    found = found.join(texts.select("doc_id", "words"), "doc_id").where(F.size("words") >= F.col("start") + F.col("m"))
    window, wanted = F.array_join(F.slice("words", F.col("start") + 1, F.col("m")), " "), F.array_join("nw", " ")
    found = found.withColumn("dist", F.levenshtein(window, wanted, most)).where("dist >= 0")
    return found.groupBy("item_id", "doc_id").agg(F.min(F.struct("dist", "start")).alias("b")).select("item_id", "doc_id", "b.start", "b.dist")


def uri_rects(raw: DataFrame) -> DataFrame:
    """``doc_id, uri, rect``: the n-th ``(http...)`` of a PDF's text goes with its n-th ``/Rect [...]``, a repeated one with its last.

    ``raw(doc_id, text)``. Pairs end with the shorter of the two lists.
    """
    uris = F.regexp_extract_all("text", F.lit(r"\((https?://[^\s)]+)\)"), F.lit(1))
    rects = F.transform(F.regexp_extract_all("text", F.lit(r"/Rect \[([^\]]*)\]"), F.lit(1)), lambda r: F.transform(F.filter(F.split(r, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double")))
    pairs = F.slice(F.arrays_zip(uris.alias("uri"), rects.alias("rect")), F.lit(1), F.least(F.size(uris), F.size(rects)))
    each = raw.where(F.least(F.size(uris), F.size(rects)) > 0).select("doc_id", F.posexplode(pairs).alias("n", "p"))
    return each.groupBy("doc_id", F.col("p.uri").alias("uri")).agg(F.max_by("p.rect", "n").alias("rect"))


def find_boxes(content: DataFrame, boxes: DataFrame, needles: DataFrame, mode: str = "fuzzy", most: int = 3) -> DataFrame:
    """Boxes of the words of a text part: ``doc_id, page, needle_id, start, pos, box_pos`` (words without a box left out).

    ``content`` and ``boxes(doc_id, page, pos, text)``, ``needles(doc_id, page, needle_id, words)``; words are plain
    already (``text.strip_markdown``). ``exact`` takes the first window that equals the needle, ``all_matches`` each of them,
    ``fuzzy`` the first of the fewest edits, if ``most`` or fewer, with words joined to their nearest boxes.
    """
    keys = ["doc_id", "page"]
    if mode not in ("fuzzy", "exact", "all_matches"):
        raise ValueError("mode is fuzzy, exact or all_matches")
    content = content.select(*keys, "pos", "text")
    joined = greedy_nearest(content, boxes, keys, most) if mode == "fuzzy" else by_occurrence(content, boxes.select(*keys, "pos", "text"), keys)
    page_words = content.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]).alias("ws"))
    j = needles.select(*keys, "needle_id", "words").join(page_words, keys)
    m = F.size("words")
    places = F.when((m > 0) & (F.size("ws") >= m), F.sequence(F.lit(0), F.size("ws") - m))
    window = lambda i: F.slice("ws", i + 1, m)
    if mode == "fuzzy":
        wanted = F.array_join("words", " ")
        scored = F.filter(F.transform(places, lambda i: F.struct(F.levenshtein(F.array_join(window(i), " "), wanted, most).alias("d"), i.alias("i"))), lambda x: x["d"] >= 0)
        starts = F.slice(F.transform(F.array_sort(scored), lambda x: x["i"]), 1, 1)
    else:
        starts = F.filter(places, lambda i: window(i) == F.col("words"))
        starts = starts if mode == "all_matches" else F.slice(starts, 1, 1)
    hit = j.select(*keys, "needle_id", m.alias("m"), F.explode(starts).alias("start"))
    order = joined.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    order = order.select(*keys, "i", "pos", "box_pos").where("box_pos is not null")
    found = hit.toDF(*hit.columns).join(order.toDF("d", "p", "i", "pos", "box_pos"), (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & F.col("i").between(F.col("start"), F.col("start") + F.col("m") - 1))
    return found.select(*keys, "needle_id", "start", "pos", "box_pos")
