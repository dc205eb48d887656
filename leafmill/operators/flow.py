"""Words, tables and rules of whole pages to Markdown: a page's words travel once, compressed, and pages are worked through in arrays."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import PAGE

_NUMBERS = ("x0", "top", "bottom", "size")
#: Words of whole pages that are worked through together.
_TOGETHER = 1 << 15
_RULE, _WORD, _TABLE = range(3)
_PLAIN, _MONO = 0, 4


def _planes(v: np.ndarray) -> bytes:
    """Bytes of numbers, the first of each together, then the second: they compress better so."""
    return np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _numbers(raw: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind), at + n * wide


def _pack(batches):
    """Words -> a row for each run of a page, its words compressed; null texts have length -1, null numbers are NaN."""
    codec = pa.Codec("zstd")
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows - 1, bool)
        for k in PAGE:
            v = b.column(k).to_numpy(zero_copy_only=False)
            new |= v[1:] != v[:-1]
        cut = np.append(0, np.flatnonzero(new) + 1)
        text = b.column("text")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + b.num_rows + 1]
        data = memoryview(text.buffers()[2] or b"")
        length = np.where(text.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1).astype(np.int32)
        fonts = b.column("fontname").dictionary_encode()
        names, codes = fonts.dictionary.to_pylist(), pc.fill_null(fonts.indices, -1).to_numpy().astype(np.int32)
        pos = pc.fill_null(b.column("pos"), -(2**31)).to_numpy()
        numbers = [b.column(c).to_numpy(zero_copy_only=False) for c in _NUMBERS]
        sizes, bodies = [], []
        for i, j in zip(cut.tolist(), np.append(cut[1:], b.num_rows).tolist(), strict=True):
            used, code = np.unique(codes[i:j], return_inverse=True)
            named = json.dumps([None if c < 0 else names[c] for c in used.tolist()]).encode()
            parts = [np.array([j - i, len(named)], "<i4").tobytes(), named, _planes(np.diff(pos[i:j], prepend=np.int32(0))), _planes(length[i:j]), _planes(code.astype("<i4"))]
            raw = b"".join([*parts, *[_planes(v[i:j]) for v in numbers], data[offsets[i] : offsets[j]]])
            sizes.append(len(raw))
            bodies.append(codec.compress(raw, asbytes=True))
        yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(cut)) for k in PAGE], pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], [*PAGE, "bytes", "body"])


def _style(name: str | None) -> int:
    """Marks of a font: 0 none, 1 to 3 as many asterisks, 4 a code mark."""
    font = (name or "").lower()
    return _MONO if "mono" in font else 2 * bool(re.search("bold|heavy|black", font)) + bool(re.search("italic|oblique", font))


def _unpack(body: bytes, size: int) -> tuple:
    """``(pos, length, style, mono, x0, top, bottom, size, characters)``; mono is -1 without a font."""
    raw = memoryview(pa.decompress(body, size, "zstd", asbytes=True))
    n, m = np.frombuffer(raw, "<i4", 2).tolist()
    names, at = json.loads(bytes(raw[8 : 8 + m])), 8 + m
    got = []
    for kind in ("<i4",) * 3 + ("<f8",) * 4:
        v, at = _numbers(raw, at, n, kind)
        got.append(v)
    pos, length, code, *numbers = got
    style = np.array([_style(x) for x in names], np.int64)[code]
    mono = np.array([-1 if x is None else "mono" in x.lower() for x in names], np.int64)[code]
    return np.cumsum(pos, dtype=np.int32), length, style, mono, *numbers, raw[at:]


def _most_frequent(page: np.ndarray, v: np.ndarray, pages: int) -> np.ndarray:
    """Of each page the most frequent value, of equally frequent ones the smallest; nulls (NaN) are a value, smaller than others."""
    out = np.full(pages, np.nan)
    if not len(v):
        return out
    v = np.where(np.isnan(v), -np.inf, v)
    order = np.lexsort((v, page))
    page, v = page[order], v[order]
    cut = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (v[1:] != v[:-1])))
    n, page, v = np.diff(np.append(cut, len(v))), page[cut], v[cut]
    order = np.lexsort((v, -n, page))
    first = order[np.append(True, np.diff(page[order]) != 0)]
    out[page[first]] = np.where(np.isinf(v[first]) & (v[first] < 0), np.nan, v[first])
    return out


def _before(live: np.ndarray) -> np.ndarray:
    """For each row the last live one before it, or -1."""
    got = np.maximum.accumulate(np.where(live, np.arange(len(live)), -1))
    return np.append(-1, got[:-1])


def _blocks_of(pages: list, y_tolerance: float):
    """Blocks of whole pages ``(words, tables, rules)``: arrays of page number, block number, kind and Markdown."""
    runs = [(p, r) for p, (words, _, _) in enumerate(pages) for r in words]
    page = np.repeat(np.array([p for p, _ in runs], np.int64), [len(r[0]) for _, r in runs])
    pos, length, style, mono, x0, top, bottom, size = (np.concatenate([r[k] for _, r in runs] or [np.zeros(0)]) for k in range(8))
    length, style, mono = (v.astype(np.int64) for v in (length, style, mono))
    held = np.maximum(length, 0)
    offsets = np.append(0, np.cumsum(held)).astype(np.int64)
    chars = pa.py_buffer(b"".join(r[8] for _, r in runs))
    text = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), chars)
    order = np.lexsort((pos, page))
    pos, length, style, mono, x0, top, bottom, size = (v[order] for v in (pos, length, style, mono, x0, top, bottom, size))
    edge = np.searchsorted(page, np.arange(len(pages) + 1))

    lag, first = np.append(np.nan, top[:-1]), np.append(True, page[1:] != page[:-1])[: len(page)]
    with np.errstate(invalid="ignore"):
        starts = first | ~(np.abs(top - lag[: len(top)]) <= y_tolerance)
    body = _most_frequent(page, size, len(pages))
    left = _most_frequent(page[starts], x0[starts], len(pages))

    # Words, tables and rules in one order: see layout.page_stream.
    tables, rules = [], []
    for p, (_, of_page, lines) in enumerate(pages):
        for no, at, end, content in of_page:
            below = bottom[edge[p] : edge[p + 1]] > end
            tables.append((p, at, end, int(pos[edge[p] + below.argmax()]) if below.any() else 2**31 - 1, no, content))
        rules += [(p, at, no) for no, at in lines]
    n_words, n_tables, n_rules = len(page), len(tables), len(rules)
    t, r = np.array([x[:5] for x in tables], float).reshape(-1, 5).T, np.array(rules, float).reshape(-1, 3).T
    join = lambda w, t, r: np.concatenate([w, t, r])
    page, kind = join(page, t[0], r[0]).astype(np.int64), np.repeat([_WORD, _TABLE, _RULE], [n_words, n_tables, n_rules])
    top, bottom = join(top, t[1], r[1]), join(bottom, t[2], r[1])
    a, c = (kind != _RULE).astype(np.int64), join(np.ones(n_words), np.zeros(n_tables), r[2])
    low = lambda v: np.where(np.isnan(v), -np.inf, v)
    stream = np.lexsort((join(pos, t[4], r[2]), low(bottom), c, join(pos, t[3], r[2]), a, low(top), page))
    page, kind, top, bottom = (v[stream] for v in (page, kind, top, bottom))
    n = len(stream)
    i, word = np.arange(n), kind == _WORD
    start = np.maximum.accumulate(np.where(np.append(True, page[1:] != page[:-1]), i, 0))

    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.full(n, np.nan)
        ratio[word] = size[stream[word]] / body[page[word]]
        level = np.select([ratio >= 2, ratio >= 1.4, ratio >= 1.2], [1, 2, 3], 0)
        heading = level > 0
        y = np.where(word, top, np.where(kind == _TABLE, bottom, np.nan))
        last = _before(~np.isnan(y))
        last_y = np.where(last >= start, y[last], np.nan)
        new_line = np.abs(top - last_y) > y_tolerance

    # Rules are written at the first rule that is reached with a last line at or below theirs.
    written, line = np.zeros(n, np.int64), np.flatnonzero(kind == _RULE)
    cut = np.flatnonzero(np.append(True, np.diff(page[line]) != 0))[: len(line)]
    for lo, hi in zip(cut, np.append(cut[1:], len(line))[: len(cut)], strict=True):
        at = line[lo:hi]
        k = np.searchsorted(np.maximum.accumulate(low(last_y[at])), top[at])
        written[at] = np.bincount(k, minlength=len(at) + 1)[: len(at)]

    prev, ruled = _before(kind != _RULE), _before(written > 0)
    opens = word & ((prev < start) | (kind[prev] == _TABLE) | new_line | (heading[prev] != heading) | (~heading[prev] & (ruled > prev)))
    # Where what is open is written: a heading waits for the next word or table, a paragraph goes before what follows.
    behind = n - 1 - _before((kind != _RULE)[::-1])[::-1]
    follows = (behind < n) & (page[np.minimum(behind, n - 1)] == page)
    due = np.where(heading, np.where(follows, behind - 0.5, 1e18), i)

    w = np.flatnonzero(word)
    head = np.flatnonzero(opens[w])
    block = np.cumsum(opens[w]) - 1
    src = stream[w]
    fold = lambda f, v: f.reduceat(v, head) if len(head) else v
    code = fold(np.logical_or, mono[src] == 1) & ~fold(np.logical_or, mono[src] == 0)
    with np.errstate(invalid="ignore"):
        shift = x0[src] - left[page[w]]
        indent = np.where(shift >= 5, np.floor(np.where(shift >= 5, shift, 0) / 25) + 1, 0).astype(np.int64)
    marks = np.where(new_line[w] & ~heading[w], indent + 1, 0) * 5 + style[src]
    marks[code[block]] = _PLAIN
    known, which = np.unique(marks, return_inverse=True)
    sign = ("", "*", "**", "***", "`")
    opening = pa.array(["&nbsp;" * (3 * (m // 5 - 1)) + " " * (m >= 5) + sign[m % 5] for m in known.tolist()], pa.large_string())
    closing = pa.array([sign[m % 5] for m in known.tolist()], pa.large_string())
    shown = pc.binary_join_element_wise(opening.take(pa.array(which)), text.take(pa.array(order[src])), closing.take(pa.array(which)), pa.scalar("", pa.large_string()))
    kept = length[src] >= 0
    ends = np.append(0, np.cumsum(np.bincount(block[kept], minlength=len(head)))).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(ends), shown.filter(pa.array(kept)))
    joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    first_level = level[w[head]]
    lead = pa.array(["#" * v + " " * (v > 0) + "```\n" * m for v, m in zip(first_level.tolist(), code.tolist(), strict=True)], pa.large_string())
    tail = pa.array(["\n```\n\n" if m else "\n\n" for m in code.tolist()], pa.large_string())
    markdown = pc.binary_join_element_wise(lead, joined, tail, pa.scalar("", pa.large_string())).cast(pa.string())

    table, rule = np.flatnonzero(kind == _TABLE), np.flatnonzero(written)
    markdown = pa.concat_arrays([markdown, pa.array([tables[k][5] for k in (stream[table] - n_words).tolist()], pa.string()), pa.array(["\n---\n\n" * k for k in written[rule].tolist()], pa.string())])
    kinds = np.concatenate([np.where(first_level > 0, 0, 1), np.full(len(table), 2), np.full(len(rule), 3)])
    of = np.concatenate([page[w[head]], page[table], page[rule]])
    out = np.lexsort((np.concatenate([fold(np.maximum, due[w]), table, rule]), of))
    of = of[out]
    number = np.arange(len(of)) - np.searchsorted(of, of)
    return of, number, pa.array(["heading", "paragraph", "table", "rule"]).take(pa.array(kinds[out])), markdown.take(pa.array(out))


def _written(y_tolerance: float):
    """Rows sorted by page -> blocks, many pages at a time."""

    def run(batches):
        keys, pages, words, types = [], [], 0, None

        def flush():
            of, number, kind, markdown = _blocks_of(pages, y_tolerance)
            held = [pa.array([k[c] for k in keys], types[c]).take(pa.array(of)) for c in range(len(PAGE))]
            keys.clear()
            pages.clear()
            return pa.RecordBatch.from_arrays([*held, pa.array(number.astype(np.int32)), kind, markdown], [*PAGE, "block_no", "kind", "markdown"])

        for b in batches:
            types = [b.column(k).type for k in PAGE]
            for *key, what, size, body, no, top, bottom, content in zip(*[b.column(c).to_pylist() for c in (*PAGE, "what", "bytes", "body", "no", "top", "bottom", "content")], strict=True):
                if not keys or key != keys[-1]:
                    if words >= _TOGETHER or len(keys) >= _TOGETHER:
                        yield flush()
                        words = 0
                    keys.append(key)
                    pages.append(([], [], []))
                none = lambda v: np.nan if v is None else v
                if what == _WORD:
                    pages[-1][0].append(_unpack(body, size))
                    words += len(pages[-1][0][-1][0])
                elif what == _TABLE:
                    pages[-1][1].append((no, none(top), none(bottom), content))
                else:
                    pages[-1][2].append((no, none(top)))
        if pages:
            yield flush()

    return run


def page_blocks(words: DataFrame, tables: DataFrame, rules: DataFrame, y_tolerance: float = 5.0) -> DataFrame:
    """Headings, paragraphs, tables and rules of pages as they are written: ``doc_id, page, block_no, kind, markdown``.

    What ``flowing_blocks(page_stream(words, tables, rules), page_modes(words))`` gives, from one shuffle: a page's words
    travel compressed, and modes, order and blocks are found where the page arrives. Pages (bounded groups) are kept whole.
    Tables of a page without words are written too; rows with a null ``doc_id`` or ``page`` belong to no page.
    """
    kinds = dict(words.dtypes)
    whole = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    key = [F.col(k).cast(kinds[k]).alias(k) for k in PAGE]
    of = ", ".join(f"{k} {kinds[k]}" for k in PAGE)
    real = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    w = words.where(whole).select(*key, F.col("pos").cast("int").alias("pos"), "text", *real(*_NUMBERS), "fontname")
    w = w.mapInArrow(_pack, f"{of}, bytes int, body binary").withColumn("what", F.lit(_WORD))
    t = tables.where(whole).select(*key, F.lit(_TABLE).alias("what"), F.col("table_no").cast("long").alias("no"), *real("top", "bottom"), "content")
    r = rules.where(whole).select(*key, F.lit(_RULE).alias("what"), F.col("rule_no").cast("long").alias("no"), *real("top"))
    rows = w.unionByName(t, True).unionByName(r, True).repartition(*PAGE).sortWithinPartitions(*PAGE)
    return rows.mapInArrow(_written(y_tolerance), f"{of}, block_no int, kind string, markdown string")
