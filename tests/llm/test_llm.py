"""The llm operators against brute force, and all of them over odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from conftest import DATA, rows_of

from leafmill.llm import bpe, exact_dedup, licenses, packing, passages, quality, queries, simhash, suffix_dedup, topk, toxicity
from leafmill.llm.common import components

SCHEMA = "doc_id long, text string, sha string, th long, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names that operators use."""
    long = " ".join(f"word{i % 97}" for i in range(30000))
    rows = [(1, None, "x", 1, None), (2, "", None, None, "k"), (None, "a b c d e f g", "x", 2, "k"), (3, "a b c d e f g", "x", 2, "k"), (3, "a b c d e f g", "x", 2, "k"), (4, "abc defg", "x", 2, "k"), (5, long, "x", 2, "k"), (6, long, "x", 2, "k"), (7, " \n\t ", "x", 2, "k"), (8, "é漢\U0001f600 x", "x", 2, "k")]
    return spark.createDataFrame(rows, SCHEMA)


def test_oracles(spark, duck):
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        want = duck.sql(sql)
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall()), name


def test_exact_groups_of_odd_rows(odd):
    got = exact_dedup.exact_groups(odd, exact_dedup.default_snapshot()).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert sorted(len(v) for v in by.values()) == [1, 2, 3, 4] or sorted(len(v) for v in by.values()) == [1, 2, 3, 3, 1]
    for rows in by.values():
        assert {r["group_size"] for r in rows} == {len(rows)} and any(r["kept"] for r in rows)
    assert exact_dedup.keep_first(odd, exact_dedup.default_snapshot()).count() == len(by)


@pytest.mark.parametrize("most", [250_000, 5, 0])
def test_texts_of_one_digest_and_hot_groups_by_brute_force(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda norm: F.substring(F.sha2(norm, 256), 1, 1))
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", most)
    r = random.Random(13)
    docs = [(i, r.choice(["same text", "same  text "]) if i % 3 == 0 else f"text {r.randrange(70)}" + " " * r.randrange(3)) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    by = {}
    for i, t in docs:
        by.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    want = {i: (min(v)[1], len(v), i == min(v)[1]) for v in by.values() for _, i in v}
    got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.exact_groups(df, exact_dedup.default_snapshot()).collect()}
    assert got == want
    kept = exact_dedup.keep_first(df, exact_dedup.default_snapshot()).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(i for i, w in want.items() if w[2])


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 30000])
def test_fuse_filter_has_no_false_negatives(n):
    keys = np.random.RandomState(n).randint(0, 1 << 62, n).astype(np.uint64)
    f = exact_dedup.BinaryFuse.build(keys)
    assert f.contains(keys).all()
    other = np.random.RandomState(n + 1).randint(0, 1 << 62, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.005


def test_fingerprint_by_the_book():
    text = "The quick  brown fox jumps over the lazy dog the quick brown fox"
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text, 3) == want and simhash.fingerprint(" \n", 3) == 0
    assert simhash.fingerprint("Ab", 3) == xxhash.xxh64_intdigest("ab", 42)


def test_near_links_find_all_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BLOCK", 40)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(12)} | {r.getrandbits(64) for _ in range(100)} | {0}
    hot = r.getrandbits(64) >> 48 << 48
    fps |= {hot | r.getrandbits(24) & r.getrandbits(24) & r.getrandbits(24) for _ in range(150)}
    values = sorted(fps)
    a = np.array(values, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(v),) for v in a.view(np.int64)], "fp long")
    roots = {row["node"]: row["root"] for row in components(simhash.near_links(df)).collect()}
    signed = a.view(np.int64).tolist()
    got = [roots.get(v, v) for v in signed]
    pairs = {}
    for g, w in zip(got, label.tolist(), strict=True):
        assert pairs.setdefault(g, w) == w
    assert len(pairs) == len(set(label.tolist()))


def test_similar_shingles_are_linked_by_brute_force(spark):
    r = random.Random(15)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    docs = []
    for n in (60, 200, 400, 1000):
        for edits in (0.005, 0.01, 0.02, 0.03, 0.05):
            base = words(n)
            docs += [base, *([w if r.random() >= edits else f"e{r.randrange(10**6)}" for w in base] for _ in range(4))]
    docs += [words(3), words(3), []]
    docs = [" ".join(d) for d in docs]
    sets = [{tuple(d.split()[i : i + 5]) for i in range(max(len(d.split()) - 4, 1))} for d in docs]
    label, alone = list(range(len(docs))), 0
    for i in range(len(docs)):
        for j in range(i):
            if docs[i] and docs[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
                alone += (simhash.fingerprint(docs[i], 5) ^ simhash.fingerprint(docs[j], 5)).bit_count() > 3
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_groups(df, words=5, similarity=0.8).collect()}
    assert alone > 50
    assert [got[i] for i in range(len(docs))] == label


@pytest.mark.parametrize(("block", "levels"), [(2048, 3), (40, 2), (40, 0)])
def test_large_bands_are_linked_by_brute_force(spark, monkeypatch, block, levels):
    """Texts that are half one passage, and noisy copies of one text: in a task, dealt out again, or in pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    monkeypatch.setattr(simhash, "PAIRS_EACH", 3)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    r = random.Random(19)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, base = words(60), words(150)
    docs = [passage + words(r.randint(20, 40)) for _ in range(80)]
    docs += [[w if r.random() > 0.01 else "edit" for w in d] for d in docs[:20]]
    docs += [[w if r.random() > 0.025 else f"e{r.randrange(10**6)}" for w in base] for _ in range(90)]
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_groups(df, words=5, similarity=0.8).collect()}
    assert [got[i] for i in range(len(docs))] == label and 90 < len(set(label)) < 185


def test_bpe_is_tiktoken():
    import public_tokenizers as P
    import tiktoken

    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(2)
    cases = ["", " ", "\n\n  x", "it's 12345 é漢\U0001f600", "a" * 5000, "\x1c\x1d x", "<|endoftext|>"]
    cases += ["".join(r.choice(a) for _ in range(r.randint(1, 400))) for a in ("abc", "thesin ", "éß漢 a", "0123 .-", "abcdefghijklmnop") for _ in range(60)]
    for t in cases:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t) and c.decode_ids(ids) == t.encode()
        left, right = t.encode()[: len(t) // 2], t.encode()[len(t) // 2 :]
        if left and right and len(c.find(t)) == 1:
            assert c.join(c.encode_piece(left), c.encode_piece(right)) == c.encode_piece(t.encode())


def test_top_products_with_ties_and_odd_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-300, 0, 5, 300]) for _ in range(6)]) for i in range(300)] + [(1, [300] * 6), (400, None), (401, [None] * 6), (402, [0] * 6), (450, [7, 7]), (451, [1, -1]), (452, [9, 9]), (500, []), (501, []), (550, [3] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    q = df.where("vec_id % 50 = 0")
    got = {}
    for row in topk.top_products(df, q, 5).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    good = [(i, x) for i, x in rows if x is not None and None not in x]
    assert 550 not in got and got[500] == [(1, 501, 0)]
    for i, x in good:
        if i % 50 == 0 and i != 550:
            want = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in good if j != i and len(x) == len(y))[:5]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


def brute_repeats(blobs, n):
    from collections import Counter

    c = Counter(b[s : s + n] for b in blobs for s in range(len(b) - n + 1))
    out = []
    for b in blobs:
        m = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if c[b[s : s + n]] > 1:
                m[s : s + n] = True
        out.append((bytes(np.frombuffer(b, np.uint8)[~m]), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(np.int8)])) == 1).sum())))
    return out


@pytest.mark.parametrize(("hot", "frequent", "lookup"), [(suffix_dedup.HOT_BYTES, 32, 500_000), (3000, 1, 500_000), (0, 2, 0), (0, 1, 500_000)])
def test_repeats_by_brute_force(spark, monkeypatch, hot, frequent, lookup):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "LOOKUP_KEYS", lookup)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    parts = [" ".join(word() for _ in range(r.randint(5, 200))) for _ in range(12)]
    texts = [" ".join(r.choice([r.choice(parts), word()]) for _ in range(r.randint(1, 12))) for _ in range(40)]
    texts += ["Of " * 400, "Of " * 133 + "O", "x", "", parts[0] + "é" + parts[1], "ab" * 300 + "c" + "ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(df).collect()}
    for i, (kept, gone, spans) in enumerate(brute_repeats([t.encode() for t in texts], 400)):
        assert (bytes(got[i]["kept"]), got[i]["n_removed"], got[i]["n_spans"]) == (kept, gone, spans), i


def test_narrowed_runs_of_equal_windows_meet():
    r = random.Random(8)
    shared = bytes(r.choice(b"abcd ") for _ in range(470))
    seen = []
    for _ in range(2):
        data = np.frombuffer(bytes(r.choice(b"abcd ") for _ in range(200)) + shared + bytes(r.choice(b"abcd ") for _ in range(200)), np.uint8)
        windows = {}
        for doc, lo, hi, key in zip(*suffix_dedup.window_runs(data, np.array([0]), np.array([len(data)])), strict=True):
            assert doc == 0
            n = int(hi - lo + 1)
            for width in suffix_dedup.WIDTHS:
                context, at = data[lo : hi + 400].tobytes(), 0
                for new, first, count in suffix_dedup.narrowed(context, n, int(key), width):
                    assert first == at and 1 <= count <= width
                    at += count
                    for s in range(first, at):
                        windows[width, context[s : s + 400]] = new
                assert at == n
        seen.append(windows)
    both = seen[0].keys() & seen[1].keys()
    assert len(both) == 71 * len(suffix_dedup.WIDTHS)
    assert all(seen[0][w] == seen[1][w] for w in both)


def test_merged_transforms_are_in_order():
    r = random.Random(6)
    blobs = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 300))) for _ in range(9)] + [b"abab" * 40] * 2
    groups = np.array([0, 1, 0, 0, 1, 0, 1, 1, 0, 1, 1], np.int32)
    parts, texts = [], []
    for k in (slice(0, 4), slice(4, 5), slice(5, 11)):
        parts.append(suffix_dedup.Transform.build(blobs[k], groups[k]))
        texts.append(b"\0".join(blobs[k]) + b"\0")
    for t, text in zip(parts, texts, strict=True):  # a transform has the symbols before the suffixes in order
        assert t.bwt.tolist() == [text[p - 1] + 1 if p and text[p - 1] else 0 for p in t.at.tolist()]
    for length in (1, 2, 7, 64, 100):
        which, index, common = suffix_dedup.merge(parts, length)
        rows = [(int(parts[w].group[i]), texts[w][parts[w].at[i] :].split(b"\0")[0][:length]) for w, i in zip(which, index, strict=True)]
        assert rows == sorted(rows) and len(set(zip(which.tolist(), index.tolist(), strict=True))) == sum(map(len, texts))
        for (g, a), (h, b), n in zip(rows, rows[1:], common[1:].tolist(), strict=False):
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert n == -1 if g != h else (n == length if a == b else n <= same < length and (n == 0 or same <= 2 * n))


def test_merge_reads_symbols_alone():
    """The merge gets no text: shards whose places are taken away merge in the same order."""
    blobs = [b"to be or not to be", b"not to be", b"or not to be"]
    parts = [suffix_dedup.Transform.build([b], np.zeros(1, np.int32)) for b in blobs]
    want = suffix_dedup.merge(parts, 5)
    bare = [suffix_dedup.Transform(p.bwt, p.group, None) for p in parts]
    assert all((x == y).all() for x, y in zip(want, suffix_dedup.merge(bare, 5), strict=True))


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    import corpus_pipeline

    r = random.Random(31)
    words = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 6))) for _ in range(n))
    passages_ = [words(60) for _ in range(4)]
    assert all(len(p) < 400 for p in passages_)
    texts = [words(40) + " " + p + " " + words(40) for p in passages_ for _ in range(3)] + [words(100) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x for x in corpus_pipeline.drop_repeats(spark, df, DATA).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_chars"] == len(got[i]["text"])
        if i < 12:
            assert passages_[i // 3] not in got[i]["text"] and len(got[i]["text"]) < len(t) - len(passages_[i // 3]) + 3
        else:
            assert got[i]["text"] == t


def test_packing_places_everything_once(spark):
    r = random.Random(7)
    rows = [(i, r.choice([0, 1, 100, 100, 512, 700, 3000, 20000, None])) for i in range(500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    total, bins = {}, {}
    for x in got:
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["n_tokens"]
        if x["bin_id"] is not None:
            bins.setdefault((x["bin_id"], x["bin_size"]), []).append((x["bin_offset"], x["n_tokens"]))
    assert total == {i: n or 0 for i, n in rows}
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), items in bins.items():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= size and size == min(s for s in packing.SIZES if s >= at)


def least_cost(items, price):
    """Least cost of bins for the items, over all their partitions."""
    best = float("inf")

    def go(i, bins):
        nonlocal best
        if i == len(items):
            best = min(best, sum(price(min(s for s in packing.SIZES if s >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= packing.SIZES[-1]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def plan_cost(items):
    from collections import Counter

    return sum(n * packing.cost(size) for _, n, _, size in packing.plan(Counter(items))[1])


def test_plan_against_the_least_cost():
    r, ratios = random.Random(17), []
    for _ in range(60):
        top = r.choice([300, 700, 2000, 8192])
        items = [r.randint(1, top) for _ in range(r.randint(1, 7))]
        ratios.append(plan_cost(items) / least_cost(items, packing.cost))
    print("plan / least cost: worst", max(ratios), "mean", sum(ratios) / len(ratios))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 2 and sum(ratios) / len(ratios) < 1.2


def test_plan_at_scale_against_a_lower_bound():
    """No bin costs less a token than the cheapest size that is full."""
    r = random.Random(18)
    for top in (400, 3000, 8192):
        items = [min(top, int(r.paretovariate(1.1) * 60)) for _ in range(20000)]
        bound = sum(items) * min(packing.cost(s) / s for s in packing.SIZES)
        print("plan / bound", top, plan_cost(items) / bound)
        assert 1 <= plan_cost(items) / bound < 1.2


def test_licence_places_against_all_positions():
    """Every window of a text is aligned: a template is found just where one covers enough of it."""
    r = random.Random(23)
    names = ["apache-2.0", "mit", "gpl-3.0"]
    scanner = licenses.Scanner({n: licenses.TEMPLATES[n] for n in names}, 0.8)
    for rate in (0.0, 0.05, 0.1, 0.15, 0.4, 0.5):
        for name in names:
            template = licenses.words_of(licenses.TEMPLATES[name])
            n = len(template)
            worn = [w if r.random() >= rate else b"edit%d" % r.randrange(999) for w in template]
            words = [b"w%d" % r.randrange(300) for _ in range(60)] + worn + [b"w%d" % r.randrange(300) for _ in range(60)]
            got = [f for f in scanner.scan(b" ".join(words).decode()) if f[0] == name]
            share = max(len(licenses.patience(words[a : a + n + 2], template)) / n for a in range(len(words) - n + 1))
            assert bool(got) == (share >= 0.8), (name, rate, share)
            if got:
                assert len(got) == 1 and got[0][1] <= share + 0.02 and 58 <= got[0][2] <= 70 and got[0][3] <= 60 + n + 2


def test_licences():
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    text = "Some words. Released under the MIT License. More.\nLicensed under the Apache License, Version 2.0. end. Released under the MIT Licence."
    assert [f[0] for f in s.scan(text)] == ["mit-notice", "apache-2.0-notice", "mit-notice"]
    assert [f[0] for f in s.scan("a b " + licenses.TEMPLATES["mit"].replace("merge,", "fuse"))] == ["mit"]
    assert not s.scan("the software and the license of nothing") and not s.scan("") and not s.scan(None)
    a, b = list("xaybzcd"), list("abqcd")
    got = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len(got) == 4


def test_passages_are_found(spark):
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = words(70)
    worn = [w if i % 23 else "edit" for i, w in enumerate(shared)]
    docs = [words(100) + shared + words(50), words(20) + worn + words(80), words(300), shared + words(10), words(60)]
    docs += [docs[4]]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = passages.shared_passages(df).collect()
    linked = {frozenset((x["doc_id"], x["source_id"])) for x in got if not x["whole_copy"]}
    reach = {i for pair in linked for i in pair}
    assert reach == {0, 1, 3} and len(linked) >= 2
    assert [(x["doc_id"], x["source_id"]) for x in got if x["whole_copy"]] == [(5, 4)]
    for x in got:
        assert x["end_word"] - x["start_word"] >= 50


def test_passages_are_found_beside_other_holders_of_their_seeds(spark):
    r = random.Random(21)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) + 2**63) % 2**64
    docs = []
    for holders in [((0, 45),)] * 8 + [((0, 30), (30, 60))] * 8:
        shared = words(60)
        pair = [" ".join(words(80) + shared + words(80)) for _ in range(2)]
        docs += pair
        for a, b in holders:  # each holder comes before the pair in order of text hashes
            while signed(text := " ".join(words(80) + shared[a:b] + words(80))) > min(map(signed, pair)):
                pass
            docs.append(text)
    ids = [i for n in range(8) for i in (3 * n,)] + [24 + 4 * n for n in range(8)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    linked = {frozenset((x["doc_id"], x["source_id"])) for x in passages.shared_passages(df).collect()}
    assert linked == {frozenset((i, i + 1)) for i in ids}


@pytest.mark.parametrize("block", [4096, 2])
def test_passages_of_pairs_between_other_holders_are_found(spark, monkeypatch, block):
    """A pair all of whose seeds first belong to another text, with one more between the two in order of text hashes."""
    monkeypatch.setattr(passages, "BLOCK", block)
    r = random.Random(22)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) + 2**63) % 2**64
    docs, want = [], set()
    for _ in range(6):
        shared = words(60)
        low = high = 0
        while high - low < 2**62:
            pair = [" ".join(words(80) + shared + words(80)) for _ in range(2)]
            low, high = sorted(map(signed, pair))
        want.add(frozenset((len(docs), len(docs) + 1)))
        docs += pair
        for a, b in ((0, 30), (30, 60), (15, 45)):
            for least, most in ((0, low), (low, high)):
                while not least < signed(text := " ".join(words(80) + shared[a:b] + words(80))) < most:
                    pass
                docs.append(text)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    linked = {frozenset((x["doc_id"], x["source_id"])) for x in passages.shared_passages(df).collect()}
    assert linked == want


def test_passages_link_all_pairs_over_classes_by_brute_force(spark):
    """Worn copies of one passage: every pair of texts that its whole chain links is in one class, and no other."""
    r = random.Random(23)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, docs = words(90), []
    for _ in range(40):
        docs.append(words(30) + [w if r.random() > 0.12 else words(1)[0] for w in shared] + words(30))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = {(x["doc_id"], x["source_id"]) for x in passages.shared_passages(df).collect()}
    texts = [[w.encode() for w in d] for d in docs]
    place = [dict(zip(h.tolist(), at.tolist(), strict=True)) for at, h in map(passages.seeds, texts)]
    root = list(range(40))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[top(a)] = top(b)
    checked = 0
    for i in range(40):
        for j in range(i):
            both = sorted(place[i].keys() & place[j].keys())
            if both:
                for links in passages.chain(np.array([place[i][h] for h in both]), np.array([place[j][h] for h in both])):
                    x0, x1, y0, y1, n = passages.align(texts[i], texts[j], links)
                    if min(x1 - x0, y1 - y0) >= 50 and n >= 0.8 * max(x1 - x0, y1 - y0):
                        checked += 1
                        assert top(i) == top(j)
    assert checked > 20


def test_links_of_worn_copies_grow_with_their_number(spark):
    """Copies of one passage, worn so that several classes hold each seed: some pairs join the classes, the others add nothing."""
    r = random.Random(25)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, docs = words(90), []
    for _ in range(200):
        docs.append(words(30) + [w if r.random() > 0.1 else words(1)[0] for w in shared] + words(30))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    linked = {frozenset((x["doc_id"], x["source_id"])) for x in passages.shared_passages(df).collect()}
    assert len({i for pair in linked for i in pair}) >= 195 and len(linked) < 8 * len(docs)


def test_masks_hold_seeds_as_far_as_a_chain_goes():
    r = np.random.default_rng(6)
    text = np.sort(r.integers(0, 5, 600))
    pos = np.concatenate([np.sort(r.choice(4000, n, replace=False)) for n in np.bincount(text)])
    h = r.integers(-(2**63), 2**63 - 1, 600)
    bits = passages._masks_of((h >> 20 & 0xFFFFFF).astype(np.uint32))
    for got, bit in zip(passages._behind(text, pos, h)[:2], bits, strict=True):
        for i in range(600):
            far = (text == text[i]) & (pos > pos[i] + passages.LINK) & (pos <= pos[i] + passages.CHAIN)
            assert int(got.view(np.uint64)[i]) == int(np.bitwise_or.reduce(bit[far]) if far.any() else 0)


def test_reach_of_many_is_that_of_each():
    r = np.random.default_rng(5)
    a, b = (sum(r.choice([0, 1, 15], 4000, p=[0.6, 0.38, 0.02]).astype(np.int64) << (4 * i) for i in range(passages.NEAR)) for _ in range(2))
    assert passages.could_reach_all(a, b).tolist() == [passages.could_reach(int(x), int(y)) for x, y in zip(a, b, strict=True)]


def test_what_cannot_reach_does_not():
    r = random.Random(11)
    for _ in range(3000):
        words = [b"%d" % r.randrange(3) for _ in range(r.randint(5, 40))], [b"%d" % r.randrange(3) for _ in range(r.randint(5, 40))]
        at = [r.randint(0, len(w) - 5) for w in words]
        near = [passages.surroundings(passages.word_hashes(w), np.array([p])) for w, p in zip(words, at, strict=True)]
        left = passages._reach(words[0][: at[0]][::-1], words[1][: at[1]][::-1])[0]
        right = passages._reach(words[0][at[0] + 5 :], words[1][at[1] + 5 :])[0]
        assert left <= passages.could_reach(int(near[0][0][0]), int(near[1][0][0]))
        assert right <= passages.could_reach(int(near[0][1][0]), int(near[1][1][0]))


def test_far_words_tell_more_of_what_cannot_reach():
    r, many = random.Random(12), []
    for _ in range(2000):
        same = [b"%d" % r.randrange(50) for _ in range(r.randint(0, 90))]
        words = [[b"%d" % r.randrange(3) for _ in range(r.randint(0, 30))] + same + [b"%d" % r.randrange(r.choice([2, 50])) for _ in range(r.randint(5, 150))] for _ in range(2)]
        at = [r.randint(0, len(w) - 5) if r.random() < 0.3 else len(w) - 5 - r.randint(0, min(90, len(w) - 5)) for w in words]
        sides = [[int(v[0]) for v in passages.surroundings(passages.word_hashes(w), np.array([p]))] for w, p in zip(words, at, strict=True)]
        left = passages._reach(words[0][: at[0]][::-1], words[1][: at[1]][::-1])[0]
        right = passages._reach(words[0][at[0] + 5 :], words[1][at[1] + 5 :])[0]
        x, y = sides
        got = passages.could_reach(x[0], y[0], x[2:3], y[2:3]), passages.could_reach(x[1], y[1], x[3:], y[3:])
        assert left <= got[0] <= passages.could_reach(x[0], y[0]) and right <= got[1] <= passages.could_reach(x[1], y[1])
        many.append((x, y, got))
    x, y = (np.array([m[k] for m in many]).T for k in range(2))
    assert passages.could_reach_all(x[0], y[0], x[2:3], y[2:3]).tolist() == [m[2][0] for m in many]
    assert passages.could_reach_all(x[1], y[1], x[3:], y[3:]).tolist() == [m[2][1] for m in many]


def test_phrases_and_runs_too_short_for_a_passage_are_not_looked_at_in_pairs(spark, monkeypatch):
    """Texts that share a phrase of 30 words, runs of one word of under 50 and of over 50, and a passage."""
    seen = {}

    def kept(df, label, first=passages.materialise):
        out = first(df, label)
        seen[label] = out.count() if label == "pairs" else 0
        return out

    monkeypatch.setattr(passages, "materialise", kept)
    r = random.Random(24)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    phrase, shared = words(30), words(60)
    docs = [words(40) + phrase + words(40) for _ in range(30)]
    docs += [words(40) + ["the"] * r.randint(20, 49) + words(40) for _ in range(30)]
    runs = range(len(docs), len(docs) + 20)
    docs += [words(40) + ["and"] * r.randint(60, 75) + words(40) for _ in runs]
    docs += [words(40) + shared + words(40) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    linked = {(x["doc_id"], x["source_id"]) for x in passages.shared_passages(df).collect()}
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[top(a)] = top(b)
    want = [{i} for i in range(60)] + [set(runs), {80, 81}]
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert seen["pairs"] <= 30  # 1326 pairs share the phrase or a short run


def test_seeds_of_a_long_text_are_those_of_its_parts(monkeypatch):
    words = [b"%d" % (i * i % 1013) for i in range(3000)]
    at, h = passages.seeds(words)
    w = passages.word_hashes(words)
    k = np.zeros(2996, np.uint64)
    for i in range(5):
        k = k * np.uint64(0x94D049BB133111EB) + w[i : i + 2996]
    k ^= k >> np.uint64(32)
    picks = sorted({min(range(i, i + 12), key=lambda j: (int(k[j]) >> 24, j)) for i in range(2996 - 11)})
    assert [p for n, p in enumerate(picks) if not n or k[p] != k[picks[n - 1]]] == at.tolist()


def test_chain_keeps_order_and_score():
    x, y = np.array([0, 10, 20, 5, 40]), np.array([100, 110, 121, 300, 50])
    got = passages.chain(x, y)
    assert got[0] == [(0, 100, 15), (20, 121, 5)] or got[0][0][:2] == (0, 100)
    for links in got:
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(links, links[1:], strict=False))


def test_classifiers_learn(spark):
    import zlib

    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(d + "/labels.parquet").collect()}
    q = {r["doc_id"]: r for r in queries.QUERIES["op10_quality"](spark, d).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(q[i]["held_out"] for i in held)
    assert np.mean([q[i]["predicted"] == labels[i]["quality"] for i in held]) > 0.95
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(d + "/labels.parquet").collect()}
    t = {r["doc_id"]: r for r in queries.QUERIES["op1_toxicity"](spark, d).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(t[i]["held_out"] for i in held)
    found = [i for i in held if t[i]["predicted"]]
    right = sum(labels[i]["toxic"] for i in found)
    assert right >= 0.9 * sum(labels[i]["toxic"] for i in held) and right >= 0.9 * len(found)
    flagged = next(r for r in t.values() if r["predicted"])
    assert flagged["spans"] and all(0 <= r["score"] <= 1 for r in t.values())


def test_chain_marginals_by_enumeration():
    from itertools import product

    from leafmill.llm.crf import Chain

    c = Chain(np.array([[0.3, -1.0], [-0.5, 0.8]]), 0.4)
    u = np.array([0.5, -1.2, 2.0, 0.1, -0.3])
    want, total = np.zeros(5), 0.0
    for tags in product((0, 1), repeat=5):
        e = np.exp(c.start * tags[0] + sum(u[i] * t for i, t in enumerate(tags)) + sum(c.t[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        total += e
        want += e * np.array(tags)
    assert np.allclose(c.marginals(u, np.array([0]), np.array([5])), want / total)


def test_odd_rows_and_empty_tables(spark, odd):
    import public_tokenizers as P

    tagger, lines = toxicity.train([]), quality.train([("good line here", 1), ("BAD!! BAD!! BAD!!", 0)] * 4)
    per_row = {
        "bpe": lambda d: bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True),
        "tox": lambda d: toxicity.tag_documents(d, tagger),
        "quality": lambda d: quality.score_documents(d, lines),
        "near": lambda d: simhash.near_groups(d),
        "repeats": lambda d: suffix_dedup.remove_repeats(d, digest_only=True),
        "rewrite": lambda d: suffix_dedup.rewrite(d),
        "exact": lambda d: exact_dedup.exact_groups(d, exact_dedup.default_snapshot()),
    }
    empty = odd.limit(0)
    for name, f in per_row.items():
        assert f(odd).count() == odd.count(), name
        assert f(empty).count() == 0, name
    for f in (licenses.scan_documents, passages.shared_passages, lambda d: simhash.keep_first(d), lambda d: exact_dedup.keep_first(d, exact_dedup.default_snapshot()), lambda d: quality.filter_documents(d, lines, 0.0)):
        f(odd).collect()
        assert f(empty).count() == 0
    assert packing.pack(empty.selectExpr("doc_id", "th as n_tokens")).count() == 0
    kept = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.remove_repeats(odd, digest_only=True).collect()}
    assert kept[1] == hashlib.sha256(b"").hexdigest() == kept[5]


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(DATA + "/documents.parquet")
    whole = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= whole, name
        whole = docs.count()
    assert docs.select("doc_id").distinct().count() == whole
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == whole
