"""Operators 3, 7 and 8 against brute force."""

import hashlib
import random
import re

import pytest

from transitloom.llm import line_dedup, ngram_join, suffix_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def classes(rows, width, percent):
    """Brute force over all pairs: component of each set."""
    sets = {shingles(t, width) for _, t in rows} - {frozenset()}
    top = {s: s for s in sets}

    def find(s):
        while top[s] != s:
            s = top[s]
        return s

    listed = sorted(sets, key=len)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                top[find(a)] = find(b)
    least = {}
    for d, t in rows:
        s = shingles(t, width)
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    return sorted((str(d), len(shingles(t, width)), str(least.get(find(shingles(t, width))) if shingles(t, width) else d)) for d, t in rows)


def got_classes(df, width, percent, **k):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.classes(df, width, percent, **k).collect())


def near_copies(seed, n=120):
    """Families of near copies with growing edits, a passage that many share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passage, out = [word() for _ in range(30)], []
    bases = [[word() for _ in range(rng.randint(3, 150))] for _ in range(8)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += passage
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 85)])
def test_ngram_join(spark, seed, width, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_classes(df, width, percent) == classes(rows, width, percent)


def test_ngram_join_without_leaders_and_with_empty_parts(spark):
    rows = near_copies(4, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(df, 4, 85, leader_rounds=0) == classes(rows, 4, 85)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.bucket_pairs, "__defaults__", (2,))
    rows = near_copies(6, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(df, 4, 85) == classes(rows, 4, 85) == got_classes(df, 4, 85, leader_rounds=0)


def test_signatures_meet():
    import numpy as np

    rng, bands = np.random.default_rng(5), ngram_join.Bands(85)
    for n in (*range(7, 60), 100, 300, 1000, 4000):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a = np.unique(base[:n])
        for drop in range(0, 15 * n // 100 + 1, max(1, n // 25)):
            b = np.unique(np.concatenate([base[: n - drop], base[n : n + max(0, 15 * n // 185 - drop)]]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) != both or len(b) != both:
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    assert len(np.intersect1d(ngram_join.signatures(a, bands), ngram_join.signatures(b, bands))), (n, drop)


def test_ngram_join_odd_inputs(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got_classes(odd, 4, 85) == classes(rows, 4, 85)
    assert ngram_join.classes(nothing).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "9", "10", "None"])


def removed(rows, length=100):
    """Brute force: what is left of each document, in the order of doc_id."""
    seen, out = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None}, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen[data[p : p + length]] = doc
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def reported(df, **k):
    return {(r["doc_id"]): tuple(r)[1:] for r in suffix_dedup.report(df, **k).where("doc_id is not null").collect()}


def repeated_texts(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n)) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé \n") for _ in range(n))
    passages = [text(rng.randint(90, 400)) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 150)) if rng.random() < 0.5 else rng.choice(passages)[: rng.randint(95, 400)] for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    return [*rows, (40, "x" * 700), (41, "ab" * 200), (42, None), (43, rows[3][1]), (44, "y" * 99), (45, "y" * 100)]


@pytest.mark.parametrize("seed,group", [(1, 4096), (2, 2)])
def test_suffix_dedup(spark, seed, group):
    rows = repeated_texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert reported(df, group=group) == removed(rows)


@pytest.mark.parametrize("segment,local_rows", [(150, 10), (1000, 50), (1 << 20, 1)])
def test_suffix_dedup_of_long_texts_in_pieces(spark, segment, local_rows):
    rows = repeated_texts(7) + [(100, repeated_texts(8)[5][1] * 3), (101, "".join(t or "" for _, t in repeated_texts(7)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert reported(df, segment=segment, local_rows=local_rows) == removed(rows)


def test_suffix_dedup_odd_inputs(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert reported(odd) == removed(rows)
    assert suffix_dedup.report(nothing).count() == 0 and suffix_dedup.report(odd).count() == 12


@pytest.mark.parametrize("seed", range(3))
def test_deep_shallow_sorts(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(400)] + [b"a" * 30 + bytes([i]) for i in range(60)] + [b"same"] * 3
    for shallow in (8, suffix_dedup.SHALLOW):
        order, lcp = suffix_dedup.deep_shallow(strings, shallow)
        assert [strings[i] for i in order] == sorted(strings)
    strings = strings * 3  # more than the multikey quicksort sorts at once
    order, lcp = suffix_dedup.deep_shallow(strings, 8)
    assert [strings[i] for i in order] == sorted(strings)
    assert all(lcp[k] == suffix_dedup.common(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))


def line_removal(rows):
    """Brute force: (doc_id, line) of lines with an earlier similar line."""
    every = sorted({(d, k, frozenset(w for w in t.split(" ") if w)) for d, x in rows if d is not None and x is not None for k, t in enumerate(x.split("\n"))}, key=lambda x: x[:2])
    every = [x for x in every if x[2]]
    out = set()
    for i, (d, k, s) in enumerate(every):
        for _, _, t in every[:i]:
            both = len(s & t)
            if 5 * both >= 4 * (len(s) + len(t) - both):
                out.add((d, k))
                break
    return out


def check_lines(df, rows):
    gone = line_removal(rows)
    want = []
    for d, x in rows:
        lines = [] if x is None else x.split("\n")
        kept = [t for k, t in enumerate(lines) if (d, k) not in gone]
        want.append((str(d), len(lines), len(lines) - len(kept), None if x is None else "\n".join(kept)))
    assert sorted(map(str, want)) == sorted(str((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"])) for r in line_dedup.line_report(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append((" " if rng.random() < 0.8 else "  ").join(w))
        rows.append((i, "\n".join(lines)))
    check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_line_dedup_odd_inputs(spark, odd, nothing):
    # long texts whole; their lines differ in one word, so that each matches the first
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_lines(odd, rows)
    many = [(1, " ".join(f"a{i}" for i in range(300))), (2, " ".join(f"a{i}" for i in range(20, 310))), (3, " ".join(f"a{i}" for i in range(80, 380))), (4, " ".join(f"a{i}" for i in range(66)) + "\n" + " ".join(f"a{i}" for i in range(4, 64)))]
    check_lines(spark.createDataFrame(many, "doc_id long, text string"), many)
    assert line_dedup.line_report(nothing).count() == 0
    after = line_dedup.dedup(odd, drop_emptied=True)
    assert after.columns == odd.columns and 8 not in {r["doc_id"] for r in after.collect()}


def test_line_links_make_few_pairs_and_lose_none(spark):
    """Lines that share rare words (each is in 40) without being similar make no pairs; similar ones share two links."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(400)]
    texts = [" ".join([f"r{i % 50}", *rng.sample(common, 30)]) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = line_dedup.shared_links(line_dedup.lines(docs, line_dedup.word_ranks(docs)))
    assert line_dedup.other_pairs(shared, spark.createDataFrame([], "doc_id long, line int")).count() == 0
    rows = []
    for n in range(1, 45):  # words lost, won and changed, up to the limit and one beyond it
        base = [f"n{n}w{i}" for i in range(n)]
        for k in (n // 9, n // 9 + 1, n // 5, n // 5 + 1):
            lost = set(rng.sample(range(n), min(k, n)))
            rows.append((len(rows), "\n".join(" ".join(w) for w in (base, [w for i, w in enumerate(base) if i not in lost], [f"x{n}y{k}z{i}" if i in lost else w for i, w in enumerate(base)], base + [f"e{n}y{k}z{i}" for i in range(k)]))))
    check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
