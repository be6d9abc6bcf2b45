"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations, permutations

import pytest
import xxhash
from pyspark.sql import functions as F

from transitloom.llm import filter_audit, prefix_trie, simhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# 11


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = (own.get(c - int(c % 100), [])[:h] + t[h:]) if rebuild else t
    nodes = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(whole[c]) == len(p)))
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def talk(seed, n=60):
    """Conversations of few different turns, so that many begin alike; some are long, some turns repeat or lack a number."""
    rng, rows = random.Random(seed), []
    for c in rng.sample([*range(0, 30), *range(100, 130), 205, 300, 301], n):
        for k in range(rng.choice([1, 2, 3, 4, 8, 70 if rng.random() < 0.1 else 2])):
            rows.append((c, rng.choice([k, k, k, None, 2]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "bé", "ccc\U0001f600", None, ""])))
    rng.shuffle(rows)
    return rows


def as_rows(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed,bits,rebuild", [(1, 64, True), (2, 64, False), (3, 2, True)])
def test_trie(spark, seed, bits, rebuild):
    rows = [*talk(seed), (None, 1, "user", "lost"), *[(7, k, "user", f"long {k % 7}") for k in range(300)], *[(8, k, "user", f"long {k % 7}") for k in range(250)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({"conv": F.lit(1), "Uid": F.lit("x"), "d": F.lit(None).cast("long")})
    trie = prefix_trie.trie(df, rebuild=rebuild, bits=bits)
    assert as_rows(prefix_trie.report(trie)) == brute_trie(rows, rebuild)
    # a node's last turn can be looked up
    assert trie.nodes.where("d > 0").join(trie.turns, trie.nodes["src"] == trie.turns["uid"]).count() == trie.nodes.where("d > 0").count()


def test_trie_of_one_conversation_over_many_tasks(spark):
    rows = [(5, k, "user", f"turn {k}") for k in range(2000)] + [(6, k, "user", f"turn {k}") for k in range(1990)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = prefix_trie.ordered(df)
        assert turns.select(F.shiftright("uid", 33)).distinct().count() > 2
        got = prefix_trie.report(prefix_trie.trie(df)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(got) == 2001
    by = {r["depth"]: r for r in got}
    chars = [len(f"turn {k}") for k in range(2000)]
    assert all(by[d]["n_convs"] == (2 if d <= 1990 else 1) and by[d]["n_leaves"] == 1 for d in range(2001))
    assert all(by[d]["saved_tokens"] == sum(chars[max(d - 1, 0) : 1990]) for d in (0, 1, 2, 1000, 1990, 1991))
    assert by[1990]["ends_sha256"] == hashlib.sha256(b"6").hexdigest() and by[1991]["parent_conv_id"] == 5


def test_trie_of_nothing(spark):
    assert prefix_trie.report(prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), rebuild=True)).collect() == []


# 12


def brute_fingerprint(text):
    words = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    prints = {}
    for d, t in rows:
        prints.setdefault(brute_fingerprint(t), []).append(d)
    top = {f: f for f in prints}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            top[find(a)] = find(b)
    least = {}
    for f, ds in prints.items():
        least[find(f)] = min([d for d in ds if d is not None] + [least.get(find(f), 1 << 62)])
    return sorted((str(d), f"{brute_fingerprint(t):016x}", str(x if (x := least[find(brute_fingerprint(t))]) < 1 << 62 else None)) for d, t in rows)


def as_classes(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def families(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijÄ") for _ in range(rng.randint(1, 6)))
    bases, out = [[word() for _ in range(rng.randint(1, 300))] for _ in range(6)], []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        out.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return out


@pytest.mark.parametrize("seed,bucket", [(1, simhash.BUCKET), (2, 6), (3, 2)])
def test_simhash(spark, seed, bucket):
    rows = [*families(seed), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (903, "ONE"), (None, "one"), (904, "  x"), (905, "a b c d e" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"fp": F.lit(1), "w": F.lit(2), "Component_id": F.lit(3)})
    assert as_classes(simhash.classes(df, bucket=bucket)) == brute_classes(rows)


@pytest.mark.parametrize("bucket", [4096, 40, 9])
def test_links_of_a_dense_ball(spark, bucket):
    """Fingerprints a few bits around common centres: large buckets, whose links are those of brute force."""
    rng, prints = random.Random(5), set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    top = {f: f for f in prints}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            top[find(a)] = find(b)
    want = defaultdict(set)
    for f in prints:
        want[find(f)].add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long")
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(df, bucket=bucket).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in links)
    top = {f: f for f in prints}
    for u, v in links:
        top[find(u)] = find(v)
    got = defaultdict(set)
    for f in prints:
        got[find(f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_classes(simhash.classes(odd)) == brute_classes(rows)
    assert simhash.classes(nothing).count() == 0


# 13


def brute_audit(docs, labels):
    good, toxic, least, masks = set(), set(), {}, []
    for d, q, t in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if t == 1 else set()
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, text, lang in docs:
        x, w = text or "", SPACED.findall(text or "")
        m = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), "D": bool(re.search("[#$%&*|]", x)), "E": d is not None and least[x] < d}
        masks.append((lang or "", {k for k, v in m.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley, rows = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                here = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(here)
                fails = [m for m in own if f in m[1]]
                rows.append((part, "".join(order), k + 1, len(left), len(here), len(fails) - len(here), sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def as_audit(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_audit(spark):
    rng = random.Random(3)
    docs = []
    for i in range(80):
        w = [rng.choice(["Ab", "c", "dé", "e|", "FGH", "i", *map(str, range(rng.choice([1, 400])))]) for _ in range(rng.choice([0, 3, 150, 199, 200, 201, 300]))]
        docs.append((i, " ".join(w), rng.choice(["en", "fr", None, ""])))
    docs += [(i + 200, t, rng.choice(["en", "de"])) for i, t, _ in docs[:20]] + [(5, docs[5][1], "fr"), (None, docs[5][1], "fr"), (None, None, "en"), (300, None, "en"), (301, "", "en"), (302, "x " * 50_000, None)]
    labels = [(rng.randrange(310), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1), (5, 0, 1), (5, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4).withColumns({"mask": F.lit(1), "part": F.lit("x"), "Digest": F.lit(0)})
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1))
    assert as_audit(filter_audit.audit(df, lb)) == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), lb).count() == 0
    assert as_audit(filter_audit.audit(df, lb.limit(0))) == brute_audit(docs, [])


def test_parity_sums_invert_exactly(spark):
    rows = [("p", m, m % 2, m % 3 == 0) for m in range(32) for _ in range(m * m % 11)]
    masked = spark.createDataFrame(rows, "part string, mask int, good int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    r = filter_audit.cells(masked).first()
    assert r["n"] == [m * m % 11 for m in range(32)] and r["good"] == [m % 2 * (m * m % 11) for m in range(32)] and r["toxic"] == [(m % 3 == 0) * (m * m % 11) for m in range(32)]
