import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from flowatlas.llm import exact_dedup, mixing, near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], 0, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = ["a b", "ab", "a  b\n", None, "", " \t", "AB", "x" * 50_000, "x" * 49_999 + "y", "a b", "é", "é"]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return sorted((i, sorted(g)[0][1], len(g), i == sorted(g)[0][1], hashlib.sha256(body.encode()).hexdigest()) for body, g in groups.items() for _, i in g)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup_against_brute_force(spark, monkeypatch, hot):
    if hot:  # salts everything that repeats
        monkeypatch.setattr(exact_dedup, "LEAST_HOT", 1)
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10**9)
    dice = random.Random(1)
    texts = TEXTS + [dice.choice(["copy one", "copy  one", "other"]) for _ in range(300)]
    found = exact_dedup.exact_dedup(docs(spark, texts), salts=4)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect())) == brute_exact(list(enumerate(texts)))


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    rows = docs(spark, ["a", "a"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()} == {(None, 2)}
    twice = docs(spark, ["a"]).unionByName(docs(spark, ["a"]))
    found = exact_dedup.exact_dedup(twice).collect()
    assert sorted((r.keep_id, r.group_size, r.kept) for r in found) == [(0, 2, False), (0, 2, True)]
    spaced = docs(spark, ["a b", "ab"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted((r.group_size, r.kept) for r in exact_dedup.exact_dedup(spaced).collect()) == [(2, False), (2, True)]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    texts = TEXTS + ["One two THREE four", "one two three four", "one two", "É É é"]
    found = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    fps = [brute_simhash(t) for t in texts]
    assert [int(found[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [found[i].component_id for i in range(len(texts))] == brute_components(fps)


@pytest.mark.parametrize("large", [1 << 15, 4])
def test_links_of_dense_fingerprints(spark, large):
    """Chains, a dense ball and strangers; with a small limit the points way is taken."""
    dice = random.Random(7)
    base, fps = dice.getrandbits(64), set()
    for _ in range(150):
        v = base
        for b in dice.sample(range(64), dice.randint(0, 3)):
            v ^= 1 << b
        fps.add(v)
    v = dice.getrandbits(64)
    for i in range(0, 40, 2):
        v ^= 3 << i
        fps.add(v)
    fps |= {dice.getrandbits(64) for _ in range(200)} | {0, 1, 2**64 - 1}
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = near_dedup.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), large=large)
    roots = {r.node: r.root for r in near_dedup.components(links).collect()}
    groups = defaultdict(set)
    for f, s in zip(fps, signed):
        groups[roots.get(s, s)].add(f)
    expected = defaultdict(set)
    for f, root in zip(fps, brute_components(fps)):
        expected[root].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_dedup_of_no_rows(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def fill(sizes, share=1.5, repeats=2):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = {}, share * sum(sizes.values())
    while True:
        rest = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s: repeats * sizes[s] for s in rest if rest[s] > repeats * sizes[s]}
        if not over:
            return full | rest
        full |= {s: float(v) for s, v in over.items()}


def test_mixing_meets_targets_and_repeats(spark):
    dice = random.Random(3)
    names = [dice.choice(["hot", "hot", "hot", "b", "c", "É", "z", None]) for _ in range(400)]
    texts = [" ".join(["w"] * dice.choice([0, 1, 5, 40, 300])) for _ in names]
    texts[7] = None
    rows = docs(spark, texts, names)
    found = {r.doc_id: r for r in mixing.taken_words(rows, block=64).collect()}
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    totals = Counter()
    for i, s in enumerate(names):
        totals[s] += sizes[i]
    targets, taken = fill(totals), Counter()
    for i, s in enumerate(names):
        r = found[i]
        assert r.size == sizes[i] and r.source_size == totals[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in totals:
        assert 0 <= targets[s] - taken[s] < 1 + 1e-6
    again = {r.doc_id: r.taken for r in mixing.taken_words(rows.repartition(7), block=64).collect()}
    assert again == {i: r.taken for i, r in found.items()}


def test_schedule_interleaves_sources(spark):
    """Every window of the schedule has each source near its share: the golden-ratio points' discrepancy is small."""
    names = ["a", "b", "c"] * 200
    mixture, _ = mixing.mix(docs(spark, ["w " * 100] * 600, names), block=100)
    slots = [r.source for r in mixture.groupBy("slot").agg(F.min("source").alias("source")).orderBy("slot").collect()]
    share = Counter(slots)
    for n in range(50, len(slots) - 10, 50):
        head = Counter(slots[:n])
        assert all(abs(head[s] - n * share[s] / len(slots)) < 6 for s in share)


def test_mixing_edges(spark):
    assert mixing.taken_words(docs(spark, [])).count() == 0
    only = mixing.taken_words(docs(spark, ["", None])).collect()
    assert {(r.size, r.taken) for r in only} == {(0, 0)}


def test_mixing_counts_rows_that_share_an_id_apart(spark):
    rows = docs(spark, ["w " * 10, "w " * 30, "v " * 10, "v " * 10, "x " * 10, "x " * 10]).withColumn("doc_id", F.when(F.col("doc_id") < 2, 7).when(F.col("doc_id") < 4, F.lit(None)).otherwise(9).cast("long"))
    found = sorted(((r.doc_id or 0), r.size, r.taken) for r in mixing.taken_words(rows, block=8).collect())
    assert [x[:2] for x in found] == [(0, 10), (0, 10), (7, 10), (7, 30), (9, 10), (9, 10)]
    assert sum(x[2] for x in found) == 120 and all(size <= taken <= 2 * size for _, size, taken in found)


def test_targets_of_many_sources(spark):
    """More sources than partitions, so that places and sums come from two levels."""
    dice = random.Random(11)
    sizes = {f"host{i}": dice.choice([0, 1, 7, 50, 5000]) for i in range(300)} | {None: 40}
    sized = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r for r in mixing.source_targets(sized).collect()}
    expected = fill(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert [found[s]._no for s in order] == list(range(len(order)))
    assert all(found[s].target == pytest.approx(expected[s]) for s in order)
