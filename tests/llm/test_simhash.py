import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from tablesync.llm.queries import QUERIES
from tablesync.llm.simhash import SEGMENTS, WIDE_SEGMENTS, connected, long_links, near_dedup, short_links, simhash_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def check(df, ids, texts):
    fps = [brute_fingerprint(t) for t in texts]
    components = brute_components(ids, fps)
    got = sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in df.collect())
    assert got == sorted(zip(ids, fps, components, strict=True))


def test_query_equals_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    components = dict(zip(fps, brute_components(list(fps), list(fps.values())), strict=True))
    got = QUERIES["op3_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        d: (f"{fps[d]:016x}", components[d]) for d in fps
    }
    assert len(got) == len(rows)


def test_odd_texts(spark, documents):
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefg") * rng.randint(1, 5) for _ in range(70_000))
    texts = ["", None, " \t\n", "One two", "one TWO", "x", long, long + " end", "a b c d", "É é"]
    check(simhash_components(documents(spark, texts)), list(range(len(texts))), texts)


def test_no_rows_and_clashing_columns(spark, documents):
    none = documents(spark, ["a"]).where("false")
    assert simhash_components(none).count() == 0
    more = documents(spark, ["a b c d e", "a b c d e", "z"]).selectExpr(
        "*", "1 AS fp", "2 AS label", "3 AS node", "4 AS u", "5 AS key", "6 AS _keep"
    )
    kept = near_dedup(more)
    assert kept.columns == more.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_repeated_and_null_ids(spark, documents):
    docs = documents(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (None, "other words"), (3, "A b")])
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash_components(docs).collect()]
    same, other = [x for x in got if x[2] == 3], [x for x in got if x[2] is None]
    assert sorted(str(x[0]) for x in same) == ["3", "5", "5", "None"] and len({x[1] for x in same}) == 1
    assert [x[0] for x in other] == [None]


def test_large_ids_beside_null(spark, documents):
    docs = documents(spark, [(2**60 + 1, "a"), (None, "b")])
    assert {r["doc_id"] for r in simhash_components(docs).collect()} == {2**60 + 1, None}


@pytest.mark.parametrize(("seed", "segments"), [(1, SEGMENTS), (2, SEGMENTS), (1, WIDE_SEGMENTS), (3, WIDE_SEGMENTS)])
def test_links_at_every_distance(spark, seed, segments):
    """Random fingerprints around centres, against all pairs."""
    rng = random.Random(seed)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(8):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "fp long, label long")
    expected = brute_components(signed, fps)
    close = {r["node"]: r["label"] for r in connected(short_links(nodes)).collect()}
    labelled = spark.createDataFrame([(f, close.get(f, f)) for f in signed], "fp long, label long")
    far = {r["node"]: r["label"] for r in connected(long_links(labelled, segments)).collect()}
    got = [far.get(close.get(f, f), close.get(f, f)) for f in signed]
    groups = lambda labels: {frozenset(f for f, x in zip(signed, labels, strict=True) if x == y) for y in labels}
    assert groups(got) == groups(expected)


def wide_similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(t.translate(LOWER)) for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_dedup_takes_pairs_from_similarity_80_percent(spark, documents):
    rng = random.Random(5)
    texts, wanted = [], set()
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(250)]
        edited = list(words)
        for at in range(20, 20 + 40 * (1 + i % 5), 40):
            edited[at] = f"edit{i}x{at}"
        pair = [" ".join(words), " ".join(edited)]
        assert 0.8 <= wide_similarity(*pair) < 0.97
        wanted.add(len(texts))
        texts += pair
    far = [f"v{rng.randrange(5000)}" for _ in range(250)]
    other = [w if k % 8 else f"o{k}" for k, w in enumerate(far)]
    assert wide_similarity(" ".join(far), " ".join(other)) < 0.5
    wanted |= {len(texts), len(texts) + 1}
    texts += [" ".join(far), " ".join(other)]
    assert {r["doc_id"] for r in near_dedup(documents(spark, texts)).collect()} == wanted


def test_similar_pairs_of_one_bucket_meet_beside_a_leader(spark, documents):
    """A chain: the ends are not similar, each is similar to the middle."""
    words = [f"c{k}" for k in range(250)]
    cut_at = lambda places: " ".join("x%d" % k if k in places else w for k, w in enumerate(words))
    chain = [(3, cut_at({20, 60, 100, 140})), (2, cut_at(set())), (1, cut_at({30, 70, 110, 150}))]
    assert wide_similarity(chain[0][1], chain[2][1]) < 0.8 <= wide_similarity(chain[0][1], chain[1][1])
    assert [r["doc_id"] for r in near_dedup(documents(spark, chain)).collect()] == [1]
