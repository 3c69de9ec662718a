from ravelog.llm import common, simhash_dedup


def brute_components_of(texts):
    """Smallest doc_id of each near-duplicate group of {doc_id: text}."""
    ids = sorted(texts)
    prints = {i: simhash_dedup.fingerprint(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def test_connected_groups(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    edges = spark.createDataFrame(chain + [(1000 + i, 999) for i in range(300)], "a long, b long")
    got = {r.node: r.root for r in common.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 101, 102)} == {100} and 200 not in got
    assert all(got[1000 + i] == 999 for i in range(300))
    assert common.connected(edges.limit(0)).count() == 0
