import hashlib
import re

import numpy as np

from ravelog.llm import ann, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute_nearest(rows, query, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, v in good:
        if not query(q):
            continue
        scored = sorted((-float(v @ c / np.sqrt((v @ v) * (c @ c))), i) for i, c in good if i != q and len(c) == len(v))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return out


def test_nearest_matches_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), 5, query_block=4, row_block=100)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted(brute_nearest(rows, lambda q: q % 50 == 0))


def test_nearest_edges(spark):
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(40)] + [(50, [3.0, -1.0, 0.5]), (51, [0.0, 0.0, 0.0]), (52, None), (53, [1.0, None, 2.0]), (54, [1.0, float("nan"), 1.0]), (55, [1.0, 2.0]), (100, [2.0, 4.0, 6.0]), (None, hot)]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, v string, score double")
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), 5)
    found = {q: [(r["rank"], r.vec_id) for r in sorted(got.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100)}
    assert found[0] == [(i + 1, i + 1) for i in range(5)]  # ties to the smaller id
    assert found[100] == [(i + 1, i) for i in range(5)]
    assert len(found[50]) == 5
    none = spark.createDataFrame([], table.schema)
    assert ann.nearest(none, none, 5).count() == 0


def brute_leaks(docs, items, span=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(span, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = {}
    for n, text in enumerate(docs):
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if got := windows.get(tuple(words[i : i + size])):
                    found |= got
                    hit.update(range(i, i + size))
        out[n] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def reported(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(6)] + ["Ünder", "x9"]
    text = lambda n: " ".join(rng.choice(words, n)) + ("." if n % 2 else "")
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 40, 60))] + [(60, None), (None, text(20)), (3, text(15)), (61, "!!")]
    docs = [text(int(n)) for n in rng.integers(0, 300, 60)] + [items[5][1] or "", None, "", "w1"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(docs, [(i, t) for i, t in items if i is not None and t is not None])
    assert reported(decontaminate.report(frame, bench)) == expected
    assert reported(decontaminate.report(frame, bench, shard_bytes=300)) == expected  # many passes


def test_every_span_is_found(spark):
    """A shared span of exactly ten words is found wherever it stands."""
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(500)]
    for _ in range(30):
        item = list(rng.choice(vocabulary, 30))
        at = int(rng.integers(0, 21))
        doc = list(rng.choice(vocabulary, 40)) + ["zz"] + item[at : at + 10] + ["zz"] + list(rng.choice(vocabulary, 25))
        index = decontaminate.Index([(7, " ".join(item))], 10, 5)
        runs, found = index.hits([w.encode() for w in doc])
        assert found == {7} and runs == [41, 51]


def test_index_is_small():
    """The default shard of invented text takes under 100 MB in a worker."""
    import tracemalloc

    rng = np.random.default_rng(4)
    vocabulary = [f"{v:x}w" for v in rng.integers(1 << 24, size=200_000)]
    items, size = [], 0
    while size < 4 << 20:
        items.append((len(items), " ".join(vocabulary[i] for i in rng.integers(len(vocabulary), size=200))))
        size += len(items[-1][1])
    tracemalloc.start()
    index = decontaminate.Index(items, 10, 5)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    print(f"kept {now / 1e6:.0f} MB, most {peak / 1e6:.0f} MB")
    assert peak < 100e6
    words = [w.encode() for w in items[77][1].split()]
    assert index.hits([b"aa", *words[40:55], b"bb"]) == ([1, 16], {77})


def test_leak_edges(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert decontaminate.report(no_docs, bench).count() == 0
    clash = odd_docs.withColumnsRenamed({"key": "hit", "fp": "items", "size": "n_words"})
    kept = decontaminate.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns and kept.count() == odd_docs.count() - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd_docs, none).count() == odd_docs.count()
