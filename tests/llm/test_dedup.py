import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ravelog.llm import common, hamming, line_dedup, queries, simhash_dedup


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_edit_similarity_is_levenshtein():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a, b = ("".join(rng.choice(list("abc "), rng.integers(0, 14))) for _ in range(2))
        longest = max(len(a), len(b)) or 1
        expected = 1 - levenshtein(a, b) / longest
        assert line_dedup.edit_similarity(a, b) == pytest.approx(expected)
        lo, hi = line_dedup.edit_bounds(a, b, 0.8)
        assert lo <= levenshtein(a, b) <= hi
        lo, hi = line_dedup.edit_bounds(a, b, 0.8, exact=False)
        assert lo <= levenshtein(a, b) <= hi
        assert (1 - hi / longest >= 0.8) == (1 - levenshtein(a, b) / longest >= 0.8)
        assert line_dedup.alike(a, b, 0.8) == (line_dedup.edit_similarity(a, b) >= 0.8)


def test_line_table_matches_single_lines():
    texts = [None, "", "A b c d e.\nshort\n---\n a  B c, d E", "x " * 30 + "\n" + "y z w v u"]
    t = line_dedup.line_table(texts)
    assert list(zip(t.text, t.number)) == [(2, 0), (2, 1), (2, 3), (3, 0), (3, 1)]
    assert t.ident[0] == t.ident[2] and t.prints[0] == t.prints[2] and (t.keys[0] == t.keys[2]).all() and len(set(t.ident.tolist())) == 4
    assert t.fuzzy.tolist() == [True, False, True, True, True]
    line_dedup.CHUNK, kept = 3, line_dedup.CHUNK
    try:
        assert (line_dedup.line_table(texts).prints == t.prints).all()
    finally:
        line_dedup.CHUNK = kept
    for single in ("one two three four five six", "我们使用饼干来改善您的浏览体验并分析网站流量请接受"):  # alone and among others
        alone, among = line_dedup.line_table([single]), line_dedup.line_table(["zz yy", f"a b\n{single}\nc d"])
        assert alone.keys[0].tolist() in among.keys.tolist() and alone.prints[0] in among.prints


def alike_pairs(lines, similarity=0.8):
    """All pairs of lines with an edit similarity of at least ``similarity``; character counts only rule out."""
    lines = sorted(lines, key=len)
    size = np.array([len(x) for x in lines])
    counts = np.zeros((len(lines), 64), np.int32)
    for i, line in enumerate(lines):
        counts[i] = np.bincount([ord(c) % 64 for c in line], minlength=64)
    for i in range(len(lines)):
        stop = np.searchsorted(size, size[i] / similarity + 1e-9, side="right")
        differ = counts[i + 1 : stop] - counts[i]
        least = np.maximum(np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1))
        for j in np.flatnonzero(least <= (1 - similarity) * size[i + 1 : stop] + 1e-9) + i + 1:
            if line_dedup.edit_similarity(lines[i], lines[j]) >= similarity:
                yield lines[i], lines[j]


def test_fuzzy_lines_against_all_pairs(spark, sf):
    """Whole table, expectation by edit similarity alone: nine tenths of the links are found, and nothing else goes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    places = defaultdict(list)
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if words := line_dedup.normal_words(line):
                places[b" ".join(words).decode()].append((doc, n))
    fuzzy = [x for x in places if len(x.split(" ")) >= 5 or len(x) >= 20]
    links = list(alike_pairs(fuzzy))
    again = {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    names = list(places)
    number = {x: i for i, x in enumerate(names)}
    of = groups(len(names), [(number[a], number[b]) for a, b in links])
    want = set()
    for root in set(of):
        at = sorted(p for x, r in zip(names, of) if r == root for p in places[x])
        want |= set(at[1:])
    exact = {p for x in names for p in sorted(places[x])[1:]}
    assert exact <= again <= want
    linked = [(a, b) for a, b in links if len({p in again for p in (min(places[a]), min(places[b]))}) == 2 or (min(places[a]) in again and min(places[b]) in again)]
    print(f"{len(linked)} of {len(links)} links")
    assert len(linked) >= 0.9 * len(links) and len(links) > 10


@pytest.mark.parametrize("words, changed", [(8, 1), (12, 1), (20, 2), (30, 3), (50, 5)])
def test_blocks_meet_for_replaced_words(words, changed):
    """Share of line pairs that agree in a block and lie within the SimHash distance, by words replaced."""
    rng = np.random.default_rng(words)
    met, n = 0, 400
    for k in range(n):
        line = [f"w{rng.integers(1 << 40):x}" for _ in range(words)]
        other = list(line)
        for i in rng.choice(words, changed, replace=False):
            other[i] = f"w{rng.integers(1 << 40):x}"
        t = line_dedup.line_table([" ".join(line), " ".join(other)])
        met += (t.keys[0] == t.keys[1]).any() and bin(int(t.prints[0] ^ t.prints[1])).count("1") <= 16
    assert met >= 0.9 * n


def test_fuzzy_line_goes(spark):
    base = " ".join(f"word{i * 37 % 101}ing" for i in range(60)) + " abandoned mill the quick brown fox jumps over the lazy dog near the quiet river bank while seven grey herons watch from wooden poles beside an abandoned mill"
    near = base.replace("abandoned", "abandonned")
    docs = spark.createDataFrame([(1, f"intro line\n{base}\nbye"), (2, f"{near}\nother words that nobody else has written yet\nbye"), (3, base.upper() + "!!")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r["__lines"], r["__removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1] == (f"intro line\n{base}\nbye", 3, 0)
    assert out[2] == ("other words that nobody else has written yet", 3, 2)  # "bye" is an exact copy
    assert out[3] == ("", 1, 1)


def test_line_dedup_edges(spark, odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "__lines", "__removed"] and out.count() == odd_docs.count()
    rows = out.collect()
    assert all(r.text is None for r in rows if r.doc_id == 2)
    assert [r.text for r in rows if r.doc_id == 6] == ["Ärger über Öl"]  # an exact copy, however short
    assert sum(r["__removed"] for r in rows if r.doc_id is None) == 1
    assert line_dedup.dedup_lines(no_docs).count() == 0


def plain_fingerprint(text, shingle=4):
    """By definition, one bit and one shingle at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashed = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(rows, distance=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= distance]
    of = groups(len(rows), links)
    least = defaultdict(lambda: None)
    for (doc, _), r in zip(rows, of):
        least[r] = doc if least[r] is None else least[r] if doc is None else min(least[r], doc)
    return sorted(((str(doc), p, str(least[r])) for (doc, _), p, r in zip(rows, prints, of)))


def test_components_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash_dedup.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_components_edges(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash_dedup.near_duplicates(odd_docs).collect())
    assert got == brute_components(rows)
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    kept = simhash_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]


def test_dense_fingerprints_match_brute_force(spark):
    """A ball of near fingerprints, chains and far ones: buckets with many members."""
    rng = np.random.default_rng(3)
    flip = lambda v, n: v ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    centre = [int(rng.integers(1 << 62)) for _ in range(3)]
    values = list({flip(c, int(rng.integers(0, 6))) for c in centre for _ in range(250)} | {int(rng.integers(1 << 62)) for _ in range(200)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v, v) for v in signed], "id long, fp long")
    got = {r.node: r.root for r in hamming.near_groups(df, 4, 6, 2, 8).collect()}
    assert got == {r.node: r.root for r in hamming.near_groups(df, 4, 8, 4, 0).collect()}  # neither keys nor pivots decide
    assert [hamming.key_blocks(n, 4) for n in (1000, 1 << 23, 1 << 27, 1 << 33)] == [6, 6, 7, 8]
    links = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 4]
    of = groups(len(values), links)
    parts, found = defaultdict(set), defaultdict(set)
    for v, r in zip(signed, of):
        parts[r].add(v)
        found[got.get(v, v)].add(v)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, found.values()))


def test_every_group_keeps_a_document(spark):
    """Null ids only, a null id beside a named one, one id with texts of two groups, copies with other columns."""
    text = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(5)]
    rows = [(None, text[0], 2), (None, text[0], 1), (None, text[1], 1), (None, text[2], 1), (7, text[2], 1), (8, text[3], 1), (8, text[4], 1)]
    kept = simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((str(r.doc_id), r.text, r.n) for r in kept) == sorted((str(d), t, n) for d, t, n in [rows[1], rows[2], *rows[4:]])


def test_survivors_of_any_column_type(spark):
    rows = [(1, "a b c d e f", {"k": 2}, [b"x"], 1), (1, "a b c d e f", {"k": 1}, [b"x"], 2), (2, "a b c d e f", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_doc map<string,int>, kept_row array<binary>, root int")
    kept = simhash_dedup.drop_near_duplicates(docs).collect()
    assert [(r.doc_id, r.kept_doc) for r in kept] == [(1, {"k": 1})]


def test_similar_documents_match_brute_force(spark, odd_docs, no_docs):
    """The pipeline's stage: copies with words replaced, at shingle similarities on both sides of 0.8."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(30):
        base = [f"k{k}w{i}" for i in range(int(rng.integers(3, 400)))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.015, 0.02, 0.03):
            texts.append(" ".join(w if rng.random() > share else "other" + w for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(groups(len(texts), links)) and len(got) < len(texts)
    kept = corpus_pipeline.drop_near_duplicates(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").count() == 0


def test_similar_documents_pass_their_simhash_distance(spark):
    """The stage's fingerprints count each shingle once, their distance and pivot tables decide, and 0.8 lies within them."""
    assert simhash_dedup.set_fingerprint(simhash_dedup.shingles("", 5)) == 0
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:290], "x"]), " ".join(["far", *base[::-1]])] + [" ".join(["again"] * n + base[:60]) for n in (30, 3000)]
    sets = [simhash_dedup.shingles(t, 5) for t in texts]
    prints = [simhash_dedup.set_fingerprint(s) for s in sets]
    hand = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    assert prints == hand and prints[3] == prints[4]
    apart = bin(prints[0] ^ prints[1]).count("1")
    assert 0 < apart <= simhash_dedup.SET_DISTANCE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lambda **more: {r.doc_id for r in simhash_dedup.drop_similar(docs, **more).collect()}
    assert kept() == {0, 2, 3} and kept(distance=apart - 1) == {0, 1, 2, 3}


def test_short_and_unspaced_lines_are_deduplicated(spark, tmp_path):
    """Exact copies of any length go; a long line without spaces is compared with similar ones."""
    chinese = "我们使用饼干来改善您的浏览体验并分析网站流量请接受所有饼干以继续"
    rows = [(1, f"Accept all cookies now\nok\n\n---\n{chinese}"), (2, f"accept all cookies now!\nOK\n\n---\nown words\n{chinese}"), (3, "accept all cookies\nok then")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.text, r.n_removed) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("\n---\nown words", 3), 3: (rows[2][1], 0)}
    t = line_dedup.line_table([chinese, "ok then"])
    assert t.chars.tolist() == [len(chinese), 7] and t.fuzzy.tolist() == [True, False]
    other = chinese.replace("饼干", "点心")
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, chinese), (2, other)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: chinese, 2: ""}


def test_clashing_names_and_types(spark):
    rows = [(1, "same words stand in here twice", {"a": 1}, "x", 1), (2, "same words stand in here twice", {"b": 2}, "y", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_lines map<string,int>, gone_doc string, __removed int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "gone_lines", "gone_doc", "__lines", "__removed"]
    assert {r.doc_id: (r.text, r.gone_lines, r["__removed"]) for r in out.collect()} == {1: (rows[0][1], {"a": 1}, 0), 2: ("", {"b": 2}, 1), 3: (None, None, 0)}
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] in ([1, 3], [3, 1])


def test_many_distances_equal_single_ones():
    """Block edges, empty texts, several scripts, few and many letters: the recurrence over many pairs is the one over a pair."""
    rng = np.random.default_rng(17)
    scripts = ["abc ", "abcdefghijklmnopqrstuvw xyz", "".join(chr(0x4E00 + i) for i in range(900)), "a\U0001f600\u00e9 "]
    pairs = []
    for k in range(600):
        a = "".join(rng.choice(list(scripts[k % 4]), int(rng.choice([0, 1, 5, 63, 64, 65, 128, 200])) + int(rng.integers(0, 3))))
        b = "".join(c for c in a if rng.random() > 0.1) if k % 3 else "".join(rng.choice(list(scripts[k % 4]), int(rng.integers(0, 220))))
        pairs.append((a, b))
    pairs.append(("x" * 5000 + "y", "x" * 5001))
    want = [round((1 - line_dedup.edit_similarity(a, b)) * max(1, len(a), len(b))) for a, b in pairs]
    assert line_dedup.edit_distances(pairs).tolist() == want
    line_dedup.TABLE_WORDS, kept = 64, line_dedup.TABLE_WORDS
    try:
        assert line_dedup.edit_distances(pairs[:40]).tolist() == want[:40]
    finally:
        line_dedup.TABLE_WORDS = kept
    for (lo, hi), (a, b), d in zip(line_dedup.many_bounds(pairs, 0.8), pairs, want, strict=True):
        assert lo <= d <= hi and (1 - hi / max(1, len(a), len(b)) >= 0.8) == (1 - d / max(1, len(a), len(b)) >= 0.8)


def test_small_graphs_end_in_one_pass(spark, monkeypatch):
    """Chains, cycles and stars: the smallest node of each group, with few jobs where the edges fit one share and by rounds where not."""
    rng = np.random.default_rng(23)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))] + [(7, 7), (5000, 4000)]
    number = {n: i for i, n in enumerate(sorted({n for e in edges for n in e}))}
    of = groups(len(number), [(number[a], number[b]) for a, b in edges])
    names = sorted(number)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    want = {n: names[of[number[n]]] for n in linked}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    tracker, tag = spark.sparkContext.statusTracker(), "connected"
    spark.sparkContext.setJobGroup(tag, tag)
    rows = common.connected(df).collect()
    jobs = len(tracker.getJobIdsForGroup(tag))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want) and jobs <= 6
    monkeypatch.setattr(common, "EDGES_A_TASK", 40)
    assert {r.node: r.root for r in common.connected(df).collect()} == want


def test_line_classes_are_grouped_without_sorting(spark, sf, monkeypatch):
    """Classes of equal lines need no sort of all lines: what is written of them is planned as a grouping by hash."""
    plans, kept = [], line_dedup.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "written", lambda df, *more: (plans.append(plan(df)), kept(df, *more))[1])
    line_dedup.repeated_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    classes = plans[1]
    assert "HashAggregate" in classes and "SortAggregate" not in classes


def test_common_ends_and_bands_leave_distances_as_they_are(monkeypatch):
    """Texts lose what they share at both ends first; long near ones are looked at in a band, and what lies outside it in whole."""
    rng = np.random.default_rng(29)
    for k in range(300):
        a = "".join(rng.choice(list("abcde \u00e9"), int(rng.integers(1, 90))))
        share = (0.02, 0.1, 0.4)[k % 3]
        b = "".join(("" if rng.random() < 0.4 else str(rng.choice(list("abcx"))) + c) if rng.random() < share else c for c in a)
        want = levenshtein(a, b)
        x, y = line_dedup.without_ends(a, b)
        assert len(x) <= len(y) and levenshtein(x, y) == want and not (x and (x[0] == y[0] or x[-1] == y[-1]))
        for most in (1, 3, 9, 30):
            if x and most < len(y):
                assert line_dedup.band_distance(x, y, most) == (want if want <= most else None)
        monkeypatch.setattr(line_dedup, "LONG", 64)
        assert round((1 - line_dedup.edit_similarity(a, b)) * max(1, len(a), len(b))) == want
        monkeypatch.undo()
    base = "start " + "".join(rng.choice(list("abcdefgh "), 6000)) + " end"
    assert line_dedup.edit_distances([(base, base[:3000] + "!" + base[3001:]), (base, base + "x"), (base, base)]).tolist() == [1, 1, 0]


def test_distinct_words_are_hashed_once():
    """Each word's hash is the one it has alone, however often it stands there; words and code points are counted by line."""
    lines = ["a bb a \u00e9t\u00e9", "", "bb  bb zz", " "]
    count, code, h, size, points = line_dedup.hashed_words("\n".join(lines).encode())
    words = [w for line in lines for w in line.split()]
    assert count.tolist() == [4, 0, 3, 0] and len(h) == len(set(words)) == 4
    alone = {w: line_dedup.hashed_words(w.encode())[2][0] for w in set(words)}
    assert h[code].tolist() == [alone[w] for w in words] and size[code].tolist() == [len(w.encode()) for w in words] and points[code].tolist() == [len(w) for w in words]
