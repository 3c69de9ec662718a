"""op11 to op13 against brute force, on odd rows, and held out."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelog.llm import collocations, conversation_repair, language_id, queries

# ---- phrases


def brute_phrases(rows, at_least, top=2000):
    """Per language: {phrase: (a, l, r, score)} of what stays, in rank order."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= at_least}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= 80 * cand[lang, w[i : i + m]]:
                    gone.add((lang, w[i : i + m]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r): (p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def got_phrases(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string, phrase string, m int, mark long, rank int")


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_phrases_equal_brute_force_whatever_the_sample(spark, share):
    """A whole, a small and (almost surely) an empty sample: passes differ, counts do not."""
    rnd = random.Random(5)
    words = ["a", "b", "B", "Zoë", "été", "x-y", "|"]
    texts = [("en" if rnd.random() < 0.7 else None, "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r"]) for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    texts += [("en", "big apple pie now")] * 40 + [("en", "big apple")] * 5 + [("de", None), ("de", ""), (None, " . , ")]
    df = frame(spark, [(lang, t, "x", 1, 2, 3) for lang, t in texts])
    assert got_phrases(collocations.collocations(df, at_least=20, share=share)) == brute_phrases(texts, 20)
    few = got_phrases(collocations.collocations(df, at_least=20, top=3, share=share))
    assert few == brute_phrases(texts, 20, 3)


def test_filter_that_knows_everything_changes_no_count(spark, monkeypatch):
    """The smallest filter is full at once: every phrase is counted, the result stays."""
    monkeypatch.setattr(collocations.known, "__defaults__", (1,))
    rnd = random.Random(6)
    texts = [("en", " ".join(rnd.choice("abcdefgh") for _ in range(50))) for _ in range(60)]
    assert got_phrases(collocations.collocations(frame(spark, [(*t, "x", 1, 2, 3) for t in texts]), at_least=12)) == brute_phrases(texts, 12)


def test_false_hit_of_the_filter_loses_no_phrase(spark):
    """The filter knows "a b" by chance but not "a", so the first pass never meets "a b c": the second has to count it."""
    everything, nothing = collocations.Known(np.full(1, np.iinfo(np.uint64).max)), np.empty(0, np.uint64)
    names = {}
    for level in collocations.levels("en", b"a b c", everything, collocations.Known(nothing)):
        names |= dict(zip(level.texts(np.arange(len(level.marks))), level.marks.view(np.int64).tolist(), strict=True))
    seed = collocations.known(spark.createDataFrame([(names[p],) for p in ("b", "c", "a b", "b c")], "mark long"), nothing)
    _, found = collocations.closed(spark.createDataFrame([("en", "a b c")] * 40, "lang string, text string"), seed, 30)
    assert sorted((r.mark, r.a) for r in found.collect()) == sorted((m, 40) for m in names.values())


def test_phrases_of_long_texts_and_empty_tables(spark, monkeypatch, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    monkeypatch.setattr(collocations, "CHUNK", 64)
    texts = [("en", "one two three four. " * 500), ("en", "w" * 500 + " x y"), ("fr", "un deux " * 300)]
    assert got_phrases(collocations.collocations(frame(spark, [(*t, "x", 1, 2, 3) for t in texts]))) == brute_phrases(texts, 30)


def test_wide_products(spark):
    rows = [("en", "a b", 2, 5_000_000_000_000), ("en", "a", 1, 6_000_000_000_000), ("en", "b", 1, 7_000_000_000_000)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, m int, a long")).first()
    assert got.score == 2_000_000 * 5_000_000_000_000 // 13_000_000_000_000


def test_first_rows_in_parts_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROWS_A_SALT", 7)
    rows = spark.range(200).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("phrase"), (F.col("id") % 9).alias("score"), (F.col("id") % 4).alias("a"))
    got = collocations.first_rows(rows, 50, [F.desc("score"), F.desc("a"), F.asc("phrase")]).collect()
    want = sorted(((-(i % 9), -(i % 4), str(i)) for i in range(200)))[:50]
    assert [(r["rank"], r.phrase) for r in sorted(got, key=lambda r: r["rank"])] == [(i, p) for i, (_, _, p) in enumerate(want, 1)]


# ---- conversations


def cheapest(rows):
    """Least (cost, audit) by Dijkstra over nodes, without any bound."""
    heap, done = [(0, "", 0, "^")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in "^a":
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        want = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, want))
        if i < len(rows):
            initial, flaw = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if flaw not in (1, 2):
                more = cost + (flaw == 3)
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, want))
                if initial == want or (initial == "s" and last == "^"):
                    heapq.heappush(heap, (more, audit + "K", i + 1, initial))


def test_branch_and_bound_is_optimal():
    rnd = random.Random(1)
    for _ in range(4000):
        rows = [(rnd.choice("uuaas") if rnd.random() < 0.95 else rnd.choice(["t", ""]), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 11))]
        assert conversation_repair.repair(rows) == cheapest(rows), rows
    rows = [(rnd.choice("uaaus"), rnd.choice([0, 0, 0, 1, 3])) for _ in range(700)]
    assert conversation_repair.repair(rows) == cheapest(rows)


def test_lower_bounds_never_exceed_the_cost():
    rnd = random.Random(2)
    for _ in range(2000):
        rows = [(rnd.choice("uas"), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 9))]
        least, run, first = conversation_repair.bounds(rows)
        start = least[0] + (2 if run[0] % 2 == 0 and conversation_repair.broken("^", first[0]) else 0)
        assert start <= cheapest(rows)[0], rows


def test_long_conversation_takes_linear_work():
    rows = [("ua"[i % 2], [0, 0, 0, 0, 0, 1, 0, 3, 0, 2][i % 10]) for i in range(60_000)]
    cost, audit = conversation_repair.repair(rows)
    assert cost > 0 and len(audit) >= len(rows)


def plain_report(rows):
    """The whole contract for one conversation, plainly: rows are (turn, role, text), undamaged."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    hurt = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"7:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            hurt += [row] * (2 if kind == 3 else 1)
    hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flaws = set(), []
    for _, role, text in hurt:
        body = text.strip(" \t\n\v\f\r")
        flaws.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in hurt if t is not None]
    initials = [r[:1] for _, r, _ in hurt]
    cost, audit = cheapest(list(zip(initials, flaws, strict=True)))
    out, last, i = [], "^", 0
    for letter in audit:
        want = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        if letter == "I":
            out.append(f"{name}:")
        elif letter in "KR":
            out.append(f"{hurt[i][1] if letter == 'K' else name}:{hurt[i][2]}")
        if letter in "IR":
            last = want
        elif letter == "K":
            last = initials[i]
        i += letter != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, flaws.count(1), flaws.count(2), flaws.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


CONV = "conv_id long, turn long, role string, text string, kind string, gone string, audit int"


@pytest.mark.parametrize("seed", range(4))
def test_odd_conversations(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice([None, 0, 1, 5, 6, 7, 8, 9, 12, 40]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "uncle"]), rnd.choice(["Hi.", "so", "", " \n", None, "Ja!\t", "x" * 50_000 + "?"]))
        for _ in range(rnd.randint(0, 25))
    ]
    rows += rows[:3]
    df = spark.createDataFrame([(7, *r, "x", "y", 1) for r in rows], CONV)
    got = conversation_repair.repair_conversations(conversation_repair.damaged(df)).collect()
    assert [tuple(r)[1:] for r in got] == ([plain_report(rows)] if rows else [])


def test_null_conversations_and_repaired_rows(spark):
    rows = [(None, 1, "user", "a b c"), (None, 2, "assistant", "Yes."), (3, 1, "assistant", "Only this."), (3, 1, "assistant", "Only this.")]
    damaged = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    reports = conversation_repair.audits(damaged)
    assert {r.conv_id: (r.cost, r.audit) for r in reports.collect()} == {None: (1, "KK"), 3: (5, "IKD")}
    got = [(r.conv_id, r.seq, r.line) for r in conversation_repair.repaired_rows(damaged, reports).collect()]
    assert sorted(got, key=str) == [(3, 0, "user:"), (3, 1, "assistant:Only this."), (None, 0, "user:a b c"), (None, 1, "assistant:Yes.")]


# ---- languages


def brute_language(train, texts):
    """Word-first backoff by its definition, in dictionaries."""
    import math

    words, grams = {}, {}
    split = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t or "")]
    for lang, t in train:
        for w in split(t):
            words.setdefault(lang, Counter())[w] += 1
            for m in range(1, language_id.TOP + 1):
                for i in range(len(w) + 3 - m):
                    g = f" {w} "[i : i + m]
                    if g != " ":
                        grams.setdefault((lang, m), Counter())[g] += 1
    langs = sorted(words)
    total = {k: sum(c.values()) for k, c in [*words.items(), *grams.items()]}

    def gain(counts, key, most, x):
        least = len(langs) / most
        n = counts.get(key, Counter())[x]
        return language_id.PENALTY - math.log10(least) + math.log10(n / total[key]) if n and n / total[key] >= least else 0.0

    def score(w):
        own = [gain(words, k, language_id.WORD_ENTRIES, w) for k in langs]
        if any(own):
            return own
        for m in range(language_id.TOP, 0, -1):
            all_ = [[gain(grams, (k, m), language_id.GRAM_ENTRIES, f" {w} "[i : i + m]) for k in langs] for i in range(len(w) + 3 - m)]
            hits = [g for g in all_ if any(g)]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        own = split(t)
        sums = [sum(x) for x in zip(*map(score, own), strict=True)] if own else []
        best = max(range(len(sums)), key=lambda i: (sums[i], -i)) if own else None
        out.append((langs[best], 1 / sum(10 ** max(-300, x - sums[best]) for x in sums)) if own else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(language_id, "WORD_ENTRIES", 2_000)  # so that many words are unknown
    monkeypatch.setattr(language_id, "GRAM_ENTRIES", 3_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    train = [(r.lang, r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    texts = [" ".join(r.text.split()[:20]) for r in rows] + ["qwxz kjh", "ÜBER straßen", "12 34 !!", "", None, "日本語", "été", "e"]
    want = brute_language(train, texts)
    model = language_id.learn(spark.createDataFrame(train, "lang string, text string"))
    odd = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(5)
    got = sorted(language_id.identify(odd, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert all(abs(r.score - w[1]) < 1e-9 for r, w in zip(got, want, strict=True))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op13_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99


def test_language_does_not_depend_on_the_deal_or_on_pieces(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs.select("lang", "text"))
    monkeypatch.setattr(language_id, "PIECE", 300)
    one = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs.coalesce(1), model).collect()}
    monkeypatch.setattr(language_id, "WORDS", 500)
    assert one == {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs.repartition(7), model).collect()}


def test_language_odd_rows(spark, odd_docs, no_docs):
    got = language_id.report(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in language_id.report(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language_id.report(no_docs).collect() == []


# ---- twins in SQL


@pytest.mark.parametrize("key, table", [("op11_collocations", "documents"), ("op12_conversation_repair", "conversations")])
def test_same_as_sql(spark, key, table):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{d}/{table}.parquet'")
    rel = con.execute(queries.oracle_sql()[key])
    names = [c[0] for c in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    got = queries.queries()[key](spark, d)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == want


def test_counting_frees_each_chunk_without_the_cycle_collector():
    import gc
    import tracemalloc

    import numpy as np

    from ravelog.llm import collocations as C

    everything, nothing = C.Known(np.full(64, ~np.uint64(0), np.uint64)), C.Known(np.empty(0, np.uint64))
    held = []
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(6):
            for level in C.levels("en", b" ".join(b"w%d" % (i * 7919 % 5003) for i in range(20_000)), everything, nothing):
                last = level.texts(np.arange(3))
            del level
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
        gc.enable()
    assert len(last) == 3 and all(len(p.split()) == 4 for p in last)
    assert held[-1] < held[0] + (1 << 20)
