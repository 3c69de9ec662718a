import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from ravelog.llm import html_extract, licenses, pii, toxicity

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out, counts = [], []
    for kind, pattern in KINDS:
        n = 0
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, out


TRICKY = [
    "a@b.c_d@e.f g@h", "x..y@z.com. @a.b a@.b", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 01.002.0255.9", "4111 1111-1111 1111 and 4111  1111 1111 1111", "card 4111111111111111- 5500000000000004 -4111111111111111",
    "+1 (212) 555-0100. +49 (0) 30 123456 +1-2 ++44 20 7946 0958", "😀 mail é@x.yy über 10.0.0.255 5-5-5-5", "- 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 -", "", None, "1" * 3000 + " " + "9 " * 3000, "password=abcdef123456 token: 'ghijkl987654'",
]


def test_base_spans_match_regular_expressions(spark, sf):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = TRICKY + real
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.report(rows).collect():
        counts, spans = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) or not spans


def test_reliabilities_and_edges(spark, odd_docs, no_docs):
    model = pii.fit([("email", "m", "11111", 900), ("email", "m", "10111", 50), ("secret", "l", "-1111", 200), ("ip", "s", "01000", 300), ("secret", "s", "-0000", 100)])
    assert model.right[0][0] > 0.8 > model.right[0][1]
    assert model.accept["secret l -1111"] > 0.5 > model.accept["secret s -0000"]
    assert pii.report(odd_docs).count() == odd_docs.count()
    assert pii.report(no_docs).count() == 0


def brute_em(counted, rounds=50):
    """The posterior of each vote pattern, with arrays over all candidates instead of counts of patterns."""
    votes = np.repeat([[{"1": 1.0, "0": 0.0, "-": np.nan}[x] for x in v] for _, _, v, _ in counted], [n for *_, n in counted], axis=0)
    said = ~np.isnan(votes)
    yes = np.where(said, votes, 0)
    q = (yes.sum(1) + 0.5) / (said.sum(1) + 1)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 0.01, 0.99)
        rate = np.array([[(w[:, None] * yes).sum(0) + 2 * (0.8 if k else 0.2), (w[:, None] * said).sum(0) + 2] for k, w in ((1, q), (0, 1 - q))])
        rate = rate[:, 0] / rate[:, 1]
        right, wrong = rate.max(0), rate.min(0)
        odds = np.log(prior / (1 - prior)) + np.where(said, np.where(yes > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong))), 0).sum(1)
        q = 1 / (1 + np.exp(-odds))
    return prior, list(zip(right, wrong))


def test_em_matches_brute_force():
    rng = np.random.default_rng(8)
    counted = []
    for kind in ("email", "ssn", "secret"):
        for _ in range(12):
            counted.append((kind, "sml"[rng.integers(3)], ("-" if kind != "email" else "01"[rng.integers(2)]) + "".join(rng.choice(["0", "1"], 4)), int(rng.integers(1, 60))))
    model = pii.fit(counted)
    prior, right = brute_em(counted)
    assert abs(model.prior - prior) < 1e-9 and np.allclose(model.right, right)


def test_em_overrules_the_majority():
    """Numbers like 123-45-6789: most labelers pass any of them, and only the words nearby tell; EM learns that, a vote does not."""
    counted = [("ssn", "s", "-1111", 300), ("ssn", "s", "-1010", 500), ("ssn", "s", "-1011", 30), ("email", "m", "11111", 400), ("email", "m", "01011", 300), ("ip", "s", "00010", 800)]
    learned = pii.fit(counted)
    majority = {f"{k} {s} {v}": v.count("1") >= (4 if v[0] == "-" else 5) / 2 for k, s, v, _ in counted}
    changed = [k for k, yes in majority.items() if yes != (learned.accept[k] >= 0.5)]
    assert changed


def test_words_nearby_decide_contested_spans(spark):
    rows = [(i, f"customer {i}, social security no. {100 + i}-{10 + i % 80}-{1000 + i}, filed") for i in range(300)]
    rows += [(i, f"part{900 + i % 99}-00-{1000 + i}z in stock, x000-12-{2000 + i}q too") for i in range(300, 600)]
    rows += [(600 + i, f"mail me: user{i}@shop{i}.com please") for i in range(200)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("ssn:" in got[i].spans for i in range(300)) and not any("ssn:" in got[i].spans for i in range(300, 600))
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())


def test_very_many_matches(spark):
    """100,000 addresses in one text, and as many licence notices as fill 1 MB, within seconds."""
    import time

    n = 100_000
    text = " ".join(f"a{i}@b.co" for i in range(n))
    start = time.time()
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == n and r.base_sha256 == hashlib.sha256(",".join(base_spans(text)[1]).encode()).hexdigest()
    assert time.time() - start < 40
    every = " ".join(t for t, _ in licenses.TEMPLATES.values()) + " "
    text = every * (1_000_000 // len(every))
    start = time.time()
    r = licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(licenses.TEMPLATES) <= set(r.labels.split(",")) and (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text)
    assert time.time() - start < 40


def brute_notice(text, label, idf, rare=4, agree=2):
    """Does the notice stand in the text, by its definition and with plain loops?"""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    notice, needed = licenses.TEMPLATES[label]
    own = notice.split()
    once = sorted((w for w in own if own.count(w) == 1), key=lambda w: (-idf[w], w))[:rare]
    votes = Counter(i - own.index(w) for i, w in enumerate(words) if w in once)
    places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in needed}
    return any(n >= min(agree, len(once)) and all(any(s - 1 <= at <= s + len(own) for at in places[p]) for p in needed) for s, n in votes.items())


def test_notices_and_near_misses_match_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for label, (notice, _) in licenses.TEMPLATES.items():
        own = notice.split()
        texts += [notice, " ".join(own[: len(own) // 2]), " ".join(rng.sample(own, len(own))), " ".join(w for w in own if rng.random() > 0.2), " ".join(x for w in own for x in (w, "and")), f"{notice} {notice}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licenses.rarity(licenses.word_places(docs))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.report(docs).collect()}
    for i, t in enumerate(texts):
        assert {x for x in got[i] if x in licenses.TEMPLATES} == {x for x in licenses.TEMPLATES if brute_notice(t, x, idf)}, t


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_places(spark, sf):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = ["MIT-License mit\nlicense; the MIT licence", "Released under the CC BY-NC 4.0", "GNU General  Public/License v. 3 GNU general public", "", None, " ".join(licenses.TEMPLATES["bsd"][0].split()).upper(), *real]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.report(rows).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert found[5].labels == "bsd" and found[5].score == 1.0


def test_every_template_is_found(spark):
    rows = spark.createDataFrame([(i, f"some words before {text} and after") for i, (text, _) in enumerate(licenses.TEMPLATES.values())], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.report(rows).collect()}
    assert all(label in got[i] for i, label in enumerate(licenses.TEMPLATES))


def test_license_edges(odd_docs, no_docs):
    assert licenses.report(odd_docs).count() == odd_docs.count()
    assert licenses.report(no_docs).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header>Site</header><nav><a href="/a">Menu</a></nav>
<div class="ad">Buy now</div><article><header><h1>Head&amp;line</h1></header><p>First <b>bold</b>  text&nbsp;here,<br>with more words in it.</p><aside>Aside words</aside><div class="comments"><p>A comment</p></div>
<form><p>Subscribe</p></form><p>Second &lt;paragraph&gt; also has words.</p></article><footer>&copy; foot</footer></body></html>"""
BODY = "Head&line\n\nFirst bold text here, with more words in it.\n\nSecond <paragraph> also has words."


def test_main_text():
    assert html_extract.main_text(PAGE, {}) == BODY
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert html_extract.main_text(plain, {}) == BODY
    assert html_extract.main_text(None, {}) == html_extract.main_text("", {}) == html_extract.main_text("<p></p>", {}) == ""
    assert html_extract.main_text("just words", {}) == "just words"
    assert html_extract.main_text("<article><p>cut of", {}) == "cut of"
    assert html_extract.main_text("<article><p>a < b and c</p><p>x &am", {}) == "a < b and c\n\nx &am"


def test_labels_in_comments_and_teasers():
    body = " ".join(f"word{i}" for i in range(120))
    page = f"""<body><nav><a>Menu</a></nav><div class="story"><h1>Title of it</h1><p>{body}</p><ul><li>first point here</li><li>second point here</li></ul></div>
    <div class="comments"><article class="comment-body"><p>a reader says things</p></article><article class="comment-body"><p>another one agrees</p></article></div></body>"""
    want = f"Title of it\n\n{body}\n\nfirst point here\n\nsecond point here"
    assert html_extract.main_text(page, {}) == want
    teaser = page.replace("<nav>", '<article class="card"><p>short teaser text</p></article><nav>')
    assert html_extract.main_text(teaser, {}).endswith(want)
    listed = page.replace('<div class="story">', "<article>").replace("second point here</li></ul></div>", "second point here</li></ul></article>")
    assert html_extract.main_text(listed, {}) == want


def test_weights_decide(spark):
    """Pages without their labels and without the fixed class words give what the labelled ones do, by learned weights alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_extract.fit_weights(pages)
    assert weights[".ad"] <= -1 and weights["nav"] <= -1 and weights[html_extract.INSIDE] > 1 and weights["#word"] > 0 and weights["<p"] < 0
    rows = [r.html for r in pages.collect() if r.html]
    same = other = 0
    for page in rows:
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)
        want = html_extract.main_text(page, weights)
        same += html_extract.main_text(bare, weights, listed=False) == want
        other += html_extract.main_text(bare, {}, listed=False) != want
    print(f"{same} of {len(rows)} pages as labelled; {other} differ without the weights")
    assert same >= 0.9 * len(rows) and other >= 0.5 * len(rows)


def test_best_region_is_the_maximum():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 9))]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2))])


def test_extract_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html[r.page_id] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        import html as h

        want = "\n\n".join(t for b in blocks if (t := " ".join(h.unescape(re.sub(r"<[^>]*>?", lambda m: " " if m[0].startswith("<br") else "", b)).split())))
        assert r.text == want and r.n_chars == len(want)
    odd = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p>hello there world</p>", "t")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_extract.extract(odd).collect()] == ["", "", "hello there world"]
    assert html_extract.extract(odd.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    marked = re.compile(r"\b(?:idiot|trash|worthless|clown|loser|scum|disgusting|stupid|moron|pathetic)\b", re.I)
    text = {r.doc_id: r.text for r in docs.collect()}
    plain = [r for r in held if r.toxic == 0]
    insulting = [r for r in held if r.toxic == 1 and marked.search(text[r.doc_id])]
    assert sum(r.predicted for r in plain) <= 0.02 * len(plain)
    assert sum(r.predicted for r in insulting) >= 0.95 * len(insulting)


def brute_model(rows, corpus):
    """Kneser-Ney by definition, with dictionaries: (spelling ratio of a word, sequence ratio of a pair, summaries of a text)."""
    split = toxicity.words_of
    every = Counter(w for t in corpus for w in split(t))
    total = sum(every.values())
    spelled = [Counter(w for t, y in rows if y == c for w in split(t)) for c in (0, 1)]

    def orders(words, top, lowest):
        """order -> {gram bytes: count}; top and word-initial ones by occurrence, others by distinct left bytes."""
        out = {n: Counter() for n in range(lowest, top + 1)}
        for w, n in words.items():
            s = b"\x02" + w + b"\x03"
            for i in range(1, len(s)):
                if i >= top - 1:
                    out[top][s[i - top + 1 : i + 1]] += n
                for o in range(lowest, top):
                    if i == o - 1:
                        out[o][s[: i + 1]] += n
        for o in range(top - 1, lowest - 1, -1):
            for g in {g for g, n in out[o + 1].items() if n > 0}:
                out[o][g[1:]] += 1
        return out

    shared = orders(every, 2, 1)
    own = [orders(spelled[c], 6, 3) for c in (0, 1)]

    def discount(counts):
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        return min(0.95, max(0.1, once / max(1, once + 2 * twice)))

    def smoothed(counts, prefix, gram, lower):
        of = [v for g, v in counts.items() if g[: len(prefix)] == prefix and v > 0] if prefix is not None else [v for v in counts.values() if v > 0]
        if not of:
            return lower
        d = discount(counts)
        return (max(counts.get(gram, 0) - d, 0) + d * len(of) * lower) / sum(of)

    def spelling(w):
        s, out = b"\x02" + w + b"\x03", 0.0
        for i in range(1, len(s)):
            p = []
            for c in (0, 1):
                x = 1 / 256
                for o in range(1, 7):
                    if i >= o - 1:
                        g = s[i - o + 1 : i + 1]
                        x = smoothed((shared if o <= 2 else own[c])[o], g[:-1], g, x)
                p.append(x)
            out += math.log(p[1] / p[0])
        return out

    pairs = [Counter((a, b) for t, y in rows if y == c for a, b in itertools.pairwise(split(t))) for c in (0, 1)]

    def after(c, b):
        follows = Counter(y for _, y in pairs[c])
        return smoothed(follows, None, b, every[b] / total)

    def sequence(a, b):
        if pairs[0][a, b] + pairs[1][a, b] < 2:
            return 0.0
        p = [smoothed(pairs[c], (a,), (a, b), after(c, b)) for c in (0, 1)]
        return math.log(p[1] / p[0])

    return spelling, sequence


def test_models_match_kneser_ney_by_definition(spark):
    """Every probability of a small corpus: spelling of seen and unseen words, seen and unseen pairs, weights from fold 1."""
    rng = random.Random(6)
    vocabulary = ["the", "then", "there", "a", "mean", "meaning", "nasty", "é", "nastier", "so", "you", "are", "xylophone"]
    texts = [" ".join(rng.choice(vocabulary[: 6 + 7 * (i % 2)]) for _ in range(rng.randint(2, 30))) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120) if i % 3], "doc_id long, toxic int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(t, i % 2) for i, t in enumerate(texts) if i % 3 and fold(i) not in (0, 1)]
    spelling, sequence = brute_model(rows, texts)
    model = toxicity.fit(docs, labels)
    words = [w.encode() for w in [*vocabulary, "thence", "zz", "q", "meanest"]]
    got = model.ratios(words)
    assert all(abs(g - spelling(w)) < 1e-4 * max(1, abs(g)) for g, w in zip(got, words))
    import xxhash

    code = lambda w: np.array([xxhash.xxh64_intdigest(w, 42)], np.uint64)
    for a, b in itertools.product(words[:14], words[:14]):
        g = toxicity.lookup(model.pairs, model.pair_ratios, toxicity.pair_keys(code(a), code(b)))[0]
        assert abs(g - sequence(a, b)) < 1e-4 * max(1, abs(g)), (a, b)
    for r in toxicity.features(docs.limit(20), model).collect():
        w = toxicity.words_of(r.text)
        s = [spelling(x) for x in w]
        want = [sum(s) / len(w), *(sum(max(0, x - t) for x in s) / len(w) for t in toxicity.TAILS), sum(sequence(a, b) for a, b in itertools.pairwise(w)) / len(w)]
        assert np.allclose(r.ratio, want, atol=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one = {r.doc_id: (r.score, r.predicted) for r in toxicity.scored(docs.coalesce(1), labels).collect()}
    other = {r.doc_id: (r.score, r.predicted) for r in toxicity.scored(docs.repartition(16), labels.repartition(3)).collect()}
    assert one.keys() == other.keys() and all(abs(one[k][0] - other[k][0]) < 1e-9 and one[k][1] == other[k][1] for k in one)


def test_word_sequences_tell_classes(spark):
    """Both classes hold the same words; only their order differs."""
    rng = random.Random(2)
    def text(y):
        parts = ["get lost now", "we found you"] if y else ["you get now", "we lost found"]
        return " ".join(rng.choice(parts) for _ in range(8))
    docs = [(i, text(i % 2)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    rows = toxicity.scored(frame, labels).where("held_out").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in rows) >= 0.95 * len(rows)


def test_toxicity_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score < 0.5 for r in toxicity.scored(odd_docs, none).collect()] == [True] * odd_docs.count()
    some = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "bad rude words" if i % 2 else "kind calm words", 0.1) for i in range(60)], "doc_id long, text string, toxic double")
    kept = toxicity.drop_toxic(docs, some)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0}
    assert toxicity.drop_toxic(odd_docs, some).columns == odd_docs.columns
    assert toxicity.scored(no_docs, some).count() == 0


def test_model_is_sent_to_the_tasks_once(spark):
    """Calibration and scoring share one copy of the tables on the driver; scores take the weights fitted in between."""
    rows = [(i, " ".join(f"w{(i * k) % 17}{'bad' if i % 2 else 'fine'}" for k in range(1, 12))) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    sent = model.tables(spark.sparkContext)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert model.tables(spark.sparkContext) is sent and sent.value.sent is None
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _ in rows)
