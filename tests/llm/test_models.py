"""Language model, classifiers and extraction: exact parts against plain versions, learned parts on data kept aside."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import html_extract, lm, quality, toxicity
from pairloom.llm.html_extract import Chain, blocks, extract_text, features, labelled, main_text, trained_chain
from pairloom.llm.lm import LogBilinear, Trainer, _log_sum, band_of, band_starts, score_texts, shape, train, vocabulary, word_counts


def sentences(r, n):
    return " ".join(r.choice(("the", "a", "of")) + " " + r.choice(("cat", "dog", "sun")) + str(r.randrange(3)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(0)
    rows = [(k, sentences(r, r.randint(1, 60)) + f" only{k}", 5.0) for k in range(150)] + [(150, None, 1.0), (151, "", 1.0), (152, "Thé\x1fx unknown-word", 1.0), (None, "the cat0", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)


def test_lm(corpus):
    got = {x.doc_id: x for x in score_texts(corpus, head=20, rare=4, lookup=30, rounds=2, least=40_000).collect()}
    texts = {x.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (x.text or "").lower()) + [None] for x in corpus.collect()}
    held = {k: zlib.crc32(str(k if k is not None else "").encode()) % 10 == 0 for k in texts}
    c = Counter(w for k, ws in texts.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in texts.items():
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    aside = [x for k, x in got.items() if held[k] and x.n_tokens > 5]
    assert sum(x.score for x in aside) > sum(x.base_score for x in aside)
    assert score_texts(corpus.limit(0), head=5, rare=2, lookup=5, rounds=1, least=2).count() == 0


def test_word_probabilities_add_up(spark, corpus, monkeypatch):
    """Scores of texts of one more word, for every word there is and one for each rare class that is not."""
    model = LogBilinear.start(np.arange(1.0, 15), seed=3)
    monkeypatch.setattr("pairloom.llm.lm.train", lambda *a, **k: LogBilinear(*(5 * x for x in (model.r, model.v)), model.b, 5 * model.u, model.g, model.a))
    counts = {x.word for x in word_counts(corpus, "text").collect()}
    rare = {}
    for k in range(100):
        rare.setdefault(zlib.crc32(f"zq{k}"[-3:].encode()) % 4, f"zq{k}")
    words = sorted(counts - {""}) + [rare[k] for k in range(4)]
    ids = [i for i in range(10_000, 40_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    asked = [(i, f"the cat0 {w}") for i, w in zip(ids, [*words, ""], strict=False)]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(asked, "doc_id long, text string"))
    got = {x.doc_id: x.score for x in score_texts(docs, head=10, rare=4, lookup=30).collect()}
    plain = counts_of(corpus)
    m = plain_model(plain, model)
    for i, t in asked:
        assert got[i] == pytest.approx(m(t.split(" ") if t[-1] != " " else t[:-1].split(" ")), abs=1e-3), t
    total = sum(10 ** m(["the", "cat0"], w) for w in [*[x for x in plain if x], None, *(("new", k) for k in range(4))])
    assert total == pytest.approx(1, abs=1e-4)


def counts_of(corpus):
    held = lambda k: zlib.crc32(str(k if k is not None else "").encode()) % 10 == 0
    texts = [x.text for x in corpus.select("doc_id", "text").collect() if not held(x.doc_id)]
    return Counter(w for t in texts for w in [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""])


def plain_model(c, start):
    """The model word by word, without numpy: the end, the 9 most frequent words, and 4 rare classes."""
    own = ["", *sorted((w for w in c if w), key=lambda w: (-c[w], w))[:9]]
    ending = lambda w: zlib.crc32(w.encode()[-3:]) % 4
    mass = [0.1] * 4
    for w in c:
        if w not in own:
            mass[ending(w)] += c[w] + 0.1
    r, v, u = 5 * start.r.astype(float), 5 * start.v.astype(float), 5 * start.u.astype(float)

    def place(w):
        return own.index(w) if w in own else 10 + (w[1] if isinstance(w, tuple) else ending(w))

    def log_softmax(x, k):
        return x[k] - math.log(sum(math.exp(y) for y in x))

    def one(h2, h1, w):
        q = r[place(h1)] @ start.a[0] + r[place(h2)] @ start.a[1]
        k = place(w)
        band = next(b for b in range(10) if (b + 1) * (b + 2) // 2 > k)
        lo, hi = band * (band + 1) // 2, min(14, (band + 1) * (band + 2) // 2)
        lp = log_softmax([q @ u[b] + start.g[b] for b in range(len(u))], band) + log_softmax([q @ v[j] + start.b[j] for j in range(lo, hi)], k - lo)
        if k >= 10:
            n = 0 if isinstance(w, tuple) else c[w]
            lp += math.log((n + 0.1) / mass[k - 10])
        return lp / math.log(10)

    def score(words, last=False):
        if last is not False:
            return one(words[-2], words[-1], "" if last is None else last)
        seq = ["", "", *words, ""]
        return sum(one(*seq[k : k + 3]) for k in range(len(words) + 1))

    return score


def test_lm_learns_contexts():
    mass = np.array([5.0, 3, 2, 1, 0.5, 0.5, 4])
    trainer = Trainer(LogBilinear.start(mass), mass, 0)
    h2, h1, now = np.array([0, 0, 2, 3, 1, 1]), np.array([1, 2, 0, 1, 1, 6]), np.array([2, 1, 3, 4, 6, 5])
    for _ in range(150):
        trainer.learn(*(np.tile(x, 40) for x in (h2, h1, now)))
    model = trainer.model()
    one = lambda a, b, c: math.exp(model.log_prob(np.array([a]), np.array([b]), np.array([c]))[0])
    for a, b, c in zip(h2, h1, now, strict=True):
        assert sum(one(a, b, k) for k in range(7)) == pytest.approx(1, abs=1e-5)
        assert one(a, b, c) > 0.5


def test_lm_training_sees_every_token(spark):
    texts = [f"a{k} b{k} c{k}" for k in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    vocab = vocabulary(word_counts(docs, "text"), head=1000, rare=4)
    start = LogBilinear.start(vocab.class_mass())
    got = train(docs, "text", vocab, least=1)
    moved = (got.r != start.r).any(axis=1) | (got.v != start.v).any(axis=1)
    assert vocab.head == 901 and moved[: vocab.head].all()


def test_lm_shapes_grow():
    assert shape(0) == (256, 16) and shape(10_000) == (400, 25) and shape(10**8) == (40_000, 2_500) and shape(10**12)[0] == 1 << 18
    for n in (1, 2, 3, 4, 500, 5151, 300_000):
        starts = band_starts(n)
        assert starts[0] == 0 and starts[-1] == n and (np.diff(starts) > 0).all()
        assert (band_of(np.arange(n)) == np.repeat(np.arange(len(starts) - 1), np.diff(starts))).all()


def test_lm_counts_the_end_apart(spark):
    counts = spark.createDataFrame([(w, 1) for w in ["", *"abcdef"]], "word string, n long")
    got = vocabulary(counts, head=2, rare=2, lookup=3)
    assert got.words[0] == b"" and got.counts[0] == 1 and (got.tokens, got.distinct) == (7, 7)
    assert got.rare_mass.sum() == pytest.approx(6 * 1.1 + 2 * 0.1)


def labelled_docs(spark, label, make, n=1500):
    r = random.Random(7)
    rows = [(k, *make(r, k)) for k in range(n)]
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows] + [(n, None, 1), (n + 1, "", 1), (None, "some words here", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], f"doc_id long, {label} int")
    return docs, labels


def accuracy(scored, labels, label):
    got = scored.where("held_out").join(labels, "doc_id").selectExpr(f"predicted = {label} AS ok").toPandas()
    assert len(got) > 100
    return got.ok.mean()


def test_quality(spark):
    def make(r, k):
        good = k % 4 > 0
        text = sentences(r, r.randint(5, 60))
        if not good:
            text = r.choice([text.upper(), " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 40)])
        return text, int(good)

    docs, labels = labelled_docs(spark, "quality", make)
    ranking = quality.learn(docs, labels)
    scored = quality.score_quality(docs, ranking)
    assert accuracy(scored, labels, "quality") > 0.97
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    kept = quality.keep_good(docs, ranking)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 1").count()
    assert quality.score_quality(docs, quality.learn(docs, labels.limit(0))).where("predicted = 0").count() == 0
    assert quality.score_quality(docs.limit(0), ranking).count() == 0


def plain_ratios(text):
    """The ratios of a text, one character of ASCII after another."""
    words, letters = text.split(), [bytes([c]) for c in text]
    n, k = len(text), len(words)
    times = [words.count(w) for w in dict.fromkeys(words)]
    upper = lambda w: any(65 <= c <= 90 for c in w) and not any(97 <= c <= 122 for c in w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences_ = text.split(b". ")
    marks = sum(c in quality.MARKS for c in letters)
    title = []
    for w in words:
        cased = [(c, j and (65 <= w[j - 1] <= 90 or 97 <= w[j - 1] <= 122)) for j, c in enumerate(w) if 65 <= c <= 90 or 97 <= c <= 122]
        title.append(bool(cased) and all((c >= 97) == bool(follows) for c, follows in cased))
    pairs = {(words[j], words[j + 1]) for j in range(k - 1)}
    return [
        math.log(1 + n), math.log(1 + k), n / k, len(times) / k, max(times) / k, sum(t**2 for t in times) / k**2, len(pairs) / max(1, k - 1),
        sum(words[j] == words[j + 1] for j in range(k - 1)) / k, sum(65 <= c <= 90 for c in text) / n, sum(48 <= c <= 57 for c in text) / n, marks / n, marks / k,
        sum(c > 127 for c in text) / n, sum(len(w) < 4 for w in words) / k, sum(len(w) > 11 for w in words) / k, max(len(w) for w in words) / n,
        sum(upper(w) for w in words) / k, sum(title) / k, sum(all(65 <= c <= 90 or 97 <= c <= 122 for c in w) for w in words) / k,
        len(set(lines)) / max(1, len(lines)), len(lines) / k, len(set(sentences_)) / len(sentences_), len(sentences_) / k,
        *(sum(c == m for c in letters) / k for m in quality.SINGLE),
    ]


def test_quality_against_a_plain_version():
    r = random.Random(12)
    parts = ["The", "cat", "CAT", "Dog's", "x1", "an", "internationally", "tab\tbed", "Été", "###", "end. ", "a,b", "\n", "\n\n", "Mc-Donald", "2024", "[1]", "U.S."]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 40))).encode() for _ in range(400)]
    texts = [t for t in texts if t.split()] + [b"x", "é".encode(), b"same same same", b"a\nb\nb"]
    x = np.array([quality.features(t) for t in texts])
    assert np.allclose(x, [plain_ratios(t) for t in texts]) and quality.features(b" \n") == [0.0] * quality.N_FEATURES
    y = np.array([int(b"CAT" not in t) for t in texts])
    model = quality.fit(x, y, steps=100)

    def raw(row):
        return sum(model.weights[f][sum(v > e for e in model.edges[f])] for f, v in enumerate(row))

    want = [1 / (1 + math.exp(-(raw(row) - model.cut + math.log(0.3 / 0.7)))) for row in x.tolist()]
    assert np.allclose(model.score(x), want)
    assert all((s >= 0.3) == (raw(row) >= model.cut) for s, row in zip(want, x.tolist(), strict=True) if abs(raw(row) - model.cut) > 1e-9)
    good, bad = (model.raw(x[y == k]) for k in (1, 0))
    assert (good[:, None] > bad).mean() > 0.95  # pairs in the order they were preferred


def plain_near(word, entry, whole):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    return distance(word, entry) if whole else min(distance(word[:k], entry) for k in range(len(word) + 1))


def test_automaton_is_exact():
    r = random.Random(5)
    entries = {"idiot$": 3.0, "lowei": 2.0, "scum$": 4.0, "trashy$": 1.0, "veq": 2.5}
    lexicon = toxicity.Lexicon(entries)
    for _ in range(3000):
        word = list(r.choice([e.rstrip("$") for e in entries]))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randrange(2)] = r.choice(["", "x", "e"])
        word = "".join(word) + r.choice(["", "", "n", "ich"])
        best = (0, 0.0)
        near = {e: plain_near(word, e.rstrip("$"), e.endswith("$")) for e in entries}
        if any(d == 0 for d in near.values()):
            best = (1, max(entries[e] for e, d in near.items() if d == 0))
        elif fuzzy := [entries[e] for e, d in near.items() if d == 1 and len(e.rstrip("$")) >= toxicity.FUZZY_LENGTH]:
            best = (2, max(fuzzy))
        assert lexicon.match(word) == best, word


def test_toxicity_against_a_plain_version():
    """Every word against every entry by edit distance, every occurrence in its window, then the sum of the weights."""
    r = random.Random(6)
    entries = {"idiot$": 3.0, "lowei": 2.0, "freundschaftsbruchkerl$": 4.0, "veq": 2.5}
    weights, scale = np.array([1.5, 0.5, -1.0, -0.5, 2.0, 0.3, 0.1, -2.0]), np.array([1.0, 2.0, 1.0, 2.0, 1.0, 4.0, 50.0])
    model = toxicity.Toxicity(entries, frozenset({"idiom"}), weights, scale)
    some = ["idiot", "idiott", "Idiom", "loweiten", "lowi", "freundschaftsbruchkerl", "freundschaftbruchkerl", "veqs", "vxq", "said", "schrieb", '"', "«", "»", "the", "cat", "ünd", ",", "\n"]
    texts = ["", " ", "idiot"] + [" ".join(r.choices(some, k=r.randint(1, 40))) for _ in range(300)]

    def match(word):
        near = {e: plain_near(word, e.rstrip("$"), e.endswith("$")) for e in entries}
        if exact := [entries[e] for e, d in near.items() if d == 0]:
            return 1, max(exact)
        inexact = [entries[e] for e, d in near.items() if d == 1 and len(e.rstrip("$")) >= 5]
        return (2, max(inexact)) if inexact and word not in model.benign else (0, 0.0)

    def score(text):
        low, n, strongest = text.lower(), Counter(), 0.0
        spans = [(m.start(), m.end()) for m in re.finditer(r"\w+", low)]
        for a, b in spans:
            kind, weight = match(low[a:b])
            if not kind:
                continue
            before, after = low[max(0, a - 48) : a], low[b : b + 48]
            opened = sum(c in '"“”„«»‘‹›' for c in before) % 2 == 1 and any(c in '"“”„«»‘‹›' for c in after)
            told = any(w in re.findall(r"\w+", before) for w in ("said", "schrieb"))
            n[kind, opened or told] += 1
            strongest = max(strongest, weight / kind)
        x = [math.log(1 + n[1, False]), math.log(1 + n[2, False]), math.log(1 + n[1, True]), math.log(1 + n[2, True]), float(n[1, False] > 0), strongest, 100.0 * (n[1, False] + n[2, False]) / max(1, len(spans))]
        return 1 / (1 + math.exp(-sum(w * v / s for w, v, s in zip(weights, x, scale, strict=False)) - weights[-1]))

    assert np.allclose(model.score(texts), [score(t) for t in texts])


def test_terms_of_any_length():
    word = "freundschaftsbruchkerl" * 40
    assert {word + "$", word[:8], word[:3]} <= toxicity.terms(f"ein {word.upper()} ist da")
    texts = [f"{word} x{k}" for k in range(20)]
    counts = {t: (20, 0) for t in set.intersection(*map(toxicity.terms, texts))}
    lexicon = toxicity.Lexicon({word + "$": 2.0})
    assert counts and lexicon.match(word) == (1, 2.0) and lexicon.match(word[:-5] + word[-4:]) == (2, 2.0) and lexicon.match(word[:-2]) == (0, 0.0)


def test_lexicon_has_every_term():
    counts = {f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}zz$": (10, 0) for k in range(5000)}
    assert len(toxicity.choose(counts, 20, 20)) == 5000


def test_toxicity(spark):
    def make(r, k):
        words = sentences(r, r.randint(5, 60)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["blargh", "snorfle", "zwickum" + r.choice(["en", "er", "st"])]))
        return " ".join(words), int(toxic)

    docs, labels = labelled_docs(spark, "toxic", make)
    model = toxicity.learn(docs, labels)
    scored = toxicity.score_toxicity(docs, model)
    assert accuracy(scored, labels, "toxic") > 0.98
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    misspelled, plain = model.score(["the cat snorfel of blargh the snorle sun1 snorflee", "the cat1 of dog2 the sun1"])
    assert plain < 0.5 and misspelled > plain
    assert toxicity.keep_clean(docs, model).count() == scored.where("predicted = 0").count()
    assert toxicity.score_toxicity(docs, toxicity.learn(docs, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_mentions_are_told_from_attacks():
    lexicon = toxicity.Lexicon({"idiot$": 3.0})
    attack, mention = toxicity.features("you are an idiot today", lexicon), toxicity.features('the word "idiot" was used', lexicon)
    assert attack[0] > 0 == attack[2] and mention[2] > 0 == mention[0]


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href=x>Home</a></nav>
<article><h1>A &amp; B</h1><p>One  two<br>three <b>four.</p><p>Five &lt;six&gt;.<!-- no --><p>Seven<i>teen</i>.</article><footer>&copy; me</footer>"""


def test_blocks():
    assert [t for _, t, _ in blocks(PAGE)] == ["Home", "A & B", "One two three four.", "Five <six>.", "Seventeen.", "© me"]
    assert blocks("") == [] and [t for _, t, _ in blocks("just text")] == ["just text"]
    assert [t for _, t, _ in blocks("<p>a<div>b<span>c</span></div>d</p>")] == ["a", "bc", "d"]


def test_viterbi_is_best():
    r = np.random.default_rng(2)
    found, _ = labelled(4)
    found = found[:9]
    names = sorted({f for b in found for f in features(*b)})
    chain = Chain({f: tuple(r.standard_normal(2)) for f in names}, r.standard_normal((2, 2)), r.standard_normal(2))

    def value(ys):
        total = chain.first[ys[0]] + sum(chain.pairs[a, b] for a, b in zip(ys, ys[1:], strict=False))
        return total + sum(chain.weights[f][y] for b, y in zip(found, ys, strict=True) for f in features(*b))

    every = [[k >> p & 1 for p in range(len(found))] for k in range(2 ** len(found))]
    assert value(chain.label(found)) == pytest.approx(max(map(value, every)))


def test_extraction_on_pages_kept_aside():
    chain = trained_chain()
    right = total = 0
    for seed in range(10_000, 10_060):
        found, ys = labelled(seed)
        got = chain.label(found)
        right += sum(a == b for a, b in zip(got, ys, strict=True))
        total += len(ys)
    assert right / total > 0.95


def test_extraction(spark):
    rows = [(1, "u", PAGE, "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "v", PAGE, "c"), (1, "u", PAGE, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    want = "A & B\nOne two three four.\nFive <six>.\nSeventeen."
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in got) == sorted([(1, want, len(want)), (1, want, len(want)), (0, want, len(want)), (2, "", 0), (3, "", 0)])
    assert main_text(PAGE, trained_chain()) == want
    assert extract_text(pages.limit(0)).count() == 0


def test_blocks_of_a_head_without_end():
    body = "<article><h1>A</h1><p>One two three four.</p></article>"
    for head in ("<html><head><title>x</title><meta charset=utf-8><body>", "<head><style>p{}</style>", "<html><head>\n<link rel=x><noscript><p>no</p></noscript></body>"):
        assert [t for _, t, _ in blocks(head + body)] == ["A", "One two three four."]
        assert main_text(head + body, trained_chain()) == "A\nOne two three four."
    assert [t for _, t, _ in blocks("<head><title>x</title>shown<p>too")] == ["shown", "too"]
    assert [t for _, t, _ in blocks("<head><title>x</title></head><body><p>a</p></body>")] == ["a"]


def test_blocks_of_formulas_and_examples():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert [t for _, t, _ in blocks(f"<p>so {formula} holds</p>")] == ["so x=1 holds"]
    assert [t for _, t, _ in blocks("<p>a<xmp><b>&amp;</b> c</xmp><p>d")] == ["a", "<b>&amp;</b> c", "d"]


def test_blocks_take_time_in_proportion():
    """Pages of a megabyte that would cost their square if anything were read again."""
    n = 250_000
    pages = ['<a href="' * n, "<p title='" * n, "<div>" * n + "x</section>" * n, "<b>" * n + "<p>x</p>" * n, "<!" * n, "<!--" * n, "</script" * n, "<script>" + "</script" * n, "<li><b>" * n, "<" * n, '<p a="' + "x>y" * n, "<svg>" + "<g>" * n + "<body>"]
    for source in pages:
        began = time.process_time()
        blocks(source[: 1 << 20])
        assert time.process_time() - began < 10, source[:30]


def test_long_pages_of_different_marks():
    """A megabyte of nested elements, each with a mark of its own and a text, labelled in time that is in proportion."""
    chain = trained_chain()
    source = "".join(f"<div id=x{k}>word {k} here." for k in range(40_000))
    assert len(source) > 1 << 20
    began = time.process_time()
    main_text(source, chain)
    assert time.process_time() - began < 10


def test_labels_are_those_of_all_features():
    """Weights summed along the page against each block's whole list of features."""
    chain = trained_chain()
    for source in [*(s for s, _ in SITES), "<div class=nav><div class=nav><p>a b</p></div>c<section class=nav>d</section></div><p>e.</p>f" * 3]:
        found = blocks(source)
        trail = html_extract.Trail(chain.weights)
        for b in found:
            around = set(features(*b)[: len(features(*b)) - len(html_extract._own_features(*b))])
            want = np.array([chain.weights.get(f, (0.0, 0.0)) for f in around]).reshape(-1, 2).sum(axis=0)
            assert np.allclose(trail.go(b[0]), want)


def test_buttons_are_no_text():
    assert [t for _, t, _ in blocks("<article><p>One two.</p><button class=x>Buy <b>now</b></button><p>Three <button>Copy</button> four.</p></article>")] == ["One two.", "Three four."]


def test_blocks_of_odd_quotes():
    assert [t for _, t, _ in blocks("<p title=\"a>b\">one</p><p title='x>y' class=k>two</p><p it's>three</p><p a = \">\">four</p>")] == ["one", "two", "three", "four"]
    assert [t for _, t, _ in blocks('<p title="open>five</p>')] == ["five"]
    assert [t for _, t, _ in blocks("<p>a <svg><text>no</text></svg>b <object>x</object>c</p>")] == ["a b c"]


SITES = [
    ("<body><div id=top><a href=/>Start</a> <a href=/n>News</a></div><main><h1>River levels</h1><p>The river rose by two metres, and the town closed its bridge on Monday.</p><p>Nobody was hurt.</p></main><footer>Imprint and contact</footer></body>", "River levels\nThe river rose by two metres, and the town closed its bridge on Monday.\nNobody was hurt."),
    ("<body><ul class='site-menu'><li><a href=a>Blog</a><li><a href=b>About</a></ul><div class='entry-content'><h2>Bread</h2><p>Mix flour, water and salt, then wait for a night.<p>Bake it for an hour.</div><aside class=sidebar><h3>More</h3><a href=c>Cake</a></aside></body>", "Bread\nMix flour, water and salt, then wait for a night.\nBake it for an hour."),
    ("<div class=cookie-banner><p>We use cookies.</p><button>OK</button></div><article><h1>Stars</h1><p>A star is a ball of gas that shines by its own light, as the sun does.</p><pre>x = 1</pre></article><section class=comments><p>Great text, thank you!</p></section>", "Stars\nA star is a ball of gas that shines by its own light, as the sun does.\nx = 1"),
    ("<header><h2>The Daily</h2><form action=/s><label>Search</label><input></form></header><div class=post-body><p>Prices fell in May, the office said, after a long rise.</p><blockquote>It was time.</blockquote></div><div class=related><ul><li><a href=q>Also read</a></li></ul></div>", "Prices fell in May, the office said, after a long rise.\nIt was time."),
]


@pytest.mark.parametrize("source, want", SITES)
def test_extraction_of_written_sites(source, want):
    assert main_text(source, trained_chain()) == want


def test_lm_sums_in_place():
    """The exponentials of a block take the block's own place, also where rows lie far apart."""
    x = np.random.default_rng(0).standard_normal((1024, 256)).astype(np.float32)
    want, own = np.log(np.exp(x.astype(float)).sum(axis=1)), x.copy()
    tracemalloc.start()
    got = _log_sum(own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, atol=1e-4) and peak < x.nbytes / 4
    far = np.array([[0, 1], [-300, -301], [400, -400]], np.float32)
    assert np.allclose(_log_sum(far.copy()), np.logaddexp(far[:, 0], far[:, 1]), atol=1e-4)


def test_lm_steps_against_a_plain_version():
    """The outputs' gradients of one batch, summed word by word."""
    mass = np.array([5.0, 3, 2, 1, 0.5])
    trainer = Trainer(LogBilinear.start(mass), mass, 3)
    cumulative, log_noise, n = trainer.noise[0]
    noise = np.sort(np.minimum(np.searchsorted(cumulative, np.random.default_rng(3).random(n)), 4))
    q = np.hstack([np.random.default_rng(1).standard_normal((6, trainer.dim)), np.ones((6, 1))]).astype(np.float32)
    now, table = np.array([0, 0, 1, 2, 2, 4]), trainer.v.astype(float)
    real = lambda z: 1 / (1 + math.exp(-z))
    want = [real(log_noise[c] - h @ table[c]) * table[c] - sum(real(h @ table[k] - log_noise[k]) * table[k] for k in noise) for h, c in zip(q.astype(float), now, strict=True)]
    assert np.allclose(trainer._contrast(q, trainer.v, 1, now), want, atol=1e-4)


def test_lm_scores_equal_contexts_once(monkeypatch):
    """A context's softmax over bands is worked out once, a triple's whole probability as well; each token gets its own number."""
    r = np.random.default_rng(5)
    model = LogBilinear.start(r.random(60) + 0.1)
    h2, h1, now = (np.repeat(r.integers(0, 60, 40), 50) for _ in range(3))
    h2[:1000], h1[:1000] = 7, 9
    by = r.permutation(2000)
    h2, h1, now = h2[by], h1[by], now[by]
    rows = []
    monkeypatch.setattr(lm, "_log_sum", lambda x: rows.append(x.shape) or _log_sum(x))
    monkeypatch.setattr(lm, "TOGETHER", 16)
    monkeypatch.setattr(lm, "BLOCK", 3)
    got = model.log_prob(h2, h1, now)
    bands, starts = len(model.u), band_starts(60)
    triples = len(set(zip(h2, h1, now, strict=True)))
    assert sum(n for n, width in rows if width == bands) <= len(set(zip(h2, h1, strict=True))) + triples // 16 + 1
    assert sum(n for n, _ in rows) < 3 * triples < len(now)
    for k in range(0, 2000, 37):
        q = model.r[h2[k]] @ model.a[1] + model.r[h1[k]] @ model.a[0]
        b = band_of(now[k])
        lo, hi = starts[b], starts[b + 1]
        s, t = model.v[lo:hi] @ q + model.b[lo:hi], model.u @ q + model.g
        want = t[b] - np.log(np.exp(t).sum()) + s[now[k] - lo] - np.log(np.exp(s).sum())
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_lm_classes_of_words_not_at_hand(monkeypatch):
    """Words at hand have their own places; of the others each different ending is looked at once."""
    vocab = lm.Vocabulary([b"", b"the", "h\u00e9".encode()], np.array([2.0, 3, 1]), 3, 16, 6, 3, np.full(16, 0.1))
    asked = []
    monkeypatch.setattr(lm, "rare_class", lambda *x, f=lm.rare_class: asked.append(x) or f(*x))
    words = [f"w{k}ing" for k in range(50)] + ["h\u00e9", "ab", "\u00e9", "THE"]
    got = lm.Sequences(pa.array([" ".join(words), None, "the zing"]), vocab, vocab.tables())
    asked_for = len(asked)
    want = [2 if w == "h\u00e9" else 1 if w.lower() == "the" else lm.rare_class(w.encode(), 3, 16) for w in words]
    assert got.now.tolist() == [*want, 0, 0, 1, lm.rare_class(b"zing", 3, 16), 0]
    assert asked_for == 3


def test_lm_takes_exponentials_by_class_not_by_context(monkeypatch):
    """The softmax over bands has exponentials for each class in a context; far parameters go by each context. Both as a plain version gives them."""
    r = np.random.default_rng(2)
    model = LogBilinear.start(r.random(300) + 0.1)
    h2, h1, now = (r.integers(0, n, 5000) for n in (30, 30, 300))
    taken = []
    monkeypatch.setattr(lm, "COLUMNS", 7)
    monkeypatch.setattr(lm, "_log_sum", lambda x: taken.append(0) or np.log(np.exp(x.astype(float)).sum(axis=1)))
    monkeypatch.setattr(np, "exp", lambda x, f=np.exp, **k: taken.append(np.size(x)) or f(x, **k))
    for scale in (1, 30):
        taken.clear()
        used = LogBilinear(scale * model.r, scale * model.v, model.b, scale * model.u, model.g, model.a)
        got = used.log_prob(h2, h1, now)
        within = sum((band_of(c) > 0) * (band_of(c) + 1) for _, _, c in set(zip(h2, h1, now, strict=True)))
        bands, contexts = len(model.u), len(set(zip(h2, h1, strict=True)))
        if scale == 1:
            assert sum(taken) <= 60 * bands + within and contexts > 10 * 60
        q = used.r[h2] @ used.a[1] + used.r[h1] @ used.a[0]
        starts, b = band_starts(300), band_of(now)
        t = q @ used.u.T + used.g
        want = t[np.arange(5000), b] - np.logaddexp.reduce(t.astype(float), axis=1)
        for k in range(0, 5000, 41):
            s = used.v[starts[b[k]] : starts[b[k] + 1]] @ q[k] + used.b[starts[b[k]] : starts[b[k] + 1]]
            assert got[k] == pytest.approx(want[k] + s[now[k] - starts[b[k]]] - np.logaddexp.reduce(s.astype(float)), abs=1e-3)


def test_lm_works_out_equal_noise_once(monkeypatch):
    """128 draws from 5 classes are 5 columns; each counts as often as it was drawn."""
    mass = np.array([5.0, 3, 2, 1, 0.5])
    trainer = Trainer(LogBilinear.start(mass), mass, 3)
    taken = []
    monkeypatch.setattr(np, "exp", lambda x, f=np.exp, **k: taken.append(x.shape) or f(x, **k))
    q = np.hstack([np.random.default_rng(1).standard_normal((6, trainer.dim)), np.ones((6, 1))]).astype(np.float32)
    trainer._contrast(q, trainer.v, 1, np.array([0, 0, 1, 2, 2, 4]))
    assert taken == [(6, 5)] and trainer.used[1].sum() == lm.NOISE


def test_lm_trains_on_the_words_with_classes_only():
    """Classes are the same with all words at hand and with those alone that have a class of their own."""
    words = [b"", b"the", b"of", b"zing", b"ring", b"at"]
    vocab = lm.Vocabulary(words, np.arange(6.0, 0, -1), 3, 16, 21, 6, np.full(16, 0.1))
    own = vocab.of_classes()
    assert len(own.tables()[0]) == 3 and (own.class_mass() == vocab.class_mass()).all()
    texts = pa.array(["the zing of", "at ring other", None, "OF sting"])
    for a, b in zip(*(lm.Sequences(texts, x, x.tables()).contexts() for x in (vocab, own)), strict=True):
        assert (a == b).all()
