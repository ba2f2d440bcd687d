"""Operators that compare documents or learn from tables, against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageproof.llm import links, minhash, mixing, substrings, toxicity, urlrules

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def plain_components(texts, size, percent):
    def shingled(text):
        words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))

    sets = {i: shingled(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def family(rng, n_words, members, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    out = []
    for _ in range(members):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(n_words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(docs, size):
    rng = random.Random(size)
    texts = [None, "", "  ", "one", "ONE", "one two", "One Two", "x" * 5000, "x" * 5000, "É é", "é é"]
    for n, members, edits in ((60, 40, 9), (30, 25, 4), (200, 20, 25), (12, 30, 2)):
        texts += family(rng, n, members, edits)
    texts += ["same text again and again here"] * 30
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    rows = dict(zip(ids, texts, strict=True))
    want = plain_components(rows, size, 80)
    got = by_id(minhash.link(docs(list(rows.items())), size=size, percent=80))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_of_odd_rows(docs):
    assert minhash.link(docs([])).collect() == []
    rows = minhash.link(docs([(1, "a b c"), (1, "a b c"), (1, "other words"), (4, "other words"), (None, "a b c")]), size=2)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows.collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (1, 1, True), (4, 1, False)]
    frame = docs([(3, "a b c"), (1, "a b c"), (1, "a b c"), (2, ""), (5, None), (None, "a b c")])
    kept = minhash.one_of_each(frame, size=2)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 5]
    assert kept.columns == frame.columns


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for own in (10, 50, 100):
        sets = [np.concatenate([shared, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2)]
        a, b = (minhash.odd_sketch(minhash.minhashes(s)) for s in sets)
        differing = sum(bin(int(x)).count("1") for x in a ^ b)
        assert abs(minhash.estimated_similarity(differing) - 900 / (900 + 2 * own)) < 0.12


def test_components_of_chains_hubs_and_loops(llm):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (1, 0), (2000, 2001)]
    got = {r["id"]: r["component"] for r in links.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1200))
    assert got[2001] == got[2000] == 2000 and len(got) == 503
    assert links.components(llm.createDataFrame([], "a long, b long")).collect() == []


def plain_removal(texts, window):
    first = {}
    words = {i: SPACE.findall(t or "") for i, t in texts.items()}
    for i in sorted(texts):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for p in range(len(own) - window + 1):
            if first[tuple(own[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 8, 5, 2])
def test_repeated_passages_equal_all_windows(docs, window):
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(3000)}" for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    texts = [None, "", "one two", " ".join(passages[0]), " ".join(passages[0]) + "\n", " a " * 200, " a " * 120]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [f"q{rng.randrange(4000)}" for _ in range(20)] for _ in range(6)]
        texts.append("\t".join(w for p in parts for w in p))
    texts += [texts[-1], texts[-2], texts[-1]]
    ids = rng.sample(range(1000), len(texts))
    rows = dict(zip(ids, texts, strict=True))
    got = by_id(substrings.remove_repeats(docs(list(rows.items())), window))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == plain_removal(rows, window)


def test_passages_of_odd_rows_and_levels(docs):
    assert substrings.remove_repeats(docs([])).collect() == []
    long = " ".join(f"w{i}" for i in range(120))
    rows = substrings.remove_repeats(docs([(1, long), (1, long), (None, long), (2, long), (2, "x " + long)]))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in rows.collect())
    assert got == [(-1, 120, 0), (1, 120, 0), (1, 120, 0), (2, 120, 120), (2, 121, 120)]
    frame = docs([(1, long), (2, "y " + long), (3, " ".join(long.split()[:70])), (4, "z " * 60)])
    windows = substrings.repeated_windows(frame)[2].select("doc_id", "text_key", "start", "hash")
    longest = {r["doc_id"]: r["longest"] for r in substrings.longest_passages(windows, 50).collect()}
    assert longest == {1: 100, 2: 100, 3: 50}


def test_url_rules(llm):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://xnet/", "https://Sub.Example.NET/en/x?y#z",
        "http://example.com/de/1", "http://notexample.com/de/1", "http://w.org/fr/", "http://w.org/fr", "http://a.org/en#/fr/",
        "http://spam-farm.example.org/x", "https://m.casino.org/", "http://a.org/Casino-x", "http://a.org/f.EXE",
        "http://doubleclick.x.org/click", "redirect?u=http://b.com/p://q/x", "http://ü.net/ä", "http://a.net:80/", "http://a.net/",
    ]
    pages = llm.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urlrules.judge(pages).collect()}
    assert len(got) == len(urls)
    base = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in base if ("." + host).endswith("." + h) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fit)[1] if fit else None)
        if fit:
            assert got[i]["verdict"] == max(fit)[2]
    assert [got[i]["verdict"] for i in range(4)] == ["allow"] * 4
    assert [got[i]["pattern_rule"] for i in (13, 14, 15, 16, 17)] == ["spam-farm", "word:casino", "word:casino", "download", "ad-server"]
    assert urlrules.judge(pages.limit(0)).collect() == []


def test_filed_rules_lose_no_match(llm):
    """Every URL against every expression, without the index."""
    rng = random.Random(11)
    hosts = ["ad.x.org", "ads12.x.org", "adserver3.a.de", "doubleclick.b.com", "bad.x.org", "spam-farm7.org", "a.spam-farm.de", "link-exchange9.fr",
             "\u212aads.de", "x.net"]
    paths = ["/clickthrough", "/track", "/bannerx", "/f.exe", "/g.APK", "/f.exec", "/a.msi/b", "/wp-login.php", "/\u212acasino", "/casino2", "/xxx/1", "/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    rules = urlrules.BASE_RULES + urlrules.PATTERN_RULES
    assert all(r.tokens or r.any_of for r in rules)
    fit = lambda place: [(r.rank, r.name) for r in rules if re.search(r.pattern, place, re.ASCII)]
    pages = llm.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    won = {r["page_id"]: r["rule"] or r["pattern_rule"] for r in urlrules.judge(pages, rules).collect()}
    assert won == {i: max(fit(u.split("://")[1]), default=(0, None))[1] for i, u in enumerate(urls)}
    assert len(set(won.values())) >= 8


def test_rules_are_filed_under_their_rarest_token(llm):
    rules = (urlrules.Rule("r", "block", "spam-farm", ("spam", "farm"), 1), urlrules.Rule("open", "block", "x", (), 1))
    tokens = llm.createDataFrame([("farm",), ("farm",), ("spam",), ("other",)], "token string")
    index = urlrules.rule_index(urlrules.rule_frame(llm, rules), tokens)
    assert {r["rule_name"]: r["token"] for r in index.collect()} == {"r": "spam", "open": None}


def test_toxicity_is_learnt_from_words_in_any_place(docs, llm):
    rng = random.Random(4)
    word = lambda: f"word{rng.randrange(300)}"
    texts, labels = [], []
    for i in range(240):
        own = [word() for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own)), rng.choice(["vilething", "nastybit"]))
        texts.append(" ".join(own))
        labels.append((i, int(i % 3 == 0), 1))
    model = toxicity.learn(docs(texts[:180], lang="en"), llm.createDataFrame(labels[:180] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int"))
    scores = by_id(docs([*texts[180:], None, "", "VILETHING!", "a " * 50_000 + "vilething"]).select("doc_id", toxicity.score(F.col("text"), model).alias("s")))
    right = sum((scores[i]["s"] >= 0.5) == (i % 3 == 0) for i in range(60))
    assert right >= 57
    assert scores[60]["s"] < 0.5 and scores[61]["s"] == scores[60]["s"] and scores[62]["s"] >= 0.5 and scores[63]["s"] >= 0.5


def test_toxicity_without_labels(docs, llm):
    model = toxicity.learn(docs(["a"]), llm.createDataFrame([], "doc_id long, toxic int"))
    assert model.score("anything") == model.score(None) == 0.5


def test_mixing_reaches_targets(docs, llm):
    rng = random.Random(5)
    kinds = {"good": ("plain", 70), "low": ("junk", 20), "toxic": ("vile", 10)}
    rows, labels = [], []
    for i in range(400):
        kind = rng.choices(list(kinds), [k[1] for k in kinds.values()])[0]
        rows.append((i, " ".join(rng.choice([kinds[kind][0] + str(rng.randrange(5)), "the", "of"]) for _ in range(50))))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    table = llm.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    weights = {"good": 0.6, "low": 0.3, "toxic": 0.1}
    got = mixing.mix(docs(rows), table, weights, most=4.0).collect()
    whole = sum(r["n_tokens"] for r in got)
    for d, share in weights.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / whole - share) < 0.01
    assert all(0 <= r["rate"] <= 4 and abs(r["copies"] - r["rate"]) < 1 for r in got)
    once = mixing.mix(docs(rows), table, {"good": 0.9, "low": 0.07, "toxic": 0.03}, most=1.0).collect()
    assert all(r["rate"] <= 1 and r["copies"] <= 1 for r in once)
    assert all(r["rate"] >= mixing.SURE for r in once if r["domain"] == "good")


def test_mixing_of_odd_rows(docs, llm):
    labels = llm.createDataFrame([(0, 1, 0), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    frame = docs([(0, "a b"), (1, None), (2, ""), (2, ""), (None, "x")])
    rows = mixing.mix(frame, labels).collect()
    assert len(rows) == 5 and all(abs(r["p_good"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    drawn = mixing.mixed_documents(frame, labels)
    assert drawn.columns == frame.columns and None in [r["doc_id"] for r in drawn.collect()]
    assert mixing.mix(docs([]), labels.limit(0)).collect() == []


@pytest.mark.parametrize(("n_toxic", "labelled"), [(0, True), (2, True), (4, True), (20, True), (4, False)])
def test_good_documents_stay_however_rare_the_others_are(docs, llm, n_toxic, labelled):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        kind = "vile" if i < n_toxic else "junk" if i < n_toxic + 40 else "plain"
        rows.append((i, " ".join(rng.choice([kind + str(rng.randrange(3)), "the", "of"]) for _ in range(50))))
        labels.append((i, int(kind != "junk"), int(kind == "vile")))
    table = llm.createDataFrame(labels if labelled else [], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in mixing.mixed_documents(docs(rows), table).collect()}
    toxic, low, good = (len([i for i in got if a <= i < b]) for a, b in ((0, n_toxic), (n_toxic, n_toxic + 40), (n_toxic + 40, 400)))
    assert good == 360 - n_toxic
    if not labelled:
        assert (toxic, low) == (n_toxic, 40)
    else:
        # Toxic ones stay up to their 2 %, low ones are thinned out to about 5 %.
        assert toxic == n_toxic if n_toxic <= 4 else toxic < n_toxic
        assert 8 <= low <= 32


def test_targets_take_the_shares_of_rare_domains_as_upper_ones():
    share = {"good": 0.93, "low": 0.05, "toxic": 0.02}
    got = mixing._targets({"good": 890.0, "low": 100.0, "toxic": 10.0}, share, 1.0)
    assert got["good"] == 0.89 and got["toxic"] == 0.01 and abs(got["low"] - 0.05 * sum(got.values())) < 1e-12
    got = mixing._targets({"good": 700.0, "low": 200.0, "toxic": 100.0}, share, 1.0)
    assert all(abs(got[d] - share[d] * 0.7 / 0.93) < 1e-12 for d in share)


def test_toxicity_is_learnt_from_all_rows_in_several_parts(docs, llm, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 60)
    rng, taught = random.Random(9), []
    kept = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, model, n: (taught.append((n, rows.count(), rows.rdd.getNumPartitions())), kept(rows, model, n)))
    word = lambda: f"word{rng.randrange(300)}"
    texts = [" ".join([word() for _ in range(20)] + ["vilething"] * (i % 3 == 0)) for i in range(240)]
    model = toxicity.learn(docs(texts[:180], lang="en"), llm.createDataFrame([(i, int(i % 3 == 0)) for i in range(180)], "doc_id long, toxic int"))
    assert taught == [({0: 120, 1: 60}, 180, 3)]
    assert sum((model.score(texts[i]) >= 0.5) == (i % 3 == 0) for i in range(180, 240)) >= 57


def test_shortened_texts_pool_the_same():
    import numpy as np

    rng, model = np.random.default_rng(3), toxicity._fresh(np.arange(1, 40))
    for _ in range(200):
        known = np.where(rng.random((rng.integers(0, 40), 3)) < 0.05, rng.integers(1, 40, 1), 0).astype(np.int32)
        whole, short = (model.pooled(toxicity._padded(x))[0] for x in (known, toxicity.shortened(known)))
        assert np.allclose(whole, short)


def test_labelled_texts_alone_are_shuffled(llm, monkeypatch):
    rows = [(i, f"text {i}", "en") for i in range(-1000, 4000)] + [(None, "no id", None), (7, "again", None)]
    frame = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = llm.createDataFrame([(i, i % 2) for i in range(-990, 9000, 45)] + [(7, 1), (7, 0), (8, 1)], "doc_id long, toxic int")
    marks = [tuple(r) for r in labels.collect()]
    want = sorted((i, t, k) for i, t, _ in rows for j, k in marks if i == j)
    assert len(want) == 116
    for bits in (toxicity.BITS, 1 << 17, 40, 1):
        monkeypatch.setattr(toxicity, "BITS", bits)
        got = toxicity.labelled(frame, labels)
        assert sorted((r["doc_id"], r["text"], r["toxic"]) for r in got.collect()) == want
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        if bits >= 1 << 17:
            assert toxicity.likely(frame, labels).count() <= 113 + 20


def test_learning_stores_no_more_than_the_labelled_texts(docs, llm, monkeypatch):
    stored, kept = [], toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df: (stored.append(df), kept(df))[1])
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(2000)) for i in range(60)]
    toxicity.learn(docs(texts), llm.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    size = sum(sum(len(v) for v in r if isinstance(v, (str, bytes, bytearray))) for r in stored[0].collect())
    assert size <= sum(map(len, texts[:20]))


def test_words_of_a_batch_are_hashed_as_alone():
    import numpy as np
    from zlib import crc32

    def plain(word):
        h, out = 0, []
        for i, b in enumerate(word):
            h += b * pow(toxicity._BASE, i, 1 << 64)
        out.append(h if len(word) <= toxicity.PIECE else crc32(word))
        for n in toxicity.BEGINNINGS:
            out.append((int.from_bytes(word[:n], "little") + (n << 56)) * toxicity._BASE)
        mixed = [((x := h % (1 << 64)) ^ (x >> 32)) * toxicity._MIX % (1 << 64) for h in out]
        return [x >> 44 for x in mixed]

    rng = random.Random(1)
    texts = [None, "", "  ", "One, two_THREE", "É é ß\x00z", "a", "--"]
    texts += ["".join(rng.choice("abcdefgh\u00fc\n.  ") for _ in range(rng.randrange(3000))) for _ in range(40)]
    ids, n_words = toxicity.bucket_ids(texts)
    words = [(t or "").encode().translate(toxicity._WORD_BYTES).split() for t in texts]
    assert n_words.tolist() == [len(w) for w in words]
    assert ids.tolist() == [plain(w) for of in words for w in of]
    size = toxicity.PIECE
    for n in (size - 1, size, size + 1, 2 * size, 5 * size):
        for before in ("", "ab cd ", "x " * (size // 2 - 3), "y " * size):
            ids, n_words = toxicity.bucket_ids([before + "q" * n + " end", "next"])
            alone = toxicity.bucket_ids(["q" * n])[0].tolist()
            assert n_words.tolist() == [len(before.split()) + 2, 1]
            assert ids[-3:].tolist() == alone + toxicity.bucket_ids(["end next"])[0].tolist()
    assert toxicity.bucket_ids(["q" * (size + 1)])[0].tolist() == [plain(b"q" * (size + 1))]
    assert np.bincount(toxicity.bucket_ids([" ".join(map(str, range(200_000)))])[0][:, 0]).max() < 9


def test_texts_of_a_batch_score_as_alone(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    words = [f"word{i}" for i in range(50)]
    texts = [None, "", "none of these"] + [" ".join(rng.choice([*words, *["other"] * 150]) for _ in range(rng.randrange(60))) for _ in range(80)]
    model = toxicity._fresh(np.unique(toxicity.bucket_ids(words)[0][:, 0]))
    model.biases[:] = np.linspace(-1, 1, len(model.biases))
    model.langs, model.lang_rows = ["de", "en"], np.zeros(toxicity.BUCKETS, np.int32)
    model.lang_rows[toxicity.bucket_ids(["word1 word2"])[0][:, 0]] = [1, 2]
    model.lang_weights, model.thresholds = np.array([[0, 0], [1, -1], [-1, 1.0]]), {"de": 0.5, "en": -0.5}

    def plain(text):
        ids, n_words = toxicity.bucket_ids([text])
        rows = toxicity._padded(model.rows[ids])
        best = np.zeros(toxicity.N_FILTERS)
        for k, width in enumerate(toxicity.WIDTHS):
            for at in range(len(ids)):
                if rows[at : at + width].any():
                    for f in range(toxicity.FILTERS):
                        own = [model.filters[toxicity._PAIR_AT[k, j] + f] @ model.embedded(rows[at + j : at + j + 1])[0] for j in range(width)]
                        best[k * toxicity.FILTERS + f] = max(best[k * toxicity.FILTERS + f], sum(own) + model.biases[k * toxicity.FILTERS + f])
        counts = [(text or "").split().count(w) for w in ("word1", "word2")]
        cut = 0.0 if not sum(counts) else 0.5 if counts[0] >= counts[1] else -0.5
        return 1 / (1 + np.exp(-(best @ model.weights + model.bias[0] - cut)))

    want = [plain(t) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-5) and len({round(w, 3) for w in want}) > 40
    whole = model.scores(texts)
    for block, piece in ((7, 1 << 18), (20_000, 300)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(model.scores(texts), whole, atol=1e-6)
    assert np.allclose([model.score(t) for t in texts], whole, atol=1e-6)
