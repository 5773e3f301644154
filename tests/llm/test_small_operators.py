import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lithic.llm import byte_gru, config_packing, fair_mix, host_reputation, html_layout, toxicity, trigram_secrets

# Toxicity


def toxic_corpus(n=400, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(vocab, k=60)
        bad = i % 7 == 0
        if bad:
            words += r.choices(["zzidiot", "zzmoron", "zzmorons"], k=r.choice([1, 4, 12]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_separates_and_orders(spark):
    rows, labels = toxic_corpus()
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "zzmoron " * 50, "x"), (1002, "zzmoron " * 50, "x"), (1003, "calm words " * 5000, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, _id string")
    marks = spark.createDataFrame([*labels, (0, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].severity >= model.cutoff()) == (i % 7 == 0) for i, *_ in rows)
    assert got[1000].severity == got[1001].severity == got[1003].severity < model.cutoff() <= got[1002].severity
    assert abs(sum(got[1002].severity_probs) - 1) < 1e-9 and np.all(np.diff(model.thresholds) >= 0)
    assert toxicity.score(docs, model).count() == len(rows) + len(odd)


def test_toxicity_reads_long_unbroken_runs():
    rows, labels = toxic_corpus()
    toxic = {i: bad for i, _, bad in labels}
    model = toxicity.fit_rows([t for i, t, *_ in rows if i in toxic], np.array([toxic[i] for i, *_ in rows if i in toxic]))
    scorer = toxicity.Scorer(model.features)
    word = max((f for f in model.features if not f.startswith("^")), key=lambda f: (len(f), f))
    glued = "q" * 100 + word + "q" * 100
    assert scorer.counts(glued) and set(scorer.counts(glued)) == {k for f, k in model.features.items() if f in toxicity.word_features(glued)}
    assert scorer.counts("q" * 300) == {}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, model).first().severity < 1e-6
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_ordinal_gradient_direction():
    x = (np.arange(40) % 20, np.zeros(40, int), np.ones(40))
    w, theta = toxicity.fit_ordinal((np.arange(20), np.zeros(20, int), np.repeat([0.0, 1.0], 10)), np.repeat([0, 2], 10), 1, 3)
    assert w[0] > 1 and theta[0] <= theta[1] and len(x) == 3


# HTML

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>x<li>y<ul><li>z</ul></ul>end": "- x\n- y\n  - z\n\nend",
    "<ol start=3><li>x</li><li>y</ol>": "3. x\n4. y",
    "<table><tr><th>k<th>val<tr><td>long one<td>2</table>": "k         val\nlong one  2",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<head><title>t</title><style>p{}</style></head><body>v<script>var t='</p>';</script> w": "v w",
    "a<!-- no -->b<div hidden>h</div><span style='display: none'>i</span><div>c</div>": "ab\nc",
    "<pre>\n x\n  y</pre>": " x\n  y",
    "x &amp; y&nbsp;z<br>w": "x & y\xa0z\nw",
    "<b>one</b> <i>two</i>\n three": "one two three",
    "<dl><dt>k<dd>v</dl>": "k\n  v",
    "": "",
    "< 3 > 2": "< 3 > 2",
    "<details><summary>s</summary>no</details>t": "s\nt",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_html(html):
    assert html_layout.text_of(html) == PAGES[html]


def test_html_keeps_all_text_of_deep_pages(spark):
    deep = "<div>" * 5000 + "bottom" + "<p>x" * 3000
    df = spark.createDataFrame([(1, deep, "k"), (2, None, "k"), (3, "<p>y", "k")], "page_id long, html string, other string")
    got = {r.page_id: r.text for r in html_layout.extract(df).collect()}
    assert got[1].startswith("bottom") and got[1].count("x") == 3000 and got[2] is None and got[3] == "y"
    assert html_layout.extract(df.limit(0)).collect() == []


# Hosts


def test_urls_and_rules(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://x.net/de/1#f", "https://example.net/de/8", "no scheme", None, "ftp://h", "http://h?x", "://", "http://xexample.com/en/1", "http://u@h.co.uk:80/a"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(0, 1, "q"), (1, None, "q")], "page_id long, bad int, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, outcomes).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][:3] == ("x.net", "/de/1", "net/de/") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3][:3] == got[4][:3] == got[7][:3] == ("", "", None)
    assert got[5][:2] == ("h", "") and got[6][:2] == ("h", "") and got[8][2] == "com/en/" and got[9][0] == "u@h.co.uk:80"
    assert host_reputation.judge(pages, outcomes).count() == len(urls) + 1
    assert host_reputation.judge(pages.limit(0), outcomes.limit(0)).collect() == []


def test_bad_hosts_are_blocked_and_few_labels_shrink(spark):
    rows = [(i, f"http://{'bad' if i < 300 else 'good'}.site.org/p") for i in range(600)] + [(900, "http://new.site.org/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 600, 2)] + [(900, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in host_reputation.judge(pages, outcomes, rules=()).collect()}
    assert got[1].verdict == "block" and got[500].verdict == "allow" and got[900].bad_rate < 1
    low = got[900].bad_rate_low
    assert low < got[1].bad_rate_low


# Secrets


def python_spans(text):
    out = []
    for k, rule in enumerate(trigram_secrets.RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text or "", re.A) if len(m.group(rule.value_group)) >= rule.least]
    return sorted(out)


def test_secrets_equal_brute_force(spark):
    r = random.Random(4)
    bits = ["token = \"abcdef1\"", "PassWord:'short'", "password: longer_one", "secret:token:abcdefgh", "api_key=xyz/123+", "APIKEY = a", "AKIA" + "A1" * 8, "AKIA123", "0123456789abcdef01234567", "deadbeef" * 5, "é☃😀", "ghp_" + "a1" * 20, "xoxb-1234567890ab", "words", "passwd", "sk_live_" + "9" * 20, "tok", "en", "\n", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOi.abcdef"]
    rows = [(i, r.choice(["", " ", "x"]).join(r.choices(bits, k=r.randrange(0, 9)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a" * 50_000 + " token=abcdefgh"), (None, "token=abcdefgh"), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, kind string")
    got = sorted(((s.doc_id is None, s.doc_id or 0), s.text or "", [tuple(x) for x in s.secrets]) for s in trigram_secrets.scan(df).collect())
    assert got == sorted(((i is None, i or 0), t or "", python_spans(t)) for i, t in rows)
    for row in trigram_secrets.digest(trigram_secrets.scan(df)).collect():
        base = ",".join(f"{trigram_secrets.RULES[k].kind}:{s}:{e}" for s, k, e in python_spans(dict(rows)[row.doc_id]) if k < 3)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    clean = {x.doc_id: x.text for x in trigram_secrets.redact(df).collect()}
    for i, t in rows:
        expected, at = "", 0
        for start, _, end in python_spans(t):
            if start >= at:
                expected += t[at:start] + "[SECRET]"
            at = max(at, end)
        assert clean[i] == (None if t is None else expected + t[at:])
    assert trigram_secrets.scan(df.limit(0)).collect() == []


def test_trigram_queries():
    q = trigram_secrets.trigram_query
    assert q("[0-9a-f]{24,}") == trigram_secrets.ANY and q("ab?c*") == trigram_secrets.ANY
    assert q("AKIA[A-Z]+") == frozenset([frozenset(["aki", "kia"])])
    assert q("(?:abcd|xyz)+1") == frozenset([frozenset(["abc", "bcd"]), frozenset(["xyz"])])
    assert q("a(?:bc|d)e") == trigram_secrets.ANY or frozenset(["ade"]) in q("a(?:bc|d)e")


# Mixing


def python_mix(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = [(i, words(t), "t" if s is None else "s" + s, int(hashlib.md5(f"{fair_mix.SEED}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    total = {}
    for _, n, s, _ in docs:
        total[s] = total.get(s, 0) + n
    weight = {s: fair_mix.WEIGHTS[k % 3] for k, s in enumerate(sorted(total))}
    target, free, left = {}, set(total), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        free -= full
    queue, cum = [], {}
    for i, n, s, h in sorted(docs, key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[1])):
        cum[s] = cum.get(s, 0) + n
        queue += [((cum[s] + k * total[s]) / target[s], k, h, -1 if i is None else i, n, s) for k in range(3) if n and target[s]]
    taken, at = {}, 0
    for f in sorted(queue):
        at += f[4]
        if at > sum(total.values()):
            break
        taken[f[3:]] = taken.get(f[3:], 0) + f[4]
    return sorted((-1 if i is None else i, n, total[s], round(target[s], 6), taken.get((-1 if i is None else i, n, s), 0)) for i, n, s, _ in docs)


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), r.choice(["a", "b", "b", "b", "b", "é", None])) for i in range(150)]
    rows += [(500, None, "a"), (501, "one", "tiny"), (502, " \t ", "z"), (None, "no id here", "b")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, source string, size int")
    got = fair_mix.mix(df).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in got) == python_mix(rows)
    assert all(x.taken <= 3 * x["size"] for x in got)
    times = {}
    for x in fair_mix.repeated(df).collect():
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    assert all(times.get(x.doc_id, 0) == (x.taken // x["size"] if x["size"] else 1) for x in got)


def test_mix_of_nothing(spark):
    assert fair_mix.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


# Language


def test_language_held_out_accuracy(spark):
    r = random.Random(3)
    parts = {"aa": ["ka", "mo", "tu", "ri"], "bb": ["sch", "ein", "ung", "pf"], "cc": ["é", "eau", "que", "ment"]}
    text = lambda lang, n: " ".join("".join(r.choices(parts[lang], k=r.randrange(1, 4))) for _ in range(n))
    train = [(lang, text(lang, 80)) for lang in parts for _ in range(30)]
    model = byte_gru.train([t for _, t in train], [lang for lang, _ in train], steps=400)
    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(list(parts) * 20)] + [(100, None, "aa"), (101, "123 !?", "aa"), (102, "", None), (103, text("bb", 20_000), "bb"), (104, "x" * 5000, "aa")]
    got = {x.doc_id: x for x in byte_gru.label(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows[:60]) >= 57 and got[103].lang_pred == "bb"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102)) and all(0 <= x.score <= 1 for x in got.values())
    assert byte_gru.label(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None).first().lang_pred == "und"
    assert byte_gru.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_backpropagation_by_differences():
    r = np.random.default_rng(0)
    m = byte_gru.ByteGRU.fresh(["a", "b"], 5)
    m.w = {k: v.astype(float) for k, v in m.w.items()}
    x, y, w = r.integers(90, 99, (6, 4)), np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 1.0])
    _, g = m.gradients(x, y, w)
    for k in g:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-4
        up = m.gradients(x, y, w)[0]
        m.w[k][at] = old - 1e-4
        down = m.gradients(x, y, w)[0]
        m.w[k][at] = old
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1e-3, abs(g[k][at])) + 1e-5


def one_by_one(m, text):
    """Position by position: the states of both directions, each begun CONTEXT bytes before its window."""
    squash = lambda x: x / (1 + np.abs(x))
    read = text.encode().lower()
    size = next((k for k in byte_gru.SHORT if len(read) <= k), byte_gru.WINDOW)
    wide = b" " * byte_gru.CONTEXT + read.ljust(size) + b" " * byte_gru.CONTEXT
    total, done = np.zeros(len(m.langs)), 0
    while done < len(read):
        at = done if len(read) <= size else min(done, len(read) - size)
        states = {}
        for d, part in (("f", range(at, at + byte_gru.CONTEXT + size)), ("b", range(at + 2 * byte_gru.CONTEXT + size - 1, at + byte_gru.CONTEXT - 1, -1))):
            x, u = m.w[d + "x"].astype(float), m.w[d + "u"].astype(float)
            h = len(u)
            s = np.zeros(h)
            for k in part:
                zr = (squash(x[wide[k], : 2 * h] + s @ u[:, : 2 * h]) + 1) / 2
                s = s + zr[:h] * (squash(x[wide[k], 2 * h :] + (zr[h:] * s) @ u[:, 2 * h :]) - s)
                states[d, k - byte_gru.CONTEXT] = s
        for k in range(done, min(at + size, len(read))):
            y = np.concatenate([states["f", k], states["b", k]]) @ m.w["out"] + m.w["bias"]
            total += y - np.log(np.exp(y).sum())
        done = at + size
    p = np.exp(total / len(read))
    return p / p.sum()


def test_language_windows_against_brute_force():
    m = byte_gru.ByteGRU.fresh(["a", "b", "c"], 6)
    r = random.Random(5)
    texts = ["".join(r.choices("abc dé語", k=n)) for n in (1, 20, 32, 33, 120, 200, 256, 257, 700)] + ["abc " * 64, "x" * 257]
    got = byte_gru.pooled(m, texts)
    assert np.allclose(got, [one_by_one(m, t) for t in texts], atol=1e-5)
    assert np.allclose(got[3], byte_gru.pooled(m, [texts[3]])[0], atol=1e-6)  # whatever stands beside it


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return config_packing.default_tokenizer()


def test_encoder_equals_the_tokenizer(tokenizer):
    enc = config_packing.Encoder(tokenizer)
    texts = ["a  b", "  x", "x\n\n y <|endoftext|> z", "don't  we'll²ª ½!  x", "", "\t\t a", "日本 é", "x\x85y \x1c\x1d z", "l'été où", "🙂 ok", "x" * 3000, "A\xa0B \xa0"]
    assert all(enc.encode(t) == enc.whole(t) for t in texts)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
        ("a<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>one <tspan>two</tspan></text><g><text>three</text></g>no</svg>b", "a\none two\nthree\nb"),
        ("<svg><g><path/><p>after</p>", "after"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<div style='backface-visibility:hidden'>yes</div>", "yes"),
    ],
)
def test_visible_text_of_formulas_drawings_and_hidden_parents(html, text):
    assert html_layout.text_of(html) == text


def test_packing_round_trip(spark, tokenizer):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "é", "delta!"], k=r.choice([0, 3, 200, 700, 2500])))) for i in range(60)] + [(100, None), (101, ""), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, piece int")
    got = config_packing.pack_documents(df.select("doc_id", "text"), tokenizer).collect()
    enc = config_packing.Encoder(tokenizer)
    ids = [(i, enc.encode(t or "") + b"\x02\0\0\0") for i, t in rows]
    for x in got:
        assert any(i == x.doc_id and zlib.crc32(b[4 * x.start : 4 * (x.start + x.length)]) == x.ids_crc32 for i, b in ids) and x.length <= 1024
        assert x.length == 1024 or x.piece == 0
    assert sum(x.length for x in got) == sum(len(b) // 4 for _, b in ids)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(x.length for x in got) // 1024) * 1.1 + 2
    assert config_packing.pack_documents(df.select("doc_id", "text").limit(0), tokenizer).collect() == []


def test_plan_covers_every_piece_and_beats_first_fit():
    r = np.random.default_rng(1)
    for hot in (0, 50_000):
        lengths = np.arange(1, 1025)
        counts = r.poisson(r.exponential(30, 1024))
        counts[699] += hot
        lengths, counts = lengths[counts > 0], counts[counts > 0]
        plan, n = config_packing.plan(lengths, counts)
        used = {}
        for length, first, ranks, *_ in plan:
            assert first == used.get(length, 0)
            used[length] = first + ranks
        assert used == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        least = max(-(-int((lengths * counts).sum()) // 1024), int(counts[lengths > 512].sum()))
        assert least <= n <= least * 1.03 + 2


def test_linear_program_covers_all_demand():
    r = np.random.default_rng(2)
    for lengths, counts in ((np.arange(1, 1024), 300 + r.integers(0, 30, 1023)), (np.arange(3, 900, 7), r.integers(1, 4, 129)), (np.array([600]), np.array([5]))):
        covered = sum(config * times for config, times in config_packing.solve(lengths, counts, 1024))
        assert np.array_equal(covered, counts)
        _, n = config_packing.plan(lengths, counts)
        least = max(-(-int((lengths * counts).sum()) // 1024), int(counts[lengths > 512].sum()))
        assert least <= n <= least * 1.03 + 2
