import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, html_text, langid, license_scan, lm_score, quality, toxicity
from tidemark.llm.text import alnum_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "A-b_c", "x " * 5000, "É ü 日本 `q` {z} 0"]
lower = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(lower))


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string, labels string")


def random_texts(seed, n, pool):
    r = random.Random(seed)
    return ["".join(r.choice(pool) + r.choice([" ", " ", "\n", ", ", "  "]) for _ in range(r.randrange(0, 80))) for _ in range(n)]


# --- licenses


def test_license_base_equals_brute_force(spark):
    pool = ["under", "the", "MIT", "License", "Apache", "Version", "2", "2.0", "CC", "by", "NC", "sa", "x", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0."]
    texts = random_texts(1, 120, pool) + ODD
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        base = sorted({x for _, x in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base)), t
        assert set(base) <= set(r.labels.split(",") if r.labels else []) and 0 <= r.score <= 1


@pytest.mark.parametrize("text,labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Released under the MIT License.", "mit"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("He came with a permit to the isc meeting", ""),
    ("dedicated to the public domain license", "public-domain"), ("Mozilla Public License 2.0", "mpl-2"),
])
def test_license_rules(text, labels):
    assert license_scan.Scanner().scan(text)["labels"] == labels


def test_license_containment_keeps_the_stronger():
    kept = license_scan.resolve([(1, 5, 10, 0.4, "b"), (4, 0, 20, 0.9, "a"), (1, 15, 30, 0.4, "c"), (1, 15, 30, 0.4, "d")])
    assert [d[4] for d in kept] == ["a", "c"]
    assert sum(map(len, license_scan.make_rules().values())) > 200


@pytest.mark.parametrize("text,labels", [
    ("Licensed under GPLv3", "gpl-3"), ("licensed under the GPLv2", "gpl-2"), ("Expat license", "mit"), ("SPDX-License-Identifier: 0BSD", "0bsd"), ("Common Development and Distribution License", "cddl"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3"), ("SPDX-License-Identifier: EPL-2.0", "epl-2"),
    ("Apache License v2.0", "apache-2"), ("GNU General Public License v3.0", "gpl-3"), ("SPDX-License-Identifier: GPL-2.0", "gpl-2"), ("SPDX-License-Identifier: EUPL-1.2", "eupl"), ("a gplv nothing", ""),
])
def test_license_short_ids_and_versions(text, labels):
    assert license_scan.Scanner().scan(text)["labels"] == labels


def expansions(parsed):
    """Strings of a rule's expression, one for each choice of its alternatives."""
    out = [""]
    for op, arg in parsed:
        if str(op) == "LITERAL":
            more = [chr(arg)]
        elif str(op) == "IN":
            more = [chr(c) for _, c in arg if isinstance(c, int)] or [chr(c) for _, (a, z) in arg for c in range(a, z + 1)]
        elif str(op) == "BRANCH":
            more = [x for branch in arg[1] for x in expansions(branch)]
        elif str(op) == "SUBPATTERN":
            more = expansions(arg[3])
        else:
            assert str(op) == "MAX_REPEAT" and arg[:2] == (0, 1)
            more = ["", *expansions(arg[2])]
        out = [a + b for a in out for b in more]
    return out


def test_license_gates_lose_nothing():
    gated, every = license_scan.Scanner(), license_scan.Scanner()
    every.rules = {(b" ",): [r for rules in gated.rules.values() for r in rules]}
    for keywords, name in license_scan.LICENSES.values():
        for text in expansions(re._parser.parse(name)):
            assert set(text.split()) & set(keywords.split()), text
            got = gated.scan(f"SPDX-License-Identifier: {text}")
            assert got == every.scan(f"SPDX-License-Identifier: {text}") and got["score"] == 1, text


# --- decontamination


def test_decontamination_equals_brute_force(spark):
    pool = list("abcde") + ["F", "g-h"]
    items = random_texts(2, 12, pool) + [None, "", "a b", "c"]
    texts = random_texts(3, 100, pool) + [f"x {t} y" for t in items if t] + ODD
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    for limit in (1 << 20, 60):  # at once, and in several passes
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench, max_bytes=limit).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), []
            for k, item in enumerate(items):
                v = words(item)
                wins = {tuple(v[j : j + 13]) for j in range(max(1, len(v) - 12))} if v else set()
                at = [(j, len(x)) for x in wins for j in range(len(w) - len(x) + 1) if tuple(w[j : j + len(x)]) == x]
                hit |= {j + d for j, n in at for d in range(n)}
                found += [str(100 + k)] * bool(at)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, ["a", None]), none).collect()
    assert [r.contaminated for r in got] == [False, False]
    assert decontaminate.decontaminate(docs(spark, []).where("false"), none).count() == 0


def test_decontamination_by_items_without_id(spark):
    passage = "one two three four five"
    bench = spark.createDataFrame([(None, passage), (7, "three four"), (None, "six seven")], "item_id long, text string")
    for limit in (1 << 20, 5):
        r = decontaminate.decontaminate(docs(spark, [f"x {passage} six seven"]), bench, max_bytes=limit).first()
        assert (r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (7, 2, True, hashlib.sha256(b"7").hexdigest())


# --- quality


def brute_quality(t):
    t = t or ""
    w = SPACED.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated)


def test_quality_base_equals_brute_force(spark):
    texts = random_texts(4, 150, ["a", "b", "cc", "###", "É x", "<b>", "word word"]) + ODD
    got = {r.doc_id: r for r in quality.score_quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), repr(t)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert quality.score_quality(docs(spark, []).where("false")).count() == 0


def test_em_finds_the_good_rules():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.7
    right = np.array([0.9, 0.85, 0.8, 0.55])
    votes = np.where(r.random((4000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[r.random(votes.shape) < 0.2] = 0
    prior, table = quality.fit_votes(votes, np.ones(len(votes)))
    assert abs(prior - 0.7) < 0.05
    assert (((quality.posterior(votes, prior, table) > 0.5) == truth).mean()) > 0.9


# --- language


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.97


def test_language_of_odd_rows(spark):
    texts = ["der die und das ist nicht " * 9, "the and of that is not " * 9]
    rows = [(i, texts[i % 2], ["de", "en"][i % 2]) for i in range(40)] + [(100, None, "en"), (101, "123 !!", None), (102, "", "de"), (103, "Der und das", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[d].lang_pred for d in (100, 101, 102, 103)] == ["und", "und", "und", "de"] and got[100].score == 0
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(bare).first().lang_pred == "und" and langid.identify(bare.where("false")).count() == 0
    assert {r.doc_id for r in langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {*range(40), 103}


def test_ngrams_are_counted_exactly():
    text = "Ab ab!é 1 b"
    flat = " ab ab é b "
    want = Counter(flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1))
    del want[" "]
    grams, counts = langid.ngrams(text)
    assert dict(zip(grams.tolist(), counts.tolist())) == {sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)): n for g, n in want.items()}


# --- pages


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<html><head><title>t</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><div class='ad'>Buy</div><article><h1>Head</h1><p><b>One<br><p>Two &lt;x&gt;  three\n four<p>Five</article><aside>Side</aside><div id=comments><p>First!</div><footer>Foot</footer>", "Head\nOne\nTwo <x> three four\nFive"),
    ("<body><div class='cookie-notice'>Cookies</div><form><p>Name<input></form><div><p>" + "long text " * 20 + "<p>" + "more text " * 20 + "</div>", ("long text " * 20).strip() + "\n" + ("more text " * 20).strip()),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_main_text_keeps_the_whole_article():
    p = lambda k, n: f"{k} " + "long text " * (n // 8)
    lines = lambda html: html_text.main_text(html).split("\n")
    para = lambda k, n: f"<p>{p(k, n)}</p>"
    sections = f"<h1>Head</h1>{para('intro', 200)}<section>{''.join(para(f'a{k}', 120) for k in range(3))}</section><section>{''.join(para(f'b{k}', 200) for k in range(5))}</section><blockquote>quoted</blockquote><pre>code</pre>"
    want = ["Head", "intro", "a0", "a1", "a2", "b0", "b1", "b2", "b3", "b4", "quoted", "code"]
    menu = "<div><a href=/a>One</a> <a href=/b>Two</a></div>"
    for before, after in (("<article>", "</article>"), ("<div>", "</div>"), ("<div class='has-sidebar'><article>", "</article></div>"), ("<div class='sidebar'><article>", "</article></div>"), ("<div class='sidebar'>", "</div>")):
        assert [x.split()[0] for x in lines(f"<body>{menu}<div class='main-nav'>Menu</div>{before}{sections}{after}<div id=comments>Talk</div></body>")] == want, before
    items = "".join(f"<li>item {k} " + "word " * 12 for k in range(30))
    got = lines(f"<body><article><h1>Head</h1>{para('p', 100)}<ul>{items}</ul><table><tr><td>cell<td>other</table>{para('q', 100)}</article></body>")
    assert len(got) == 35 and [x.split()[0] for x in (*got[:3], *got[-3:])] == ["Head", "p", "item", "cell", "other", "q"]


def test_pages_equal_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r.html for r in df.collect()}
    from html import unescape

    for r in html_text.extract(df).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


# --- language-model scores


def test_lm_gradient_and_distribution():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm_score.split_parameters(lm_score.first_parameters()).items()}
    context = r.integers(0, lm_score.VOCAB, (4, 1))
    every = lm_score.log_probs(p, np.arange(lm_score.VOCAB), np.repeat(context, lm_score.VOCAB, axis=1))
    assert np.exp(every).sum() == pytest.approx(1)
    targets, context = r.integers(0, 50, 300), r.integers(0, 50, (4, 300))
    before = lm_score.log_probs(p, targets, context).mean()
    # AdaGrad's first step is the sign of the gradient; the sums of squares hold its size.
    grad2 = {k: np.zeros_like(v) for k, v in p.items()}
    lm_score.train_step({k: v.copy() for k, v in p.items()}, grad2, targets, context)
    for name, at in (("embed", (targets[0], 3)), ("place", (1, 2)), ("bias", (5,)), ("cls", (1, 4)), ("cls_bias", (0,)), ("out", (targets[1], 1)), ("out_bias", (targets[2],))):
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-5
        slope = (lm_score.log_probs(moved, targets, context).mean() - before) / 1e-5
        assert np.sqrt(grad2[name][at]) == pytest.approx(abs(slope), rel=1e-3, abs=1e-9), name
    grad2 = {k: np.zeros_like(v) for k, v in p.items()}
    for _ in range(40):
        lm_score.train_step(p, grad2, targets, context)
    assert lm_score.log_probs(p, targets, context).mean() > before + 1


def test_lm_prefers_order(spark):
    r = random.Random(0)
    line = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(line[k % 10] for k in range(s, s + 60)) for s in (r.randrange(10) for _ in range(400))]
    shuffled = [" ".join(r.sample(t.split(), 60)) for t in texts[:20]]
    got = {r.doc_id: r for r in lm_score.score_text(docs(spark, texts + shuffled + [None, ""])).collect()}
    assert got[420].n_tokens == 0 and got[420].log_prob == 0 and got[421].score is None
    assert min(got[i].score for i in range(400)) > max(got[i].score for i in range(400, 420))
    one = lm_score.windows([np.array([7, 8], np.uint16), np.array([9], np.uint16)])
    assert one[0].tolist() == [7, 8, 9] and one[1].T.tolist() == [[0, 0, 8, 0], [0, 7, 0, 0], [0, 0, 0, 0]]


def test_lm_trains_on_every_row(spark):
    for doc_id in [*range(8), None]:
        df = spark.createDataFrame([(doc_id, "one two three " * 20)], "doc_id long, text string")
        assert not np.array_equal(lm_score.fit(df).flat, lm_score.first_parameters()), doc_id


def test_lm_equals_brute_force_whatever_the_partitions(spark, monkeypatch):
    """Scores by a plain reading of the definition, in one thread, with the averages over shards."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 400)
    monkeypatch.setattr(lm_score, "KNOWN", lm_score.WORDS + 300)
    r = random.Random(5)
    texts = [" ".join(f"Wö{int(r.paretovariate(0.4)) % 5000}" for _ in range(r.randrange(60))) for _ in range(120)] + [None, "", "lone", "lone", "x-y, Z"]
    rows = [r.sample(list(enumerate(texts)), len(texts)), list(enumerate(texts))]
    got = [{x.doc_id: x for x in lm_score.score_text(spark.createDataFrame(g, "doc_id long, text string").repartition(n)).collect()} for g, n in zip(rows, (1, 7))]
    assert all(got[0][d].log_prob == pytest.approx(got[1][d].log_prob, rel=1e-6) for d in range(len(texts)))
    counts = {}
    for t in texts:
        for w in alnum_words(t):
            counts[w] = counts.get(w, 0) + 1
    order = sorted(counts, key=lambda w: (-counts[w], w))[: lm_score.WORDS]
    token = {w: 1 + lm_score.BUCKETS + k for k, w in enumerate(order)}
    bucket = lambda w: 1 + lm_score.word_key(w) % lm_score.BUCKETS
    totals = {}
    for w, n in counts.items():
        if w not in token:
            totals[bucket(w)] = totals.get(bucket(w), 0) + n
    model = lm_score.fit(spark.createDataFrame(rows[1], "doc_id long, text string"))
    p = {k: v.astype(np.float64) for k, v in lm_score.split_parameters(model.flat).items()}
    for doc, text in enumerate(texts):
        words, want = alnum_words(text), 0.0
        ids = [token.get(w) or bucket(w) for w in words]
        line = [0, 0, *ids, 0, 0]
        for k, (w, i) in enumerate(zip(words, ids)):
            around = [line[k], line[k + 1], line[k + 3], line[k + 4]]
            hidden = sum(p["embed"][a] * p["place"][j] for j, a in enumerate(around)) + p["bias"]
            c, o = divmod(i, lm_score.CLASS_SIZE)
            for logits, at in ((p["cls"] @ hidden + p["cls_bias"], c), (p["out"][c * lm_score.CLASS_SIZE :][: lm_score.CLASS_SIZE] @ hidden + p["out_bias"][c * lm_score.CLASS_SIZE :][: lm_score.CLASS_SIZE], o)):
                want += logits[at] - np.log(np.exp(logits).sum())
            if w not in token:
                want += np.log(counts[w] / totals[bucket(w)])
        assert got[0][doc].n_tokens == len(words) and got[0][doc].log_prob == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_lm_tells_rare_words_apart(spark):
    common = " ".join(f"w{k}" for k in range(lm_score.WORDS))
    bucket = lambda w: lm_score.word_key(w.encode()) % lm_score.BUCKETS
    a, b = [w for k in range(9999) if bucket(w := f"junk{k}") == 0][:2]
    got = {r.doc_id: r for r in lm_score.score_text(docs(spark, [common] * 4 + [a, b, a, a])).collect()}
    # One word without neighbours each: a makes 3 of the bucket's 4.
    assert len(got) == 8 and got[4].log_prob == got[6].log_prob
    assert got[4].log_prob - got[5].log_prob == pytest.approx(np.log(3))
    key = spark.createDataFrame([(bytearray("Aé日".encode()),)], "w binary").selectExpr("xxhash64(w) AS k").first().k
    assert lm_score.word_key("Aé日".encode()) == key == lm_score.word_keys(pa.array(["Aé日".encode()]))[0]


# --- toxicity


def toxic_rows(n=1500):
    r = random.Random(7)
    clean = [f"w{k}x" for k in range(200)]
    rows, labels, place = [], [], {}
    for i in range(n):
        sents = [" ".join(r.choice(clean) for _ in range(8)) + "." for _ in range(r.randrange(1, 30))]
        bad = r.random() < 0.15
        if bad:
            k = r.randrange(len(sents))
            sents[k] = f"you {r.choice(['foolx', 'scoundrelish', 'scoundrelry'])} " + sents[k]
            place[i] = k
        rows.append((i, " ".join(sents)))
        labels.append((i, int(bad)))
    return rows, labels, place


def test_toxicity_learns_words_from_documents(spark):
    rows, labels, place = toxic_rows()
    df = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.98
    assert got[9000].predicted == 0 and 0 <= got[9001].score < 0.1
    model = toxicity.train(df, lab)
    found = toxicity.sentences(df, model).collect()
    assert len({r.doc_id for r in found} & set(place)) > 0.95 * len(place)
    text = dict(rows)
    assert all("foolx" in text[r.doc_id][r.start : r.end] or "scoundrel" in text[r.doc_id][r.start : r.end] for r in found)
    kept = {r.doc_id for r in toxicity.keep_civil(df, lab).collect()}
    assert len(kept & set(place)) < 0.05 * len(place) and {9000, 9001} <= kept


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-300 and r.predicted == 0 for r in toxicity.score_toxicity(df, none).collect())


def test_words_equal_the_pattern():
    for t in random_texts(9, 50, ["Aé", "0-9", "`{}~", "\x7f", "Ünï", "日 本"]) + ODD:
        assert [w.decode() for w in alnum_words(t)] == words(t)
