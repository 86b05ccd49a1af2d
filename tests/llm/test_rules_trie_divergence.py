"""Quality rules, the conversation trie and the divergence audit against brute force, on small hostile fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tokenloom.llm import divergence, quality, trie

# -- 11 ---------------------------------------------------------------------------------------------------------------

GAP = "\x20\x09-\x0d"


def brute_rules(text):
    text = text or ""
    words = re.findall(f"[^{GAP}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{GAP}]", x)]
    runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n, chars, signs, again = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    letters = sum(c.isalpha() for c in text)
    bad = 10 * signs > n or chars < 2 * n or chars > 20 * n or 2 * again > len(lines) or 10 * letters < 6 * chars or 2 * text.count("!") > n
    return n, chars, signs, again, len(covered), failed, not failed and not bad


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    clean = lambda n: " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(3, 8))) + rnd.choice(["", "", ".\n", ","]) for _ in range(n))
    out = [clean(n) for n in (10, 49, 50, 51, 80, 300, 3000)]
    out += [None, "", " \t\x0b\n", "x" * 5000, "a " * 400, "a b c " * 200, clean(60) + " #" * 20, clean(60) + "!" * 50, "one two\n" * 3 + clean(60), (clean(20) + "\n") * 6]
    out += ["1234 5678 " + " ".join(str(rnd.random()) for _ in range(60)), "a b " + clean(70) + " a b c a b", "ab cd e f\x0cgh " * 3 + clean(90), clean(60).replace(" ", "\r")]
    return out


def test_quality(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[4]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __words", "2 as kept", "3 as `n.words`").repartition(3)
    want = sorted(((i, *brute_rules(t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in quality.score_rules(df).collect()), key=str) == want
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[-1])
    assert quality.score_rules(df.limit(0)).collect() == [] == quality.keep_good(df.limit(0)).collect()


def test_order_of_rules(spark, texts):
    """Most rejections per cost first; what is measured already is free; the order changes no verdict."""
    a, b, c = (quality.Rule(n, u, lambda m: m("n_words") < 0) for n, u in (("a", ("n_words",)), ("b", ("lines",)), ("c", ("n_words", "n_shouts"))))
    seconds = {"words": 1.0, "n_words": 0.0, "lines": 0.5, "n_shouts": 0.1}
    rejected = [(True, False, True), (False, True, False), (True, False, True), (False, False, True)]
    got = quality.greedy([a, b, c], rejected, seconds)
    assert [e.rule.name for e in got] == ["c", "b", "a"] and [round(e.rejects, 2) for e in got] == [0.75, 1, 0]
    assert [e.rule.name for e in quality.greedy([a, b, c], rejected, seconds, ["words", "n_words"])] == ["a", "c", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F

    verdicts = [
        [r["by"] is None for r in quality.judged(df, F.coalesce("text", F.lit("")), order, "by").orderBy("text").collect()] for order in (quality.RULES, quality.RULES[::-1])
    ]
    assert verdicts[0] == verdicts[1] and any(verdicts[0]) and not all(verdicts[0])
    sampled = quality.order_rules(df, sample_rows=5, seconds=seconds)
    assert {e.rule.name for e in sampled} == {r.name for r in quality.RULES}


# -- 12 ---------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = (turns.get(c - c % 5, [])[:h] if c >= 0 else turns.get(c + -c % 5, [])[:h]) + own[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def below(p):
        leaves, saved = 0 if children[p] else 1, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in children[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if paths:
        below(())
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    rnd = random.Random(2)
    rows = []
    for c in [*range(0, 60), 1001, 1003, -7, -5, 2000]:
        for t in range(rnd.randint(1, 12)):
            rows.append((c, t if t else None, rnd.choice(["user", None]), rnd.choice(["a", "bé", None, "", "long text " * 9])))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]
    rows += [(c, t, "u", "x") for c in (300, 305, 310) for t in range(9 + c % 7)]
    rows += [(None, 0, "user", "nobody"), (400, None, None, None)]
    return rows


@pytest.mark.parametrize(("block", "ids"), [(4096, 10), (2, 1)])
def test_trie(spark, monkeypatch, block, ids):
    """Nulls, repeated conversations, deep shared paths, absent bases; the same with windows and groups of two."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", ids)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as k1").repartition(3)
    got = trie.conversation_trie(df).select(*TRIE)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    for rows in ([], [(7, 1, "user", "hello")], [(None, 1, "a", "b")], [(5, 1, "user", "x"), (6, 1, "user", "x")]):
        got = trie.conversation_trie(spark.createDataFrame(rows, schema)).select(*TRIE)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


# -- 13 ---------------------------------------------------------------------------------------------------------------


def brute_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        held = Counter(t for _, _, w in mine for t in set(w))
        terms = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        kept, v = set(terms), len(terms)
        groups = defaultdict(Counter)
        for _, s, w in mine:
            groups[s].update(t for t in w if t in kept)
        whole = sum(groups.values(), Counter())
        p = lambda c, t, v=v: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(sum(f(p(groups[s], t), p(groups[o], t)) for t in terms), o) for o in groups if o != s]
            tells = [(f(p(groups[s], t), p(whole, t)), t) for t in terms if groups[s][t] and p(groups[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", tells, ranks)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def divergent():
    rnd = random.Random(3)
    words = [a + b for a in "abcdeé中" for b in ("", "x", "xy", "é", "zz")]
    rows = []
    for k in range(300):
        s = f"s{k % 7}" if k % 3 else "hot"
        rows.append((rnd.choice(["en", "de", None]), s, " ".join(rnd.choice(words[(k % 7) * 2 :]) + rnd.choice(["", ".", "1", " And"]) for _ in range(rnd.randint(0, 40)))))
    rows += [("en", "rare", "tied" + c + " only") for c in "abcdefghijklmnop" for _ in range(3)]
    return [*rows, ("fr", "a", None), ("fr", "b", ""), ("it", None, "alone"), (None, None, "A" * 30000), ("en", "hot", "\x00 1 --")]


@pytest.mark.parametrize(("block", "kept", "digit"), [(64, 100, 10), (2, 0, 10)])
def test_divergence(spark, monkeypatch, block, kept, digit):
    """Nulls, ties, languages without terms and with one source; the same with blocks of two sources and all digits counted."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SORTED", kept)
    monkeypatch.setattr(divergence, "DIGIT", digit)
    monkeypatch.setattr(divergence, "MET", 64)
    monkeypatch.setattr(divergence, "BUCKET", 50)
    rows = divergent()
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as value").repartition(3)
    got = [tuple(r) for r in divergence.divergence_audit(df, least_docs=3, ranks=10).collect()]
    assert sorted(got) == brute_divergence(rows, 3, 10)
    assert divergence.divergence_audit(df.limit(0)).collect() == []
