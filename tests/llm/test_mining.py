"""Collocations, secrets and periodic runs against plain versions, and on nulls, empty texts, ties and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import phrases, runs, secret_scan

SCHEMA = "doc_id long, text string, lang string, n long, print long, key long, text_at long, held int, base string"


def table(spark, rows):
    """Rows (doc_id, text, lang) with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, 1, 2, 3, 4, 5, "6") for i, t, g in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, top, covered):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: n for p, n in c.items() if n >= least}
        found = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            longer = [n for q, n in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * n >= covered * a for n in longer):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(7)
    vocabulary = ["the", "of", "Machine", "learning", "deep", "é", "日本", "x", "naïve", "new", "york", "times", "a-b"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!"]) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            text += " New York times said NEW york Times"
        rows.append((i, text, rng.choice(["en", "en", "de", "und", None])))
    return [*rows, (5, None, "en"), (None, "", "fr"), (None, "new york times " * 3000, "zh"), (9, ". , !", None), *rows[:10]]


@pytest.mark.parametrize("bits", [64, 7])
@pytest.mark.parametrize("least, top, covered", [(4, 2000, 80), (30, 5, 50)])
def test_collocations_equal_counts_of_text(spark, prose, bits, least, top, covered):
    got = phrases.collocations(table(spark, prose), least, top, covered, salts=3, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain_collocations(prose, least, top, covered)


def test_colliding_fingerprints_are_told_apart(spark, prose):
    found, totals = phrases.frequent_phrases(table(spark, prose), least=2, bits=5)
    want = Counter()
    for _, text, lang in prose:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert {(r["lang"], r["phrase"]): r["n"] for r in found.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert found.count() == sum(n >= 2 for n in want.values())
    assert {r["lang"]: r["n"] for r in totals.collect()} == {g: sum(n for (h, p), n in want.items() if h == g and " " not in p) for g in {h for h, _ in want}}


def test_scores_pass_64_bits(spark):
    """Counts are long; the products of the score and of the cover are decimal."""
    a = 5 * 10**15
    got = spark.sql(f"select 2000000 * cast({a}L as decimal(25, 0)) div (cast({a + 1}L as decimal(25, 0)) + {a + 7}L) as s").first()["s"]
    assert got == 2000000 * a // (2 * a + 8)


def test_collocations_of_nothing(spark, prose):
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [(1, None, None), (2, "", "en")])).collect() == []


FORMS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
KEEP = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}


def plain_base(text):
    return sorted(((m.start(), o, m.end(), k, m) for o, (k, p) in enumerate(FORMS.items()) for m in p.finditer(text) if KEEP[k](m)), key=lambda s: s[:3])


def plain_secrets(rows):
    texts = [t or "" for _, t, _ in rows]
    strings = set()
    for t in texts:
        strings |= {(m[2] if k == "assign" else m[0], True) for *_, k, m in plain_base(t)}
        rest = FORMS["assign"].sub(" ", t)
        rest = re.sub("[0-9a-f]{24,}", " ", re.sub("AKIA[A-Z0-9]{16,}", " ", rest))
        strings |= {(s, False) for s in re.findall("[A-Za-z0-9+/_=-]{6,}", rest) if re.search("[A-Za-z]", s)}
    pairs = {label: Counter(s[i : i + 2] for s, x in strings if x == label for i in range(len(s) - 1)) for label in (True, False)}
    first = {label: Counter() for label in pairs}
    for label, c in pairs.items():
        for p, n in c.items():
            first[label][p[0]] += n

    def p(label, pair, weight):
        of = first[label][pair[0]]
        return (weight * (max(pairs[label][pair] - (0 if label else 5), 0) / of) if of else weight / 66) + (1 - weight) / 66

    out = []
    for (i, _, _), t in zip(rows, texts, strict=True):
        base = plain_base(t)
        added = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t):
            score = sum(math.floor(1000 * math.log(p(True, m[0][j : j + 2], 0.5) / p(False, m[0][j : j + 2], 0.99)) + 0.5) for j in range(len(m[0]) - 1))
            free = all(m.end() <= s or e <= m.start() for s, _, e, *_ in base)
            if free and re.search("[A-Za-z]", m[0]) and score >= 14_000 and score >= 1_000 * (len(m[0]) - 1):
                added.append((m.start(), 3, m.end(), "random"))
        written = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k, *_ in spans)
        n = Counter(s[3] for s in base)
        digest = hashlib.sha256(written(base).encode()).hexdigest()
        out.append((i, n["assign"], n["access"], n["hex"], len(added), digest, written(sorted([b[:4] for b in base] + added))))
    return out


@pytest.fixture(scope="module")
def secrets():
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["The", "configuration", "of", "deployment", "machines", "übergröße", "日本語", "documentation", "environment-variables", "interoperability", "🎈"]
    words += ["".join(rng.choice(["ti", "on", "er", "the", "sh", "and", "ing", "or", "ble"]) for _ in range(rng.randint(3, 8))) for _ in range(1500)]
    alike = ["".join(rng.choice(pair) for _ in range(9)) for pair in zip(letters, letters[1:] + "A", strict=True)]
    words += [w.upper() for w in words[::3]] + [f"{w}{j % 100}" for j, w in enumerate(words[::5])] + alike
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    some = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for i in range(60):
        kind = [
            f'TOKEN = "{some("0123456789abcdef", 40)}"', f"password:{some(letters, 9)}", f"AKIA{some('ABCDEFGHIJ234567', 16)}", some("0123456789abcdef", 30), some(letters, 40),
            "Api_Key:abc", "api_key='abcdefg' passwd=short", "AKIASHORT", "4413051069786354", "x" * 30,
        ][i % 10]
        rows.append((i, f"{say(60)} {kind} {say(rng.randint(0, 9))}", "en"))
    many = " ".join(f"é token={some('0123456789abcdef', 24)}" for _ in range(600))
    return [*rows, (3, None, None), (None, "", "en"), (3, many, "en"), (70, "toKen=abcdefgh ſecret=abcdefgh", "en"), (71, "token=token=abcdef secret==x AKIA" + "A" * 50, "en"), *rows[:7]]


def test_secrets_equal_plain_patterns_and_models(spark, secrets):
    got = secret_scan.scan(table(spark, secrets)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_secrets(secrets)))
    assert sum(r["n_random"] for r in got) >= 4  # most of the strings of forty letters that no form names
    assert all(r["n_random"] == 0 for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 10 != 4)


def test_secrets_of_nothing_and_of_few_labels(spark):
    assert secret_scan.scan(table(spark, [])).collect() == []
    digest = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in secret_scan.scan(table(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0, 0, digest, "")]
    one = secret_scan.scan(table(spark, [(1, "plain words of everyday language and ordinary identifiers " * 4 + "qX7vB2kR9tLm4ZpW8sYd", None)])).first()
    assert one["n_assign"] == one["n_hex"] == 0 and one["n_random"] in (0, 1)


def test_secret_scan_stays_in_the_jvm(spark, secrets):
    scores = [0] * (128 * 128)
    plan = secret_scan.scan(table(spark, secrets), scores)._jdf.queryExecution().executedPlan().toString()
    counts = secret_scan.transitions(secret_scan.labelled_strings(table(spark, secrets)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan + counts for word in ("Python", "Arrow", "Pandas", "Join"))


def plain_runs(w, least, times):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, times * q))


def random_words(rng):
    k, n = rng.choice([1, 2, 3, 30]), rng.choice([0, 0, 1, 5, 40, 120])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        p, a = rng.randint(1, 8), rng.randrange(n)
        for i in range(a, n):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("step", [3, runs.STEP])
def test_runs_equal_all_periods(monkeypatch, step):
    monkeypatch.setattr(runs, "STEP", step)
    rng = random.Random(step)
    for _ in range(80):
        texts = [random_words(rng) for _ in range(rng.randint(1, 12))]
        n = np.array([len(t) for t in texts])
        end = np.cumsum(n)
        least, times = rng.choice([(6, 4), (2, 2), (3, 3)])
        text, *rest = runs.find_runs(np.array([c for t in texts for c in t], np.int64), end - n, end, least, times)
        got = [[] for _ in texts]
        for t, *run in zip(text.tolist(), *(x.tolist() for x in rest), strict=True):
            got[t].append(tuple(run))
        assert got == [plain_runs(t, least, times) for t in texts]


def plain_digest(doc_id, text, planted):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w, 6, 4)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("planted", [True, False])
@pytest.mark.parametrize("limit", [200, runs.SLICE_BYTES])
def test_run_digests_equal_a_plain_version(spark, monkeypatch, planted, limit):
    monkeypatch.setattr(runs, "SLICE_BYTES", limit)
    rng = random.Random(5)
    glue = [" ", "\n", "\t ", "\r\n", "\x0b"]
    word = lambda c: f"w{c}" if c % 3 else f"é\x1c\x85\xa0{c}"
    rows = [(i, "".join(word(c) + rng.choice(glue) for c in random_words(rng)), "en") for i in range(150)]
    rows += [(None, "a b " * 40, "en"), (7, None, None), (7, "", "en"), (8, " \n\t", "en"), (9, "same " * 3000, "en"), *rows[:5]]
    got = runs.periodic_runs(table(spark, rows), planted=planted).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_digest(i, t, planted)) for i, t, _ in rows)
    assert runs.periodic_runs(table(spark, []), planted=planted).collect() == []
