"""The text operators against plain versions on small tables, and on nulls, empty texts, ties and empty tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from barloom.llm import bpe, compression, licences, mixing, passages, quality_rules, resharding, token_store, topk
from barloom.llm.jaccard import jaccard_components
from barloom.llm.queries import tokenizer_path
from barloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, shard int, label int, n long, node long, size long"


def table(spark, rows):
    """Rows (doc_id, text, source) with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 3, 4, 5) for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 120)), f"s{i % 4}") for i in range(60)]
    for i in range(40):
        rows.append((60 + i, edited(rng, rows[i][1], rng.randint(0, 4)), None if i % 5 == 0 else "s1"))
    base = prose(rng, 90)
    rows += [(100 + i, edited(rng, base, 3), "hot") for i in range(30)]
    passage = prose(rng, 70)
    rows += [(140 + i, f"{prose(rng, 30)} {passage}\n{prose(rng, 20)}", "s2") for i in range(5)]
    rows += [(150, rows[3][1], "s0"), (150, rows[3][1], "s0"), (151, "", "s0"), (152, None, "s0"), (153, " \n\t", "s0"), (None, rows[3][1], "s0"), (None, None, None)]
    rows += [(154, "one two", "s0"), (155, "ONE two", "s0"), (156, "word " * 5000, "s3"), (157, "Ünïcode ‑ 日本語 🎈 text's end", "s3"), (158, "Licensed under the Apache License, Version 2.0.", "s3")]
    return rows


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, corpus, width, percent):
    sets = [shingles(t, width) for _, t, _ in corpus]
    part = list(range(len(corpus)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(corpus)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and corpus[a][0] is not None and corpus[b][0] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                part[find(a)] = find(b)
    low = {}
    for a, (i, _, _) in enumerate(corpus):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    want = sorted((i, len(sets[a]), low[find(a)]) for a, (i, _, _) in enumerate(corpus) if i is not None)
    got = [tuple(r) for r in jaccard_components(table(spark, corpus), width, percent).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    # a null id takes the component of equal texts
    assert sorted((r[1], r[2]) for r in got if r[0] is None) == [(0, None), (len(sets[3]), low[find(3)])] or sorted(((r[1], r[2] or -1) for r in got if r[0] is None)) == [(0, -1), (len(sets[3]), low[find(3)])]


def test_tiles_are_blocked_without_losing_pairs(spark, monkeypatch):
    from barloom.llm import jaccard

    rng = random.Random(8)
    base = prose(rng, 60)
    rows = [(i, edited(rng, base, rng.randint(1, 3)) + " " + prose(rng, rng.randint(0, 8)), "s") for i in range(80)]
    want = [tuple(r) for r in jaccard_components(table(spark, rows)).orderBy("doc_id").collect()]
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert [tuple(r) for r in jaccard_components(table(spark, rows)).orderBy("doc_id").collect()] == want
    assert len({r[2] for r in want}) < len(rows)


def test_token_store_round_trip(spark, corpus, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "FRAME_BYTES", 2000)
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = corpus + [(159, "don't <|endoftext|> we'll, x.y!'s <|startoftext|>", "s"), (160, "Case CASE case <|ENDOFTEXT|> ÉCOLE école", "s"), (161, "ONE One one", "s")]
    files = token_store.write_tokens(table(spark, rows), path, Scratch(spark, "t").path("ids"), end_id=1)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, (rows[k][1] or "").encode()))
    want, start = [], 0
    for k in order:
        ids = plain.encode(rows[k][1] or "", add_special_tokens=False).ids + [1]
        want.append((rows[k][0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    got = sorted((tuple(r) for r in token_store.read_digests(files).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    few = {r["doc_id"]: r["ids"] for r in token_store.read_tokens(files, wanted=[157, 20]).collect()}
    assert few == {w[0]: w[4] for w in want if w[0] in (157, 20)}


def test_readers_open_only_the_frames_they_need(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_BYTES", 2000)
    rng = np.random.default_rng(1)
    docs = [(k if k % 7 else None, rng.integers(0, 50000, int(rng.integers(0, 300))).astype("<u4").tobytes()) for k in range(200)]
    with open(tmp_path / "x.ids", "wb") as f:
        writer = token_store.Writer(f)
        for k, ids in docs:
            writer.add(k, ids)
        writer.close()
    reader = token_store.Reader(str(tmp_path / "x.ids"))
    assert [raw for _, raw in reader.documents()] == [raw for _, raw in docs] and len(reader.frames) > 20
    opened, plain = [], reader._frame
    reader._frame = lambda k, skip=0: opened.append(k) or plain(k, skip)
    wanted = [3, 4, 150, 7]
    assert [(int(reader.doc_ids[i]), raw) for i, raw in reader.documents(wanted)] == [(k, docs[k][1]) for k in (3, 4, 150)]
    assert len(opened) <= 3
    reader.frames = reader.frames.copy()
    reader.frames[0, 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        next(reader.documents([1]))


def test_empty_tables(spark):
    empty, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert jaccard_components(empty).count() == 0
    assert token_store.read_digests(token_store.write_tokens(empty, tokenizer_path("word_bpe_49k.json"), Scratch(spark, "t").path("ids"), 1)).count() == 0
    assert passages.repeated_passages(empty).count() == 0 and passages.without_repeats(empty).count() == 0
    assert compression.score(empty, compression.fit(empty, labels.withColumnRenamed("quality", "label"))).count() == 0
    assert quality_rules.quality_rules(spark, empty, labels).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert bpe.encode_digests(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert resharding.reshard_digests(empty.withColumn("__old", resharding.F.lit(0))).count() == 0
    assert licences.scan(empty).count() == 0
    v = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.top_k(v, v).count() == 0


def test_compact_windows_are_the_wide_subtrees():
    rng = np.random.default_rng(1)
    for n, t in ((5, 3), (60, 7), (400, 46)):
        h = rng.integers(1, 1 << 50, n).astype(np.uint64)
        want, todo = set(), [(0, n - 1)]
        while todo:
            a, b = todo.pop()
            if b - a + 1 >= t:
                c = a + int(np.argmin(h[a : b + 1]))
                want.add((a, c, b))
                todo += [(a, c - 1), (c + 1, b)]
        assert {*zip(*(x.tolist() for x in passages.compact_windows(h, t)), strict=True)} == want


def test_repeated_passages(spark, corpus):
    found = passages.repeated_passages(table(spark, corpus)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    text = {i: t for i, t, _ in corpus if i is not None}
    # every window of 50 words that an earlier document has is inside a passage found; members of the group of near
    # copies are left out, as they are compared with the first of their windows alone
    assert len(set(by) & {*range(100, 130)}) > 2
    seen = {}
    for i in sorted(set(text) - {*range(100, 130)}):
        w = WORD.findall((text[i] or "").lower())
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if seen.setdefault(key, i) != i:
                assert any(r["start_word"] <= k and k + 50 <= r["end_word"] for r in by[i]), (i, k)
    for r in found:
        a, b = (WORD.findall(text[d].lower())[s:e] for d, s, e in ((r["doc_id"], r["start_word"], r["end_word"]), (r["first_doc_id"], r["first_start"], r["first_end"])))
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and r["similarity"] == len(x & y) / len(x | y) >= 0.8 and r["first_doc_id"] < r["doc_id"]
    assert {141, 142, 143, 144} <= set(by) and not set(by) & {*range(60), 154, 155, 156, 157}


def test_cutting_passages(spark, corpus):
    out = passages.without_repeats(table(spark, corpus))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    text = {i: t for i, t, _ in corpus}
    assert out.columns == table(spark, []).columns and got[140] == text[140] and got[151] == "" and got[152] is None
    # the cut may take a few equal words more on either side, never less than the passage
    a, b = WORD.findall(text[141]), WORD.findall(got[141])
    assert 48 <= len(b) <= 50 and b == a[:30][: len(b)] + a[100:][-(len(b) - 30) :]


def test_compression_scores_tell_labels_apart(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 2 else "".join(rng.choice("#$%&") for _ in range(20)) + " " + prose(rng, 60).upper(), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int").where(f"not ({compression.HELD_OUT})")
    model = compression.fit(table(spark, rows), labels)
    out = {r["doc_id"]: r for r in compression.score(table(spark, rows + [(900, None, "s"), (901, "", "s"), (None, "x", "s")]), model).collect()}
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 40 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values()) and out[900]["score"] == out[901]["score"]
    # without labels: one score for all
    none = compression.score(table(spark, rows[:5]), compression.fit(table(spark, rows), labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}


def test_top_k_equals_all_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-500, 500, 64).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(20)] + [(500, None), (501, [1, None]), (502, [0] * 64), (0, rows[0][1]), (503, [1, 2, 3]), (600, [3, 2, 1])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    clean = {(i, tuple(x)) for i, x in rows if x is not None and None not in x}
    for q, x in clean:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in clean if i != q and len(y) == len(x))[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_branch_and_bound_drops_nothing(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-1000, 1000, (64, 3000)) * (np.arange(64) < 20)[:, None]
    best = topk.Best(np.arange(7), m[:, :7], 10)
    best.see(np.arange(1500), m[:, :1500])
    best.see(np.arange(1500, 3000), m[:, 1500:])
    for i in range(7):
        s = m[:, i] @ m
        want = [int(k) for k in np.lexsort((np.arange(3000), -s)) if k != i][:10]
        assert best.found[i][0].tolist() == want


def plain_counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    cover = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)} if len(w) < 500 else set(range(len(w)))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_counts(spark, corpus):
    rng = random.Random(6)
    part = prose(rng, 9)
    rows = corpus + [(200, f"{part} x {part} {part}\n\na b\n a b\na b\n\n&&<>", "s"), (201, (part + " ") * 4, "s")]
    out = quality_rules.quality_rules(spark, table(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    want = sorted(((i is None, i or 0, *plain_counts(t)) for i, t, _ in rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in out)


def test_quality_score_learns(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 40) if i % 2 else " ".join(w + "***" for w in prose(rng, 40).split()), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    out = quality_rules.quality_rules(spark, table(spark, rows), labels).where("doc_id >= 200").collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 2 == 1) for r in out]) > 0.95


def test_mixing_targets_and_copies(spark, corpus):
    rows = [tuple(r) for r in mixing.mix(table(spark, corpus)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()]
    assert len(rows) == len(corpus)
    size = {}
    for _, t, s in corpus:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free = {s: 0.0 for s in names}, set(names)
    while True:
        left = 1.5 * sum(size.values()) - sum(target[s] for s in names if s not in free)
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            free.discard(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = dict.fromkeys(names, 0)
    for _, s, n, total, want, copies in rows:
        assert total == size[s] and want == pytest.approx(target[s]) and copies in (0, 1, 2)
        taken[s] += n * copies
    for s in names:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(t or "")) for _, t, x in corpus if x == s)
    out = mixing.mixed_documents(table(spark, corpus))
    assert out.columns == table(spark, []).columns and out.count() == sum(r[5] for r in rows)
    assert sorted(map(str, mixing.mix(table(spark, corpus)).collect())) == sorted(map(str, mixing.mix(table(spark, corpus)).collect()))


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(9)
    pool = ["a", "the", " ", "  ", "\n", "'s", "'ll", "é", "ß", "日本", " ", " ", "　", "1", "!!", "***", "<|endoftext|>", "<|endo", "\t", "ing", "aaaa", "́", "\x85", "​"]
    rows = corpus + [(1000 + i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 30))), "s") for i in range(300)]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(plain.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encode_digests(table(spark, rows), path).collect()) == sorted(want)
    full = bpe.encode(table(spark, rows[:80]), path).collect()
    assert {(r["doc_id"], r["decoded"]) for r in full} == {(i, t or "") for i, t, _ in rows[:80]}


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(11)
    for _ in range(30):
        n, m = rng.randint(1, 6), rng.randint(1, 5)
        supply = [rng.randint(0, 50) for _ in range(n)]
        demand = [sum(supply) // m + (j < sum(supply) % m) for j in range(m)]
        home = [i if i < m else None for i in range(n)]
        flow = resharding.min_cost_flow(supply, demand, home)
        assert all(sum(v for (i, _), v in flow.items() if i == k) == supply[k] for k in range(n))
        assert all(sum(v for (_, j), v in flow.items() if j == k) == demand[k] for k in range(m))
        # what can stay at most: the smaller of a shard's size and its place's capacity
        assert sum(v for (i, j), v in flow.items() if home[i] != j) == sum(supply) - sum(min(supply[i], demand[i]) for i in range(min(n, m)))


def test_resharding_law(spark, corpus):
    rng = random.Random(12)
    rows = corpus + [(2000 + i, prose(rng, rng.randint(1, 90)), "s") for i in range(600)] + [(3000 + i, "same text " * 30, "s") for i in range(200)]
    docs = table(spark, [r for r in rows if len(r[1] or "") < 2000]).withColumn("__old", resharding.F.expr("int(coalesce(doc_id, 0) % 20)"))
    out = resharding.reshard_digests(docs, 16).collect()
    text = {}
    for r in docs.select("doc_id", "text").collect():
        text.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    assert len(out) == docs.count() and {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    assert all(any(r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) for t in text[r["doc_id"]]) for r in out)
    load, slots = [0] * 16, [[] for _ in range(16)]
    for r in out:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots) and max(load) - min(load) <= max(r["size"] for r in out)


def test_unmoved_shards_keep_their_files(spark):
    rows = [(i, "x" * 50, "s") for i in range(64)]
    docs = table(spark, rows).withColumn("__old", resharding.F.expr("int(doc_id % 4)"))
    plan = resharding.Resharding(docs, 4, Scratch(spark, "t"))
    assert plan.moved == {} and plan.affected == []


def test_licences_equal_all_pairs(spark, corpus):
    pieces = [t for _, t in licences.TEMPLATES]
    rows = corpus + [(400 + i, f"Intro line.\n{t}\nmore words here", "s") for i, t in enumerate(pieces)]
    rows += [(430, "// Licensed under the MIT licence\n\nReleased under the mit license", "s"), (431, "permission software license " * 400, "s")]
    want = {}
    for i, t, _ in rows:
        for seg in {t or "", *(t or "").split("\n\n"), *(t or "").split("\n")}:
            g = set(licences.bigrams_of(seg))
            scores = [(2.0 * len(g & set(licences.bigrams_of(x))) / (len(g) + len(set(licences.bigrams_of(x)))), n) for n, x in licences.TEMPLATES] if g else []
            if scores and max(scores)[0] >= 0.8:
                d, n = max(scores)
                k = want.get((i, n), (0.0, 0))
                want[i, n] = (max(k[0], d), k[1] + 1)
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["segments"]) for r in licences.scan(table(spark, rows)).collect()}
    assert got == want and len(want) > len(pieces) - 3
    plan = licences.scan(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rates_are_tilted_by_size_and_of_least_entropy(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * (0 if i % 40 == 0 else int(rng.paretovariate(1.2) * 3))), "abc"[i % 3] if i % 7 else None) for i in range(600)]
    mixer = mixing.Mixer(table(spark, rows), (3, 1, 2), 1.5, 2.0)
    bars = mixer.rates().collect()
    for name in (None, "a", "b", "c"):
        own = [r for r in bars if (r["key"] if r["named"] else None) == name]
        m, x, got = (np.array([float(r[c]) for r in own]) for c in ("m", "size", "rate"))
        target = own[0]["target"]
        assert (m * x * got).sum() == pytest.approx(target, rel=1e-8)
        if target >= 2.0 * (m * x).sum():
            assert (got == 2.0).all()
            continue
        low, high = -50.0, 50.0
        rate = lambda b: 2.0 / (1.0 + np.exp(-b * x))
        for _ in range(200):
            b = (low + high) / 2
            low, high = (b, high) if (m * x * rate(b)).sum() < target else (low, b)
        assert np.allclose(got, rate(b), atol=1e-7) and np.ptp(got[x > 0]) > 1e-3
        assert (got[x == 0] == 1.0).all()
        entropy = lambda r: (m * (r * np.log(r) + (2 - r) * np.log(np.maximum(2 - r, 1e-300)))).sum()
        even = np.where(x > 0, target / (m * x).sum(), 1.0)
        assert entropy(got) < entropy(even)


def test_columns_that_clash_and_texts_under_one_id(spark):
    text, other = prose(random.Random(5), 390), prose(random.Random(6), 40)
    rows = [(0, text), (1, text + " " + prose(random.Random(7), 60)), (1, other), (1, other), (None, other)]
    names = ["__id", "__i", "__key", "__spans", "__body", "__c", "__n", "__copy", "body", "spans", "copies", "rows", "c0", "i"]
    docs = spark.createDataFrame([(i, t, "s", *range(len(names))) for i, t in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = passages.without_repeats(docs)
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert len(kept) == 5 and [t for _, t in kept].count(other) == 3 and (0, text) in kept
    twice = mixing.mixed_documents(docs, share=2.0)
    assert twice.columns == docs.columns and twice.count() == 10
