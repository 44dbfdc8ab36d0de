"""Operators against plain versions of the same definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm import components, encoding, jaccard, katz, packing, pii, quality_rules, queries, substrings, token_counts, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.vocabulary())


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "é" * 3000 + "<|endoftext|>"])
def test_ids_are_the_tokenizer_files(tokenizer, text):
    assert encoding.encoder(encoding.vocabulary())(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, sf_dir, texts, tokenizer):
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, parts in pieces.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert [s for _, s, _ in parts] == [sum(n for _, _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, _, n in parts) == len(ids[i])
        assert all(n == 2048 for _, _, n in parts[1:])
    assert pieces.keys() == ids.keys()
    for slots in places.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:k]) for k in range(len(slots))] and sum(n for _, n in slots) <= 2048
    assert len(places) <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1


def test_bins_close_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 9)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert bins.place(8) == (3, 0)  # bin 2, the fullest, closed
    assert bins.place(4) == (0, 6)


def test_the_bound_on_open_bins_binds():
    """Ten times as many pieces as open bins: bins do close, and hardly any room is lost."""
    draw = np.random.default_rng(6)
    lengths = np.minimum(draw.lognormal(6, 1.1, 20_000).astype(int) + 1, 2048)
    bins = packing.OpenBins(2048, packing.OPEN_BINS)
    for at in range(0, len(lengths), 2 * packing.OPEN_BINS):
        bins.place_run(lengths[at : at + 2 * packing.OPEN_BINS].tolist())
        assert bins.open <= packing.OPEN_BINS
    assert bins.closed > 100 and bins.made <= 1.01 * -(-int(lengths.sum()) // 2048)


def test_a_run_may_span_batches_and_tasks_split(spark):
    parts = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + id * 7919 % 2048 AS length", "id AS ids_crc32")
    rows = packing.best_fit(parts, 2048, open_bins=64, task_pieces=1200).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(5000)) and len({r["sequence_id"] >> 40 for r in rows}) == 5
    for slots in places.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:k]) for k in range(len(slots))] and sum(n for _, n in slots) <= 2048


def test_token_counts(spark, sf_dir, texts, tokenizer):
    lengths = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts.values())
    sums = queries.op10_token_counts(spark, sf_dir).cache()
    found = {r["n_tokens"]: r for r in sums.collect()}
    assert set(found) == set(lengths)
    for n, r in found.items():
        assert r["n_docs"] == lengths.count(n) and r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and r["total_docs"] == len(lengths) and r["docs_up_to"] == sum(x <= n for x in lengths)
    limits = [0, 1, 100, 777, 10**6]
    assert {r[0]: r[1] for r in token_counts.truncated_totals(sums, limits).collect()} == {k: sum(min(x, k) for x in lengths) for k in limits}
    got = {r[0]: r[1] for r in token_counts.quantiles(sums, [0.25, 0.5, 1.0]).collect()}
    assert got == {q: lengths[math.ceil(q * len(lengths)) - 1] for q in (0.25, 0.5, 1.0)}


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((*m.span(), kind))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_equal_plain_ones():
    draw = random.Random(5)
    for _ in range(5000):
        text = "".join(draw.choice("a@.@b1234 2-+().1é_\n") for _ in range(draw.randint(0, 40)))
        assert pii.strict_spans(text) == plain_spans(text)


def test_personal_data_of_every_document(spark, sf_dir, texts):
    rows = queries.op4_weak_supervision_pii(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]] or "")
        base = [f"{k}:{s}:{e}" for s, e, k in spans]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        whole = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(whole) and len(whole) == len(base) + r["n_added"]
        assert whole == sorted(whole, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
        some += len(base)
    assert some > 0


def test_the_span_classifier_sees_span_and_context():
    """Soft labels that follow the word before the span are learnt, for words not voted about as well."""
    draw = random.Random(8)
    number = lambda: f"{draw.randint(200, 999)}-{draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
    texts = [f"{draw.choice(['call', 'ring'] if k % 2 else ['order', 'part'])} {number()} ok" for k in range(400)]
    spans = [(t.index(" ") + 1, len(t) - 3, "phone") for t in texts]
    weights = pii.fit_spans([pii.span_features(t, s) for t, s in zip(texts, spans, strict=True)], np.array([0.9 if k % 2 else 0.1 for k in range(400)]))
    for word, wanted in (("call", True), ("ring", True), ("order", False), ("part", False)):
        text = f"{word} 305-555-2862 ok"
        assert pii.accepts(weights, pii.span_features(text, (len(word) + 1, len(text) - 3, "phone"))) == wanted


def test_personal_data(spark):
    text = "mail: joe@a.com or jane [at] foo [dot] com, call (305) 555-2862 or +1 (743) 555-3824, from 10.1.2.3; no 300.1.1.1"
    docs = spark.createDataFrame([(1, text), (2, "clean text 123 456")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    strict = pii.strict_spans(text)
    base = ",".join(f"{k}:{s}:{e}" for s, e, k in strict)
    assert rows[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_card"], rows[1]["n_phone"]) == (1, 1, 0, 1)
    assert set(base.split(",")) <= set(rows[1]["spans"].split(",")) and rows[1]["n_added"] == 2
    assert rows[2]["spans"] == "" and rows[2]["n_added"] == 0


def test_reliabilities_find_the_bad_labeller():
    draw, counts = random.Random(3), Counter()
    for _ in range(4000):
        truth = draw.random() < 0.5
        vote = lambda p: "+" if (draw.random() < p) == truth else "-"  # noqa: B023, E731
        counts["phone:" + vote(0.9) + vote(0.9) + vote(0.55) + vote(0.9) + "00"] += 1
    _, table, post = pii.reliabilities(counts)
    assert table[0][1][2] > 0.8 > table[2][1][2] and table[2][1][2] < 0.65
    assert post["phone:++-+00"] > 0.9 > 0.1 > post["phone:--+-00"]


def brute_components(texts, words, part, whole):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORDS.findall(t or "")]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and whole * len(a & b) >= part * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "part", "block"), [(3, 90, 512), (5, 80, 512), (5, 80, 3), (1, 50, 5)])
def test_jaccard_join(spark, sf_dir, texts, words, part, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs, words, part, 100).collect()}
    assert found == brute_components(texts, words, part, 100)


def test_large_families_in_blocks(spark, monkeypatch):
    """Two groups of near copies, bridged, a chain of drifting texts and strangers, all in families of several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 7)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    draw = random.Random(4)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    one, two = ([word() for _ in range(40)] for _ in range(2))
    both = []
    for base in (one, two):
        for _ in range(40):
            own = base[:]
            own[draw.randrange(40)] = word()
            both.append(own)
    chain = [[word() for _ in range(40)]]
    for _ in range(40):
        chain.append(chain[-1][2:] + [word(), word()])
    strangers = [[word() for _ in range(40)] for _ in range(10)]
    texts = {i: " ".join(w) for i, w in enumerate([*both, *chain, *strangers, one[:20] + two[:20], one])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words, part in ((1, 90), (2, 80)):
        found = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs, words, part, 100).collect()}
        assert found == brute_components(texts, words, part, 100)


def test_signature_trees_link_everything(monkeypatch):
    """Random near copies over several blocks give the components of all pairs."""
    draw = np.random.default_rng(2)
    base = [draw.integers(0, 2**63, 60).astype(np.uint64) for _ in range(4)]
    sets = []
    for k in range(120):
        own = base[k % 4].copy()
        own[: draw.integers(0, 9)] = draw.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(np.append(own, draw.integers(0, 2**63, draw.integers(0, 6)).astype(np.uint64))))
    t = jaccard.Threshold(85, 100)
    blocks = [np.arange(b, 120, 3) for b in range(3)]
    links = [x for i in range(3) for j in range(i, 3) for x in jaccard.links_within(blocks[i], None if i == j else blocks[j], sets, t)]
    one, two = jaccard.Forest(120), jaccard.Forest(120)
    for a, b in links:
        assert t.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        one.join(a, b)
    for a in range(120):
        for b in range(a):
            if t.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                two.join(a, b)
    assert (one.labels() == two.labels()).all() or {frozenset(np.flatnonzero(one.labels() == x)) for x in set(one.labels())} == {frozenset(np.flatnonzero(two.labels() == x)) for x in set(two.labels())}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (7, 7)]
    found = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize(("window", "hot"), [(35, False), (35, True), (4, False), (4, True)])
def test_substrings(spark, sf_dir, texts, window, hot, monkeypatch):
    if hot:  # about half of all minimisers count as hot
        monkeypatch.setattr(substrings, "HOT_SAMPLE", 2)
        monkeypatch.setattr(substrings, "HOT_STRINGS", 0)
        rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.xxhash64("doc_id", "text").alias("row_key"))
        assert len(substrings.hot_minimisers(rows, window, 10**4)) > 1000
        monkeypatch.setattr(substrings, "partitions", lambda _: 10**4)
    lists = {i: WORDS.findall(t or "") for i, t in texts.items()}
    often = Counter(tuple(w[k : k + window]) for w in lists.values() for k in range(len(w) - window + 1))
    found = {r["doc_id"]: r for r in substrings.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), window, with_text=True).collect()}
    for i, w in lists.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if often[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["text"]) == (len(w), len(gone), kept)
        assert found[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_threshold_search_equals_scan(monkeypatch):
    draw = np.random.default_rng(3)
    for trial in range(40):
        monkeypatch.setattr(topk, "FIRST_DEPTH", int(draw.integers(1, 9)))
        n, d = int(draw.integers(1, 300)), int(draw.integers(1, 6))
        rows = np.floor(draw.standard_cauchy((n, d)) * 3) if trial % 2 else draw.integers(-2, 3, (n, d)).astype(float)
        ids, asked = draw.permutation(2 * n)[:n], draw.integers(0, n, 4)
        found = topk.SortedLists(ids, rows).search(ids[asked], rows[asked], 7)
        for q, (got, scores) in zip(asked, found, strict=True):
            best = sorted((-(rows[i] @ rows[q]), ids[i]) for i in range(n) if i != q)[:7]
            assert [(-s, i) for i, s in zip(got, scores, strict=True)] == best


def test_katz_model(spark, sf_dir, texts):
    unigrams, bigrams, lists = Counter(), Counter(), {}
    for i, t in texts.items():
        w = [*t.encode().lower().split(), b"\n"]
        lists[i] = w
        if zlib.crc32(str(i).encode()) % 5 != 1:
            unigrams.update(w)
            bigrams.update(zip([b"\t", *w[:-1]], w))
    ranks = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    total, distinct = sum(unigrams.values()), len(unigrams)
    low = katz.Words.of(np.r_[total, distinct, ranks(unigrams)])
    d2 = katz.discounts(ranks(bigrams))
    p1 = lambda w: float(low.probability(np.array([unigrams[w]]))[0])
    assert sum(map(p1, unigrams)) + low.unknown == pytest.approx(1, abs=1e-9)
    after = defaultdict(list)
    for (h, w), c in bigrams.items():
        after[h].append((w, c))
    weight = {}
    for h, rows in after.items():
        count, spent = sum(c for _, c in rows), sum(d2[min(c, 6)] * c for _, c in rows)
        add = count - spent < 1e-9
        weight[h] = ((count + add - spent) / (count + add) / (1 - sum(p1(w) for w, _ in rows)), count + add)
    for h in list(after)[:50]:
        seen = {w for w, _ in after[h]}
        mass = sum(d2[min(c, 6)] * c / weight[h][1] for _, c in after[h]) + weight[h][0] * (sum(p1(w) for w in unigrams if w not in seen) + low.unknown)
        assert mass == pytest.approx(1, abs=1e-9)
    for r in queries.op8_katz_backoff(spark, sf_dir).collect():
        w, score, base = lists[r["doc_id"]], 0.0, 0.0
        for h, x in zip([b"\t", *w[:-1]], w):
            c = bigrams[h, x]
            score += math.log10(d2[min(c, 6)] * c / weight[h][1] if c else (weight[h][0] if h in weight else 1) * p1(x))
            base += math.log10((unigrams[x] + 0.5) / (total + 0.5 * (distinct + 1)))
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["base_score"] == pytest.approx(base, abs=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(unigrams[x] > 0 for x in w), total)


def test_rules(spark, sf_dir, texts):
    for r in queries.op9_line_labelling_rules(spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        words = WORDS.findall(text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_viterbi_is_the_best_sequence():
    draw = np.random.default_rng(1)
    field = quality_rules.LineField(np.zeros(2), np.ones(2), np.array([1.0, -0.5]), 0.1, draw.normal(size=(2, 2)))
    for n in range(1, 8):
        x = draw.normal(size=(n, 2))
        emit = field.emissions(x)
        score = lambda y: sum(emit[i] * y[i] for i in range(n)) + sum(field.step[y[i - 1], y[i]] for i in range(1, n))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=score)
        assert score(field.viterbi(x)) == pytest.approx(score(best))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    scored = queries.op2_attention_quality(spark, sf).where("held_out").join(labels, "doc_id")
    right, n = scored.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 50 and right / n > 0.95


def test_pipeline_keeps_clean_documents_and_packs_the_rest(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ruled = corpus_pipeline.quality_rules_stage(spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = labels.where("quality = 1").join(docs, "doc_id").where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= 10)
    assert clean.join(ruled, "doc_id", "left_anti").count() <= 0.05 * clean.count()
    kept = corpus_pipeline.near_duplicates_stage(spark, ruled, sf_dir)
    own = {r[0]: r[1] for r in ruled.select("doc_id", "text").collect()}
    groups = brute_components(own, 5, 80, 100)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted({c for _, c in groups.values()})
    assert kept.columns == docs.columns
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
