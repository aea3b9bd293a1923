"""Operators over whole tables: near copies, decontamination, mixture, shards, language-model scores, and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernel.llm import common, decontaminate, ngram_join, ppm, sharding, source_mix


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def grams(text, n=5):
    w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def copies():
    """Texts with exact and near copies and passages that many share."""
    rng = random.Random(8)
    out, passage = [], prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.randint(1, 120)).split()
        out.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 12)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    out += [f"{prose(rng, 80)} {passage} {prose(rng, 80)}" for _ in range(5)] + ["Same Text!", "same text", "", "...", None, prose(rng, 20_000)]
    return list(enumerate(out))


def matches(texts, threshold=0.4):
    sets = {i: grams(t) for i, t in texts}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def classes(ids, pairs):
    """The least id that each one is connected to."""
    group = {i: i for i in ids}
    while True:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            return group


def expected(texts, threshold=0.4):
    pairs = matches(texts, threshold)
    links = Counter(x for p in pairs for x in p)
    return {i: (g, links[i]) for i, g in classes([i for i, _ in texts], pairs).items()}


def test_join_against_all_pairs(rows, copies):
    docs = rows(*copies, copies[3], (None, copies[0][1]))
    got = ngram_join.jaccard_join(docs)
    assert got.columns == ["doc_id", "class_id", "n_links"] and got.count() == len(copies)
    want = expected(copies)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == want and sum(n for _, n in want.values()) > 40
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_join.all_pairs(ngram_join.jaccard_pairs(docs)).collect()}
    assert pairs == pytest.approx(matches(copies))
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i, _ in [*copies, copies[3]] if want[i][0] == i] + [None])
    assert ngram_join.jaccard_join(docs.where("false")).count() == 0 and ngram_join.deduplicate(docs.where("false")).count() == 0


def test_join_of_versions(rows):
    one, two = prose(random.Random(1), 40), prose(random.Random(2), 40)
    got = ngram_join.jaccard_join(rows((5, one), (3, one), (3, two), (9, two), (9, two), (7, None)))
    assert {tuple(r) for r in got.collect()} == {(3, 3, 2), (5, 3, 1), (9, 3, 1), (7, 7, 0)}


def test_deduplicate_with_clashing_names(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1, 2, 3, 4), (1, "a b c d e f", 1, 2, 3, 4)], "doc_id long, text string, gone long, class_id long, fp long, GONE_ long")
    assert [tuple(r) for r in ngram_join.deduplicate(docs).collect()] == [(1, "a b c d e f", 1, 2, 3, 4)]


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_one_giant_component(rows, spark, copies, monkeypatch, broadcast):
    """Boilerplate that all texts share connects all sets; sizes differ, so that blocks of several bands meet. No task may hold more than two blocks."""
    rng = random.Random(5)
    passage = prose(rng, 40)
    texts = [(i, f"{prose(rng, rng.randint(1, 50))} {passage} {prose(rng, rng.randint(1, 50))}") for i in range(90)]
    texts += [(100 + i, " ".join([passage, *(prose(random.Random(k), 30) for k in range(i % 7))])) for i in range(30)] + [(200 + i, t) for i, t in copies]
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ngram_join, "DRIVER_EDGES", broadcast)
    docs = rows(*texts)
    want = expected(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(docs).collect()} == want
    assert max(Counter(g for g, _ in want.values()).values()) > 60
    kept = ngram_join.deduplicate(docs)
    assert {r.doc_id for r in kept.collect()} == {i for i, (g, _) in want.items() if i == g}
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_join.all_pairs(ngram_join.jaccard_pairs(docs)).collect()}
    assert pairs == pytest.approx(matches(texts))


def test_chance_ngrams_dont_make_all_blocks_meet(rows, monkeypatch):
    """A chain of texts, each with a phrase of the one before: one component, but a set is compared with few others."""
    phrases = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(121)]
    sent = lambda t, pairs: lambda batches: (b.select(["fp", "copies", "fp"]).rename_columns(["fp", "links", "root"]) for b in batches)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "_search", sent)
    docs = rows(*((i, f"{phrases[i]} {phrases[i + 1]}") for i in range(120)))
    join = ngram_join._Join(docs, 5, 0.4, "doc_id", "text")
    assert join.sets.count() > 100
    assert join.matches(pairs=False).count() <= 4 * 120


def test_components_on_driver_and_by_stars(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "a long, b long")
    assert collect(ngram_join.components(edges)) == collect(ngram_join.components(edges, driver_edges=0))


# decontamination


def windows(text, n=8):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_items_of_several_texts(spark, rows):
    """An item's texts share a window: it counts once, whatever the number of passes."""
    shared = "one two three four five six seven eight"
    benchmark = spark.createDataFrame([(1, f"{shared} {w}") for w in "abcdef"] + [(2, shared), (2, shared)], "item_id long, text string")
    docs = rows((10, f"x {shared} y"), (11, f"{shared} a {shared} b {shared}"), (12, None))
    for chars in (decontaminate.PASS_CHARS, 60):
        assert collect(decontaminate.contaminated(docs, benchmark, pass_chars=chars)) == [(10, 1, 1), (10, 2, 1), (11, 1, 5), (11, 2, 3)]
        assert [r.doc_id for r in decontaminate.decontaminate(docs, benchmark, pass_chars=chars).collect()] == [12]


def test_passages_against_plain_search(spark, rows):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(12)] + [(20, "two words"), (21, ""), (22, None), (None, prose(rng, 9)), (0, "two words"), (23, "straße über alles geht der weg nach hause")]
    texts = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 60))
        if i % 3 == 0:
            w = items[i % 12][1].split()
            at = rng.randrange(max(1, len(w) - 8))
            t += " " + ", ".join(w[at : at + rng.randint(6, 12)]).upper() + " " + prose(rng, 5)
        texts.append((i, t))
    texts += [(100, None), (101, ""), (102, "here TWO, words! two words"), (103, "x Straße. Über alles geht der Weg nach Hause"), (104, "two wordsy atwo words"), (105, prose(rng, 20_000) + " " + items[0][1])]
    docs = rows(*texts, texts[0], (None, items[1][1]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    held = defaultdict(set)
    for i, t in items:
        if i is not None:
            own = windows(t) or [tuple((t or "").lower().split())]
            for w in own:
                if w:
                    held[w].add(i)
    want = Counter()
    for d, t in [*texts, texts[0], (None, items[1][1])]:
        hits = Counter()
        for n in {len(w) for w in held}:
            for w in windows(t, n):
                for i in held.get(w, ()):
                    hits[i] += 1
        for i, n in hits.items():
            want[d, i, n] += 1
    assert Counter(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == want and len(want) > 15
    bad = {d for d, _, _ in want}
    for chars in (decontaminate.PASS_CHARS, 200):
        assert Counter(map(tuple, decontaminate.contaminated(docs, benchmark, pass_chars=chars).collect())) == want
        kept = decontaminate.decontaminate(docs, benchmark, pass_chars=chars)
        assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in [*texts, texts[0]] if d not in bad)
    assert decontaminate.contaminated(docs.where("false"), benchmark).count() == 0 and decontaminate.decontaminate(docs, benchmark.where("false")).count() == docs.count()


# mixture


def by_slots(docs, weights, block):
    """The schedule by plain loops: {slot: (source, block, epoch, pieces)}."""
    held = defaultdict(list)
    for i, (s, n) in docs.items():
        held[s].append((hashlib.md5((str(i) if i is not None else "").encode()).hexdigest(), -1 if i is None else i, i, n))
    total = {s: sum(x[3] for x in v) for s, v in held.items()}
    raw = {s: w for s in sorted(held) if (w := weights.get(s, 0) if weights is not None else max(total[s], 1) ** 0.8) > 0}
    share = {s: max(1, round(w / sum(raw.values()) * source_mix.UNIT)) for s, w in raw.items()}
    blocks = {s: max(1, -(-total[s] // block)) for s in raw}
    cut, low = [], 0
    for s, n in share.items():
        low += n
        cut.append((s, low * source_mix.MODULUS // sum(share.values())))
    pieces = defaultdict(list)
    for s in raw:
        at = 0
        for _, _, i, n in sorted(held[s]):
            for b in range(min(at // block, blocks[s] - 1), min(max(at + n - 1, at) // block, blocks[s] - 1) + 1):
                first = max(at - b * block, 0)
                pieces[s, b].append((i, first, min(at + n - b * block, block) - first))
            at += n
    out, turn, slot = {}, Counter(), 0
    while any(turn[s] < blocks[s] for s in raw):
        point = slot * source_mix.STEP % source_mix.MODULUS
        s = next(s for s, high in cut if point < high)
        out[slot] = (s, turn[s] % blocks[s], turn[s] // blocks[s], pieces[s, turn[s] % blocks[s]])
        turn[s] += 1
        slot += 1
    return out


def test_schedule_against_plain_loops(spark):
    rng = random.Random(6)
    docs = [(i, "ab"[i % 5 == 0], " ".join(["t"] * rng.randint(0, 30))) for i in range(80)] + [(200, None, "a b c"), (201, "c", None), (3, "a", "x y"), (None, "b", "q"), (None, "a", ""), (300, "b", "t " * 5000), (301, "tiny", "")]
    table = spark.createDataFrame([(*d, 1, 2, 3, 4, 5) for d in docs], "doc_id long, source string, text string, slot int, number int, mixed_id int, Mixed_Turns int, mixed_turn int")
    sized = {}
    for i, s, t in docs:
        before = sized.get(i)
        sized[i] = (min(s or "", before[0]) if before else s or "", len((t or "").split()) + (before[1] if before else 0))
    for weights in (None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "tiny": 1e-4}, {}):
        want = by_slots(sized, weights, 16)
        got = source_mix.source_schedule(table, weights=weights, block_tokens=16)
        rows = Counter(tuple(r) for r in got.collect())
        assert rows == Counter((slot, s, b, e, *p) for slot, (s, b, e, pieces) in want.items() for p in pieces)
        times = Counter()
        for slot, (s, b, _, pieces) in want.items():
            for i, first, n in pieces:
                at = sum(x[1] for x in sorted(((hashlib.md5((str(j) if j is not None else "").encode()).hexdigest(), m) for j, (t, m) in sized.items() if t == s)) if x[0] < hashlib.md5((str(i) if i is not None else "").encode()).hexdigest())
                times[i] += at >= b * 16
        mixed = source_mix.mix_sources(table, weights=weights, block_tokens=16)
        assert mixed.columns == table.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: sum(times[i] for j, _, _ in docs if j == i) for i in sized} if weights != {} else {})
    assert {r.doc_id for r in source_mix.mix_sources(table, block_tokens=16).collect()} == set(sized)
    assert source_mix.source_schedule(table.where("false")).count() == 0 and source_mix.mix_sources(table.where("false")).count() == 0


def test_mixture_by_shuffle_and_its_limit(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"s{i % 7}", "t " * (i + 1)) for i in range(60)], "doc_id long, source string, text string")
    want = collect(source_mix.mix_sources(table, block_tokens=16))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert collect(source_mix.mix_sources(table, block_tokens=16)) == want and len(want) > 60
    # any run of slots is close to the weights
    slots = {r.slot: r.source for r in source_mix.source_schedule(table, block_tokens=4).collect()}
    tokens = Counter()
    for r in table.collect():
        tokens[r.source] += len(r.text.split())
    weight = {s: n**0.8 / sum(x**0.8 for x in tokens.values()) for s, n in tokens.items()}
    for n in range(10, len(slots), 37):
        held = Counter(slots[i] for i in range(n))
        assert all(abs(held[s] - w * n) < 3 for s, w in weight.items())
    monkeypatch.setattr(source_mix, "MAX_SOURCES", 6)
    with pytest.raises(ValueError):
        source_mix.source_schedule(table)


def test_points_below():
    for n in (0, 1, 2, 17, 1000):
        for bound in (0, 1, source_mix.MODULUS // 3, source_mix.MODULUS // 2 + 7, source_mix.MODULUS):
            assert source_mix.points_below(n, bound) == sum(i * source_mix.STEP % source_mix.MODULUS < bound for i in range(n))
    assert source_mix._slots([3, 1], [source_mix.MODULUS // 2, source_mix.MODULUS]) == 5


# shards


def test_shards(rows, spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, less, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    docs = rows(*[(i, "t") for i in range(300)], (5, None), (None, ""))
    got = sharding.shard(docs, 7)
    by = defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add(r.shard)
    assert got.count() == docs.count() and all(len(s) == 1 and 0 <= min(s) < 7 for s in by.values())
    assert max(Counter(min(s) for s in by.values()).values()) < 90
    assert sharding.shard(docs.where("false"), 7).count() == 0
    clashing = spark.createDataFrame([(1, "a " * 500_000, 7, 8, 9), (None, None, 7, 8, 9)], "doc_id long, text string, shard_slot int, SHARD_NUMBER int, Shard int")
    got = sharding.shard(clashing, 7)
    assert got.columns == ["doc_id", "text", "shard_slot", "SHARD_NUMBER", "shard"]
    table, names = sharding.lookup_table(sharding.shard_names(7)), {}
    for i in (1, None):
        names[i] = int(table[int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 65537 if i is not None else 0])
    assert {r.doc_id: (r.shard_slot, r.SHARD_NUMBER, r.shard) for r in got.collect()} == {i: (7, 8, s) for i, s in names.items()}
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*wrong)


# language model


def by_hand(train, text, order):
    """Code length by a plain trie of dicts."""
    trie = defaultdict(Counter)
    for t in train:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for j in range(order + 1):
                trie[t[i - j : i]][t[i]] += 1
    bits, t = 0.0, b"\0" * order + text
    for i in range(order, len(t)):
        known: set[int] = set()
        for j in range(order, -1, -1):
            left = {s: n for s, n in trie.get(t[i - j : i], {}).items() if s not in known}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if t[i] in left:
                bits -= math.log2(left[t[i]] / total)
                break
            bits -= math.log2(len(left) / total)
            known |= set(left)
        else:
            bits += math.log2(256 - len(known))
    return bits


@pytest.mark.parametrize(("order", "pass_entries"), [(4, ppm.PASS_ENTRIES), (4, 100), (2, 30), (1, ppm.PASS_ENTRIES)])
def test_code_lengths_against_plain_trie(rows, order, pass_entries, monkeypatch):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abcab cdé") for _ in range(rng.randint(0, 40)))) for i in range(30)] + [(50, None), (51, ""), (52, "ab" * 5000), (52, "ab" * 5000), (None, "zebra"), (60, "qxwvq qxw"), (61, "qxwvq qxw"), (62, "\0a\0")]
    docs = rows(*texts)
    sent, made = [], ppm._tables
    monkeypatch.setattr(ppm, "_tables", lambda *a: sent.append(made(*a)) or sent[-1])
    want = []
    for k, (d, t) in enumerate(texts):
        b = (t or "").encode()
        train = [(x or "").encode() for i, (_, x) in enumerate(texts) if i != k]
        want.append((d, len(b), by_hand(train, b, order)))
    got = sorted(((r.doc_id, r.n_bytes, r.bits) for r in ppm.code_lengths(docs, order=order, pass_entries=pass_entries).collect()), key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want, key=repr)]
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want), rel=1e-6, abs=1e-6)
    # what a pass sends: entries up to the limit, and the shorter contexts above them
    assert all(len(t[-1][0]) <= pass_entries for t in sent) and (len(sent) > 2) == (pass_entries < 1000)


def test_trained_elsewhere_and_empty(rows):
    docs = rows((1, "banana"), (2, "xyzzy"))
    train = rows((7, "banana banana banana"), (8, None))
    got = {r.doc_id: r.bits_per_byte for r in ppm.code_lengths(docs, train).collect()}
    assert got[1] < 1.5 < 6 < got[2]
    assert ppm.code_lengths(docs, train.where("false")).first().bits_per_byte == pytest.approx(8)
    assert ppm.code_lengths(docs.where("false")).count() == 0


def test_passes_code_every_byte(rows):
    docs = rows((1, "banana"), (2, "xyzzy 123 XYZ"), (3, "bxaxn"), (4, "é"))
    train = rows((7, "banana banana banana"), (8, "cabbage in a bag"))
    one, many = ({r.doc_id: r.bits for r in ppm.code_lengths(docs, train, pass_entries=n).collect()} for n in (ppm.PASS_ENTRIES, 20))
    assert many == pytest.approx(one) and one[2] > 50


# pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages by plain loops; labels of a part of the documents drop junk and toxic ones everywhere."""
    rng = random.Random(12)
    passage = prose(rng, 30)
    docs = [(i, prose(rng, rng.randint(40, 400))) for i in range(90)]
    docs += [(100 + i, docs[i][1] + " end") for i in range(10)] + [(130 + i, docs[i][1]) for i in range(5)]
    docs += [(150, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"), (151, None), (152, ""), (153, prose(rng, 20_000)), (3, docs[3][1])]
    junk = {200 + i for i in range(40)}
    toxic = {300 + i for i in range(40)}
    docs += [(i, prose(rng, 60).upper() + " BUY!! NOW!! $$$ $$$ $$$ ") for i in sorted(junk)] + [(i, f"{prose(rng, 30)} vileword {prose(rng, 20)} nastyword vileword {prose(rng, 20)}") for i in sorted(toxic)]
    made = [(i, t, "en", f"s{i % 3}" if i != 152 else None, len(t or ""), 1, 2, 3) for i, t in docs]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, shard int, gone int, digest int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in sorted(junk)[:25]] + [(i, 1, 1) for i in sorted(toxic)[:25]] + [(None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # quality: what isn't labelled goes as its like
    kept = [(i, t) for i, t in docs if i not in junk | toxic]
    # near copies
    texts = dict(kept)
    group = expected(sorted(texts.items()))
    kept = [(i, t) for i, t in kept if group[i][0] == i]
    # benchmark
    bad = set(windows(passage))
    kept = [(i, t) for i, t in kept if not bad & set(windows(t))]
    assert {150, 100, 130}.isdisjoint(i for i, _ in kept) and len(kept) > 90
    # mixture
    sized = {}
    for i, t in kept:
        sized[i] = (f"s{i % 3}" if i != 152 else "", sized.get(i, ("", 0))[1] + len((t or "").split()))
    times = Counter()
    for _, b, _, pieces in by_slots(sized, None, 2048).values():
        for i, first, _ in pieces:
            digest = lambda j: hashlib.md5(str(j).encode()).hexdigest()
            at = sum(n for j, (s, n) in sized.items() if s == sized[i][0] and digest(j) < digest(i))
            times[i] += at >= b * 2048
    table = sharding.lookup_table(sharding.shard_names(corpus_pipeline.SHARDS))
    shard = lambda i: int(table[int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE])
    want = Counter((i, t, shard(i)) for i, t in kept for _ in range(times[i]))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "digest", "shard"]
    assert Counter((r.doc_id, r.text, r.shard) for r in got.collect()) == want and sum(want.values()) > len(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_are_freed(spark):
    before = common.written()
    one, two = common.materialize(spark.range(3)), common.materialize(spark.range(4))
    assert len(common.written() - before) == 2
    common.free(spark, before)
    assert two.count() == 4 and len(common.written() - before) == 1
    with pytest.raises(Exception, match="(?i)not.*exist|does not exist|PATH_NOT_FOUND|FILE"):
        one.count()
