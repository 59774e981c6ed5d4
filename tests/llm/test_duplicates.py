"""Near duplicates, facts, increments and mixes against brute force."""

import itertools
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import facts, increment, mixing, neardup
from quillgraph.llm.canonical import letters_and_digits

ALPHABET = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]


def family(rnd, size, n, edits):
    base = "".join(rnd.choice(ALPHABET) for _ in range(n))
    out = [base]
    for _ in range(size - 1):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice([[], [rnd.choice(ALPHABET)], [t[i], rnd.choice(ALPHABET)]])
        out.append("".join(t))
    return out


def texts(seed=4):
    rnd = random.Random(seed)
    out = list(itertools.chain.from_iterable(family(rnd, rnd.randint(1, 5), rnd.randint(55, 300), 12) for _ in range(60)))
    out += family(rnd, 120, 200, 10) + [out[0] + "，。"] * 40 + [None, "", "短", "　", "甲" * 70, "甲" * 300, "x" * 50_000]
    rnd.shuffle(out)
    return out


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(find(x), x) for x in list(root) if find(x) != x}


def near(a, b):
    return len(a) >= 60 and len(b) >= 60 and neardup.similarity(a, b, 5) >= 0.6


def test_near_duplicates(spark):
    rows = texts()
    keys = [letters_and_digits(t) for t in rows]
    want = groups((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near(keys[i], keys[j]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, content string, hash string, id int")
    assert {(r.first, r.id) for r in neardup.near_duplicates(df, "doc_id", "content").collect()} == want
    assert neardup.near_duplicates(df.limit(0), "doc_id", "content").count() == 0


def test_links_across_a_bucket(spark):
    """Members of a bucket that are near each other but not its lead are linked all the same."""
    rnd = random.Random(8)
    shared = "".join(rnd.choice(ALPHABET) for _ in range(80))
    far = shared + "".join(rnd.choice(ALPHABET) for _ in range(90))
    pair = family(rnd, 2, 170, 3)
    rows = [far, *(shared + p for p in pair)]
    keys = [letters_and_digits(t) for t in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, content string")
    many = neardup.Scheme(bands=120, rows=2)
    want = groups((i, j) for i, j in itertools.combinations(range(3), 2) if near(keys[i], keys[j]))
    assert want == {(1, 2)}
    assert {(r.first, r.id) for r in neardup.near_duplicates(df, "doc_id", "content", many).collect()} == want


def boilerplate(n, seed):
    """Unrelated texts that share a long passage, with two near pairs among them."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(ALPHABET) for _ in range(k))
    shared = word(60)
    out = [shared + word(120) for _ in range(n)]
    out[n // 2] = out[3][:-8] + word(8)
    out[n - 1] = out[n - 7][:70] + word(3) + out[n - 7][70:]
    return out


def test_hot_bucket_forms_few_pairs(spark):
    rows = [(i, letters_and_digits(t)) for i, t in enumerate(boilerplate(2000, 12))]
    texts = spark.createDataFrame(rows, "id long, compared string")
    members = texts.select(F.lit(7).cast("long").alias("bucket"), "id", F.lit(0).cast("long").alias("lead"))
    none = spark.createDataFrame([], "id long, label long")
    pairs = {(r.a, r.b) for r in neardup.cross_pairs(members, none, texts, neardup.Scheme()).collect()}
    assert {(3, 1000), (1993, 1999)} <= pairs and len(pairs) < 4000
    # members of one component never meet
    one = texts.select("id", F.lit(1).cast("long").alias("label")).where("id < 1990")
    across = neardup.cross_pairs(members, one, texts, neardup.Scheme(most_pairs=100))
    assert all(b >= 1990 for _, b in across.collect())
    left, right = (texts.where(c).select(F.lit(7).alias("bucket"), F.col("id").alias(k)) for c, k in (("id < 1000", "a"), ("id >= 1000", "b")))
    found = {(r.a, r.b) for r in neardup.bucket_pairs(left, right, texts, texts, neardup.Scheme()).collect()}
    assert (3, 1000) in found and len(found) < 4000


def test_hot_buckets_lose_nothing(spark):
    """Every bucket is hot and holds all texts: recall is that of the rare shingles, which is 1."""
    rows = texts(15) + boilerplate(60, 3)
    keys = [letters_and_digits(t) for t in rows]
    want = groups((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near(keys[i], keys[j]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, content string")
    hot = neardup.Scheme(bands=30, rows=1, most_pairs=0)
    assert {(r.first, r.id) for r in neardup.near_duplicates(df, "doc_id", "content", hot).collect()} == want


def test_far_pairs_of_buckets_are_not_written(spark, monkeypatch):
    """Pairs are tested where they meet, in one slice or several, in hot buckets too; those that are far leave no rows."""
    rows = texts(15)[:40] + boilerplate(150, 12)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, content string")
    signed = neardup.signatures(df, "id", "content", neardup.Scheme()).cache()
    members = signed.select(F.lit(7).cast("long").alias("bucket"), "id", F.lit(-1).cast("long").alias("lead"))
    none = spark.createDataFrame([], "id long, label long")
    keys = {r.id: r.compared for r in signed.collect()}
    want = {(i, j) for i, j in itertools.combinations(sorted(keys), 2) if near(keys[i], keys[j])}
    for least, most in ((500_000, 20_000), (150, 20_000), (2000, 0)):
        monkeypatch.setattr(neardup, "LEAST_ROWS", least)
        monkeypatch.setattr(neardup, "ROWS_A_TEXT", 0)
        scheme = neardup.Scheme(most_pairs=most)
        found = {(r.a, r.b) for r in neardup.cross_pairs(members, none, signed.select("id", "compared"), scheme, neardup.sketch_near(signed, scheme)).collect()}
        assert want <= found and len(found) < 1000  # of 17,955 pairs


def test_recall_at_the_threshold(spark):
    """Lone pairs of similarity 0.60 to 0.65, each in an alphabet of its own: found by the bands of p2 and of p6."""
    rnd = random.Random(31)
    word = lambda k, i: "".join(chr(0x4E00 + 30 * i + rnd.randrange(30)) for _ in range(k))
    pairs = []
    while len(pairs) < 300:
        base = word(200, len(pairs))
        other = list(base)
        for _ in range(rnd.randint(7, 14)):
            other[rnd.randrange(200)] = word(1, len(pairs))
        if 0.6 <= neardup.similarity(base, "".join(other), 5) < 0.65:
            pairs.append((base, "".join(other)))
    flat = [t for p in pairs for t in p]
    df = spark.createDataFrame(list(enumerate(flat)), "doc_id long, content string")
    assert neardup.near_duplicates(df, "doc_id", "content").count() >= 0.95 * len(pairs)
    docs = spark.createDataFrame([(i, None, None, a) for i, (a, _) in enumerate(pairs)], "doc_id long, document_id string, content_hash string, content string")
    recs = spark.createDataFrame([("run_1", f"r{i}", None, json.dumps({"text": {"content": b}})) for i, (_, b) in enumerate(pairs)], "run_id string, document_id string, content_hash string, canonical_json string")
    assert increment.repeated_records(recs, docs).count() >= 0.95 * len(pairs)


def test_records_with_hot_buckets(spark):
    """As test_records, but every bucket is hot, and runs may be NULL."""
    rows = texts(22)[:150]
    docs = [(i, f"d{i}", None, t) for i, t in enumerate(rows[:40])]
    records = [(f"run_{1 + i // 20:02d}", f"r{i}", None, json.dumps({"text": {"content": t}})) for i, t in enumerate(rows[40:])]
    schema = "run_id string, document_id string, content_hash string, canonical_json string"
    ddf = spark.createDataFrame(docs, "doc_id long, document_id string, content_hash string, content string")
    hot = neardup.Scheme(bands=40, rows=1, words=0, most_pairs=0)
    lost = [(None, "late", None, records[0][3]), (None, "d3", None, None)]
    got = {(r.run_id, r.document_id) for r in increment.repeated_records(spark.createDataFrame(records + lost, schema), ddf, hot).collect()}
    assert {x for x in got if x[0]} == reference_records(records, docs) and (None, "d3") in got


def test_sketch_estimates():
    rnd = random.Random(3)
    s = neardup.Scheme()
    base = "".join(rnd.choice(ALPHABET) for _ in range(400))
    other = base[:360] + "".join(rnd.choice(ALPHABET) for _ in range(40))
    _, sk = neardup.Signer(s).sign([base, other, "".join(rnd.choice(ALPHABET) for _ in range(400))])
    flips = lambda a, b: sum(bin(int(x) & (2**64 - 1)).count("1") for x in (sk[a] ^ sk[b]))
    assert flips(0, 1) < s.most_flips < flips(0, 2)


def reference_facts(rows):
    k = [tuple(letters_and_digits(v) for v in r[1:6]) for r in rows]
    pairs = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        (s, st, r, o, ot), (s2, st2, r2, o2, ot2) = k[i], k[j]
        if r == r2 and ((s, o, ot) == (s2, o2, ot2) or (r == "relatedto" and (s, st, o, ot) == (o2, ot2, s2, st2))):
            pairs.append((rows[i][0], rows[j][0]))
    return groups(pairs)


def test_facts(spark):
    rnd = random.Random(6)
    forms = ["甲病", " 甲病。", "甲-病", "乙", "“乙”", "", None, "Ａb", "aB"]
    kinds = ["Disease", "disease ", None, "Drug"]
    rows = [(i, rnd.choice(forms), rnd.choice(kinds), rnd.choice(["RELATED_TO", "related to", "TREATED_BY"]), rnd.choice(forms), rnd.choice(kinds)) for i in range(250)]
    rows += [(1000 + i, "热", "Disease", "TREATED_BY", "药", "Drug") for i in range(300)] + [(2000, "长" * 50_000, None, None, "x", None), (2001, "长" * 50_000 + "。", None, None, "X", None)]
    schema = "id long, subject string, subject_type string, relation string, object string, object_type string"
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], schema + ", first_id int, n_copies int")
    want = reference_facts(rows)
    assert {(r.first_id, r.id) for r in facts.duplicate_facts(df).collect()} == want
    once = facts.unique_facts(df).collect()
    assert sum(r.n_copies for r in once) == len(rows) and {r.id for r in once} == {r[0] for r in rows} - {i for _, i in want}
    assert facts.duplicate_facts(df.limit(0)).count() == 0


def plain(x):
    return None if x is None else x.strip().lower().removeprefix("sha256:").strip()


def reference_records(records, docs):
    known = [(plain(d), plain(h), letters_and_digits(c)) for _, d, h, c in docs]
    found = set()
    for _, run in itertools.groupby(sorted(records, key=lambda r: r[0]), key=lambda r: r[0]):
        fresh = []
        for r, d, h, j in run:
            try:
                c = letters_and_digits(json.loads(j)["text"]["content"]) if j else ""
            except ValueError:
                c = ""
            me = (plain(d), plain(h), c)
            if any((me[0] and me[0] == k[0]) or (me[1] and me[1] == k[1]) or near(me[2], k[2]) for k in known):
                found.add((r, d))
            else:
                fresh.append(me)
        known += fresh
    return found


def test_records(spark):
    rnd = random.Random(9)
    pool = list(itertools.chain.from_iterable(family(rnd, 5, rnd.randint(70, 200), 14) for _ in range(25))) + family(rnd, 60, 150, 8)
    rnd.shuffle(pool)
    docs = [(i, f"doc_{i % 20}", rnd.choice([None, f"sha256:H{i}"]), c) for i, c in enumerate(pool[:30] + [None, ""])]
    records = []
    for i, c in enumerate(pool[30:] * 2):
        h = rnd.choice([None, f"SHA256:h{rnd.randint(0, 60)}", f" h{rnd.randint(0, 60)} "])
        j = rnd.choice([json.dumps({"text": {"content": c}}), json.dumps({"text": {"content": c + "。"}}, ensure_ascii=False), None, "{broken"])
        records.append((f"run_{rnd.randint(1, 12):03d}", rnd.choice([f"DOC_{rnd.randint(0, 400)} ", f"r{i}"]), h, j))
    records += records[:3]
    seen = {}
    records = [r for r in records if seen.setdefault(r[:2], r) == r]
    rdf = spark.createDataFrame([(*r, 1) for r in records], "run_id string, document_id string, content_hash string, canonical_json string, id int")
    ddf = spark.createDataFrame(docs, "doc_id long, document_id string, content_hash string, content string")
    got = Counter((r.run_id, r.document_id) for r in increment.repeated_records(rdf, ddf).collect())
    assert set(got) == reference_records(sorted(set(records), key=lambda r: r[0]), docs) and max(got.values()) == 1
    assert increment.repeated_records(rdf.limit(0), ddf).count() == 0
    none = {(r.run_id, r.document_id) for r in increment.repeated_records(rdf, ddf.limit(0)).collect()}
    assert none == reference_records(sorted(set(records), key=lambda r: r[0]), [])


def test_stored_history_grows_by_accepted_records(spark, tmp_path, monkeypatch):
    """Batches one after another against the stored table give what all runs at once give."""
    signed_rows = []
    signatures = increment.signatures

    def counted(df, *args):
        signed_rows.append(df.count())
        return signatures(df, *args)

    monkeypatch.setattr(increment, "signatures", counted)
    rnd = random.Random(10)
    pool = list(itertools.chain.from_iterable(family(rnd, 4, rnd.randint(70, 160), 10) for _ in range(20)))
    rnd.shuffle(pool)
    docs = [(i, f"doc_{i}", None, c) for i, c in enumerate(pool[:15])]
    records = [(f"run_{1 + i // 22:03d}", f"r{rnd.randint(0, 60)}", None, json.dumps({"text": {"content": c}})) for i, c in enumerate(pool[15:])]
    schema = "run_id string, document_id string, content_hash string, canonical_json string"
    ddf = spark.createDataFrame(docs, "doc_id long, document_id string, content_hash string, content string")
    increment.start_history(ddf, str(tmp_path / "h"))
    got, sizes = set(), []
    for run in sorted({r[0] for r in records}):
        batch = spark.createDataFrame([r for r in records if r[0] == run], schema)
        got |= {(r.run_id, r.document_id) for r in increment.extend_history(batch, str(tmp_path / "h")).collect()}
        sizes.append(increment.stored_history(spark, str(tmp_path / "h"))[0].count())
    assert got == reference_records(records, docs) and sizes[-1] > sizes[0] > len(docs)
    for seen, batch in ((0, 3), (1, 2)):  # a run signs its own texts only
        signed_rows.clear()
        increment.extend_history(spark.createDataFrame([("run_9%d" % seen, f"new{seen}{i}", None, json.dumps({"text": {"content": "甲乙" * 40 + str(i)}})) for i in range(batch)], schema), str(tmp_path / "h")).count()
        assert sum(signed_rows) == batch
    signed, _ = increment.stored_history(spark, str(tmp_path / "h"))
    assert signed.select("id").distinct().count() == signed.count()


def test_bands_are_made_by_slices(spark):
    """Rows signed without bands give the buckets of those that store them."""
    df = spark.createDataFrame(list(enumerate(texts(12))), "id long, content string")
    of = lambda *args: Counter((r.id, r.bucket) for part in neardup.band_slices(neardup.signatures(df, "id", "content", increment.BANDS, *args), increment.BANDS, "id") for r in part.collect())
    stored = of(increment.PIVOTS)
    assert stored == of(increment.PIVOTS, False) and sum(stored.values()) % increment.BANDS.bands == 0


def test_bands_and_read_contents_are_not_kept_on_disk(spark, monkeypatch):
    """The working tables of a call take less than twice the bytes of the compared texts at any time."""
    rnd = random.Random(21)
    pool = ["".join(rnd.choice(ALPHABET) for _ in range(200)) for _ in range(3000)]
    docs = [(i, f"doc_{i}", None, c) for i, c in enumerate(pool[:2000])]
    records = [(f"run_{i % 4}", f"r{i}", None, json.dumps({"text": {"content": c}})) for i, c in enumerate(pool[2000:] + pool[:200])]
    ddf = spark.createDataFrame(docs, "doc_id long, document_id string, content_hash string, content string").coalesce(1)
    rdf = spark.createDataFrame(records, "run_id string, document_id string, content_hash string, canonical_json string").coalesce(1)
    paths, most = [], [0]

    def watched(df, tag):
        out = materialize(df, tag)
        paths.append(Path(out.written_path.removeprefix("file:").replace("//", "/")))
        most[0] = max(most[0], sum(f.stat().st_size for p in paths for f in p.glob("*.parquet")))
        return out

    materialize = increment.materialize
    for module in (increment, neardup):
        monkeypatch.setattr(module, "materialize", watched)
    assert increment.repeated_records(rdf, ddf).count() == 200
    assert 0 < most[0] < 2 * sum(len(c.encode()) for c in pool + pool[:200])


def test_bands_miss_few_pairs_at_the_threshold():
    b = increment.BANDS
    assert (1 - b.threshold**b.rows) ** b.bands <= (1 - 0.6**5) ** 48


def test_pivots_never_prune_a_near_pair():
    rnd = random.Random(5)
    keys = list(itertools.chain.from_iterable(family(rnd, 4, rnd.randint(60, 400), 40) for _ in range(40)))
    n, table = neardup.Signer(neardup.Scheme()).pivot_table(keys, increment.PIVOTS)
    for i, j in itertools.combinations(range(len(keys)), 2):
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in (table[i] ^ table[j]))
        a, b = neardup.shingles(keys[i], 5), neardup.shingles(keys[j], 5)
        assert n[i] == len(a) and apart <= len(a ^ b)


def test_pfair_lag():
    blocks = {"a": 40, "b": 25, "c": 3, "d": 31, "e": 1, "f": 0}
    out = mixing.pfair_schedule(blocks)
    total = sum(blocks.values())
    done = Counter()
    assert Counter(s for s, _ in out) == {s: n for s, n in blocks.items() if n}
    for t, (s, j) in enumerate(out, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - n * t / total) < 1 for x, n in blocks.items())


def test_mix(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None, "other"]), "word " * rnd.randint(0, 60) if i % 50 else None, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens string")
    mix = spark.createDataFrame([("a", 0.3, 1, 9), ("b", 0.3, 3, 9), ("c", 0.3, 4, 9), ("none", 0.1, 2, 9)], "source string, target_share double, max_repeats int, tokens int")
    chosen = mixing.mixed(docs, mix)
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} <= {"a", "b", "c"}
    assert all(0 < r.repeats <= {"a": 1, "b": 3, "c": 4}[r.source] for r in got)
    share = {r.source: r for r in mixing.shares(chosen, mix).collect()}
    assert share["none"].actual_share == 0
    assert all(share[s].actual_share == pytest.approx(1 / 3, abs=0.01) for s in "abc")
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs, mix).collect()))
    assert mixing.mixed(docs.limit(0), mix).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, mix.union(mix))


def test_every_use_has_a_slot(spark):
    """Repeats of a source fill its later slots, so every slice of the schedule holds the target shares."""
    rnd = random.Random(8)
    rows = [(i, "abbccc"[i % 6] if i % 9 else "a", "word " * rnd.randint(1, 30)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 4), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    chosen = {r.doc_id: r for r in mixing.mixed(docs, mix, blocks=200).collect()}
    uses = mixing.scheduled(docs, mix, blocks=200).collect()
    assert max(r.repeats for r in chosen.values()) > 1
    assert sorted((r.doc_id, r.use) for r in uses) == sorted((d, k) for d, r in chosen.items() for k in range(1, r.repeats + 1))
    assert all(r.slot == chosen[r.doc_id].first_slot for r in uses if r.use == 1)
    last = max(r.slot for r in uses) + 1
    for part in range(4):
        n = Counter()
        for r in uses:
            if part * last <= 4 * r.slot < (part + 1) * last:
                n[r.source] += r.n_tokens
        assert all(n[s] / sum(n.values()) == pytest.approx(w, abs=0.03) for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_emitted_rows_keep_the_bound(spark):
    """After any slot every source's emitted tokens lie less than two blocks from its share; blocks hold a document."""
    rnd = random.Random(18)
    rows = [(i, "abc"[i % 3], "word " * rnd.choice([1, 5, 400])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 4), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    uses = sorted(mixing.scheduled(docs, mix, blocks=100_000, bucket_rows=50).collect(), key=lambda r: r.slot)
    total = Counter()
    for r in uses:
        total[r.source] += r.n_tokens
    block = max(r.n_tokens for r in uses)
    done, every = Counter(), sum(total.values())
    for slot, group in itertools.groupby(uses, key=lambda r: r.slot):
        for r in group:
            done[r.source] += r.n_tokens
        if slot < max(u.slot for u in uses):
            assert all(abs(done[s] - (slot + 1) * block * total[s] / every) < 2 * block for s in total)
    assert Counter((r.doc_id, r.use) for r in uses).most_common(1)[0][1] == 1
