"""Each operator against a brute-force version, and its defined results for awkward tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, labelled, licenses, packing, quality_model, quality_rules, sharding, simhash, spotsigs, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it for on was with stone river window carries quiet lamp engine seven paper".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (4, "word", "en", "b", 4),
    (5, prose(5, 60), "en", "b", 1),
    (6, prose(5, 60), "en", "b", 1),
    (None, prose(7, 80), "en", "b", 1),
    (8, prose(8, 30_000), "en", "c", 1),
    (9, "x" * 5_000 + " ÉÀ \U0001f600 é <|endoftext|> it's 12 ", "en", "c", 1),
    (9, "x" * 5_000 + " ÉÀ \U0001f600 é <|endoftext|> it's 12 ", "en", "c", 1),
    (10, "line one two\nline one two\nline one two\n[INST] </s> \\ < [", "en", "c", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows with nulls, empty and long texts, ties and repeats, and columns that clash with outputs."""
    clash = [("bytes", "x"), ("shard", 1), ("slot", 2), ("ids", "x"), ("decoded", "x"), ("score", 0.5), ("n_words", "x"), ("kept", "x"), ("fingerprint", 1), ("fp", 2), ("component_id", 3), ("row", 4), ("uid", 5), ("at", 6), ("id", 7), ("t", 8), ("w", 9), ("key", 1), ("bucket", 2), ("part", 3), ("lines", 1), ("h", 1), ("s", 1), ("base_failed", 1)]
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in clash})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def columns_kept(before, after, *added):
    assert set(before.columns) <= set(after.columns) | set(added)


def test_sharding_is_a_gapless_even_permutation(spark, awkward, empty):
    out = sharding.shuffle_shards(awkward, 3, seed=1)
    assert set(out.columns) == set(awkward.columns)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((a, b) for a, b, *_ in AWKWARD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffle_shards(empty, 3).count() == 0


def _placed(spark, df, **given):
    return sorted((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffle_shards(df, **given).collect())


def test_sharding_mixes_by_seed(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    order = lambda seed: [r.doc_id for r in sharding.shuffle_shards(df, 8, seed=seed).orderBy("shard", "slot").collect()]
    a, b = order(1), order(2)
    assert sorted(a) == list(range(2000)) and a != b and a == order(1)
    assert abs(np.corrcoef(a, range(2000))[0, 1]) < 0.1


def test_sharding_depends_on_seed_and_rows_alone(spark):
    plain = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same " * 200).alias("text"))
    df = plain.unionAll(hot)
    want = _placed(spark, df, shards=4, bucket_bytes=1 << 16)
    try:
        for adaptive, parts, cut in (("false", "4", 3), ("true", "11", 7)):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert _placed(spark, df.repartition(cut), shards=4, bucket_bytes=1 << 16) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    counts = Counter(shard for _, _, shard, _ in want)
    assert len(want) == 3900 and max(counts.values()) - min(counts.values()) <= 1
    # Equal records lie in many buckets, not in one: no shard holds far more than its share of them.
    own = Counter(shard for d, t, shard, _ in want if t.startswith("same"))
    assert max(own.values()) < 900 and len(own) == 4


def test_bpe_equals_the_library_and_round_trips(spark, awkward, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = awkward.drop("decoded")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).select("text", "ids", "decoded").collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    both = bpe.round_trip(docs, PATH)
    assert "text" not in both.columns and Counter((tuple(r.ids), r.decoded) for r in both.collect()) == Counter((tuple(r.ids), r.decoded) for r in rows)
    assert bpe.round_trip(empty, PATH).count() == 0


def test_bpe_table_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT_BYTES", 20_000)
    own = bpe.WordBpe(PATH)
    for i in range(40):
        own.encode([" ".join(f"{'x' * 300}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(8))])
        assert own.held <= 40_000 and len(own.known) < 60


def test_bpe_merges_leftmost_lowest_rank_first():
    own = bpe.load(PATH)
    merge = {(int(p >> 32), int(p & 0xFFFFFFFF)): (int(r), int(own.made[r])) for p, r in zip(own.pairs, own.pair_rank)}

    def slow(word):
        ids = [int(own.inner[b]) for b in word]
        ids[-1] = int(own.final[word[-1]])
        while found := [(merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]:
            i = min(found)[1]
            ids[i : i + 2] = [merge[ids[i], ids[i + 1]][1]]
        return ids

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinrstlohé"), int(rng.integers(1, 90)))) for _ in range(300)]
    own.known.clear()
    own.learn(set(words))
    for w in words:
        assert np.frombuffer(own.known[w], "<u4").tolist() == slow(w.encode())


@pytest.mark.parametrize("word", ["=" * 33_000, "stonewindowengine" * 1_950, "quietlamppaper" * 5_000], ids=["rule", "33k", "70k"])
def test_bpe_merges_every_rank_in_very_long_words(word):
    from tokenizers import Tokenizer

    got = np.frombuffer(bpe.load(PATH).encode([word])[0], "<u4").tolist()
    assert got == Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids


def test_packing_loses_nothing(spark, awkward, empty):
    own = bpe.load(PATH)
    pieces = packing.pack(awkward, PATH, length=64).collect()
    want = Counter((d, own.encode([t])[0] + (2).to_bytes(4, "little")) for d, t, *_ in AWKWARD)
    placed = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.offset + p.length <= 64
        placed[p.sequence_id].append((p.offset, p.length))
    for k, spans in placed.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 64 or k == max(placed)
    assert sorted(placed) == list(range(len(placed)))
    total = sum(n * len(ids) // 4 for (_, ids), n in want.items())
    assert sum(p.length for p in pieces) == total
    stream = [x for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for x in np.frombuffer(p.ids, "<u4").tolist()]
    docs, at = Counter(), 0
    starts = sorted(((p.sequence_id * 64 + p.offset, p.doc_id, p.doc_tokens) for p in pieces if p.start == 0))
    for begin, d, n in starts:
        assert begin == at
        docs[d, np.array(stream[at : at + n], "<u4").tobytes()] += 1
        at += n
    assert docs == want
    assert packing.pack(empty, PATH).count() == 0


def test_quality_rules_measures(spark, awkward, empty):
    rows = {r.doc_id: r for r in quality_rules.judged(awkward).collect()}
    assert not rows[1].kept and rows[1].n_words == 0 and rows[1].base_failed
    assert rows[4].n_words == 1 and rows[4].word_chars == 4
    assert rows[10].n_dup_lines == 2 and rows[10].n_repeat_words == 9 and rows[10].n_symbols == 3
    assert len(rows) == len({d for d, *_ in AWKWARD}) and quality_rules.judged(awkward).count() == len(AWKWARD)
    kept = quality_rules.keep(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.judged(awkward).where("kept").collect()}
    assert quality_rules.judged(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_simhash_against_all_pairs(spark, awkward, empty):
    rng = np.random.default_rng(3)
    texts = [prose(i, 120) for i in range(60)]
    for i in range(40):  # near copies: one word changed, again and again
        words = texts[i].split()
        words[int(rng.integers(0, len(words)))] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts + ["", "a b", texts[0]])), "doc_id long, text string").union(awkward.where("doc_id is not null").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = docs.collect()

    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = low.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
        words = [w for w in words if w]
        if not words:
            return 0
        votes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))

    prints = {r.doc_id: plain(r.text) for r in rows}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == find(r.doc_id)
    left = simhash.deduplicate(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted({find(d) for d in prints})
    assert simhash.near_duplicates(awkward).count() == len(AWKWARD)
    again = simhash.deduplicate(awkward)
    assert again.columns == awkward.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_simhash_links_are_exact_on_random_fingerprints(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    some = set(base.tolist())
    for b in base.tolist():
        for n in (1, 2, 3, 4, 5):
            mask = sum(1 << int(k) for k in rng.choice(64, n, replace=False))
            some.add(int(np.array((b & (2**64 - 1)) ^ mask, np.uint64).astype(np.int64)))
    want = {(a, b) for a in some for b in some if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in some], "fp long")).collect()}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 130)] + [(200, 201)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and all(got[i] == 100 for i in range(101, 130)) and got[201] == 200
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _spots(text):
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [v for v in words[i + 1 : i + 1 + spotsigs.REACH] if v not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    if len(out) >= spotsigs._FEWEST + len(words) // spotsigs._SPARSE:
        return out
    if len(words) < 3:
        return out or {tuple(words)}
    return out | {("", *words[i : i + 3]) for i in range(len(words) - 2)}


def test_spotsigs_count_all_of_a_text_without_anchors(spark):
    same = "alpha beta gamma delta epsilon "
    texts = [same + "zeta eta theta iota " * 5, same + "kappa lambda omicron rho " * 5, same + "zeta eta theta iota " * 5]
    members, pairs = spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = {r.id: r.fingerprint for r in members.collect()}
    assert prints[0] == prints[2] != prints[1] and pairs.count() == 0


def test_spotsigs_likeness_and_next(spark, awkward, empty):
    docs = [(d, t) for d, t, *_ in AWKWARD if d is not None] + [(20 + i, prose(i, 50)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = sorted(((d, t or "") for d, t in docs))
    got = spotsigs.edited_pairs(df, groups=5).select("id", "text", "next_text", "edited", F.round(spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")), 9).alias("a"), F.round(spotsigs.likeness(F.col("sigs"), F.col("next_sigs")), 9).alias("b"))
    jaccard = lambda a, b: round(len(a & b) / len(a | b), 9)
    want = Counter()
    for i, (d, t) in enumerate(order):
        follow = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        want[d, t, follow, edited, jaccard(_spots(t), _spots(edited)), jaccard(_spots(t), _spots(follow))] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert spotsigs.edited_pairs(awkward).count() == len(AWKWARD) and spotsigs.edited_pairs(empty).count() == 0


def test_spotsigs_near_duplicates(spark):
    texts = [prose(i, 90) for i in range(25)]
    texts += [t.replace("stone", "stones", 1) for t in texts[:12]] + [texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, pairs = spotsigs.near_duplicates(docs)
    of = {r.fingerprint: _spots(texts[r.id]) for r in members.collect()}
    want = {tuple(sorted((a, b))) for a in of for b in of if a < b and len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert len({r.fingerprint for r in members.collect() if r.id in (3, 37)}) == 1
    root = {f: f for f in of}
    for a, b in want:
        x, y = sorted((a, b))
        old, new = root[y], root[x]
        root = {f: new if r == old else r for f, r in root.items()}
    ids = {r.id: r.fingerprint for r in members.collect()}
    got = {r.id: (r.class_id, r.n_links) for r in spotsigs.classes(docs).collect()}
    assert got == {i: (min(j for j, g in ids.items() if root[g] == root[f]), sum(f in p for p in want)) for i, f in ids.items()}


def test_spotsigs_near_duplicates_of_awkward_tables(spark, awkward, empty):
    docs = awkward.drop("class_id", "n_links").withColumns({"sigs": F.lit(1), "n": F.lit(2), "class_id": F.lit(3)})
    rows = {r.id: r.class_id for r in spotsigs.classes(docs).collect()}
    assert rows[2] == 1 and rows[3] == 1 and rows[6] == 5 and rows[9] == 9  # null, empty and blank; copies
    assert spotsigs.classes(docs).count() == len(AWKWARD) and spotsigs.classes(empty).count() == 0


def test_quality_model_learns_and_scores_awkward(spark, awkward, empty):
    rng = np.random.default_rng(1)
    junk = ["$$$ ".join(rng.choice(WORDS, 60)) for _ in range(80)]
    examples = [(prose(i, 60), 1) for i in range(80)] + [(t, 0) for t in junk]
    forest = quality_model.train(examples)
    x = np.array([quality_model.statistics(t) for t, _ in examples])
    assert ((forest.score(x) >= 0.7) == np.array([y for _, y in examples])).mean() > 0.97

    def walk(row):  # the flattened trees, one node at a time
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - forest.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:20]), [walk(r) for r in x[:20]])
    out = quality_model.scored(awkward, forest)
    assert all(0 <= r.score <= 1 for r in out.collect()) and set(out.columns) == set(awkward.columns)
    assert quality_model.scored(empty, forest).count() == 0
    assert quality_model.train([]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality_model.train([("a", 1), ("b", 1)]).score(x[:2]) > 0.7).all()


def test_quality_trees_against_naive_boosting():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=60) * 0.3 > 0.2).astype(float)
    weight = rng.uniform(0.5, 2, 60)
    trees, depth, rate, bins, ridge, least = 3, 2, 0.3, 8, 1.0, 1.0
    forest = quality_model.fit(x, y, trees, depth, rate, bins, ridge, least, weight)
    w = weight / weight.mean()
    share = ((w * y).sum() + 0.5) / 61
    logit = np.full(60, np.log(share / (1 - share)))
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))) for f in range(3)]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        value = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)

        def grow(rows, left):
            best = (1e-9, None)
            for f in range(3):
                for c in cuts[f]:
                    low, high = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                    if left and h[low].sum() >= least and h[high].sum() >= least:
                        gain = value(low) + value(high) - value(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (low, high))
            if best[1] is None:
                return {i: -rate * g[rows].sum() / (h[rows].sum() + ridge) for i in rows}
            return grow(best[1][0], left - 1) | grow(best[1][1], left - 1)

        step = grow(list(range(60)), depth)
        logit = logit + np.array([step[i] for i in range(60)])
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-logit)))


def _insulted(i):
    words = prose(i, 60).split()
    rng = np.random.default_rng(i)
    for _ in range(2):
        words.insert(int(rng.integers(0, 60)), str(rng.choice(["grumblewort", "snivelbag", "dratface"])))
    return " ".join(words)


@pytest.fixture(scope="module")
def machine():
    return toxicity.train([(prose(i, 60), 0) for i in range(120)] + [(_insulted(i), 1) for i in range(120)], landmarks=60)


def test_toxicity_tolerates_gaps_and_insertions(machine):
    assert (machine.scores([_insulted(i) for i in range(500, 540)]) >= 0.5).mean() > 0.95
    assert (machine.scores([prose(i, 60) for i in range(500, 540)]) < 0.5).mean() > 0.95
    hidden = ["grumblexwort", "g.r.u.m.b.l.e.w.o.r.t", "sniv-elbag", "s n i v e l b a g", "dratfface"]
    assert (machine.scores([f"{h} {h} and the river" for h in hidden]) >= 0.5).all()


def test_toxicity_scores_the_end_of_a_long_run_of_letters(machine):
    plain = " ".join("".join(prose(3, 60).split()))
    hidden = plain[:-1] + " ".join("snivelbagthe")
    assert (machine.scores([hidden]) >= 0.5).all() and (machine.scores([plain]) < 0.5).all()
    long = " ".join("".join(prose(i, 60) for i in range(6)).replace(" ", ""))
    for insult in ("s n i v e l b a g", "d r a t f a c e"):
        assert (machine.scores([f"{long} {insult}", f"{long} {insult} {long}", f"{insult} {long}"]) >= 0.5).all()
    assert (machine.scores([long]) < 0.5).all()


def test_toxicity_reads_look_alikes_and_marked_off_letters_in_any_token():
    words = "word," * 15
    for text, want in [("1d10t", "idiot"), ("id10t", "idiot"), ("4ssh0l3", "asshole"), (f"{words}sh1t,{words}", "shit"), (f"{words}i.d.i.o.t,{words}", "idiot"), (f"{words}sn1v-elbag", "snivelbag")]:
        assert want in toxicity.readings(text), text
    assert toxicity.readings("2020-01-05") == toxicity.readings("1234") == []


def test_toxicity_sentences_and_windows():
    assert toxicity.sentences('One two. "Three!" four\nfive e.g. six') == [["one", "two."], ['"three!"'], ["four"], ["five", "e.g."], ["six"]]
    lengths = np.array([1, 3, 5, 2])
    a, b = toxicity.windows(lengths)
    w, step = toxicity.WINDOW, toxicity.WINDOW // 2
    want, at = [], 0
    for n in lengths.tolist():
        starts = [0]
        while starts[-1] + w < n:
            starts.append(starts[-1] + step)
        want += [(at + s, min(at + s + w, at + n)) for s in starts]
        at += n
    assert list(zip(a.tolist(), b.tolist())) == want


def _naive_map(string):
    """Weights of all three-symbol subsequences within a span, of unit length, by plain loops."""
    code = lambda c: int(toxicity._CODES[min(ord(c), 0x24F)])
    s = [0, *map(code, string), 0]
    found = Counter()
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + toxicity.SPAN)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                found[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
    size = sum(v * v for v in found.values()) ** 0.5
    return {u: v / size for u, v in found.items()}


def _naive_kernel(a, b):
    """The kernel of two sentences given as strings: all pairs of their strings."""
    maps = [_naive_map(x) for x in a], [_naive_map(x) for x in b]
    pairs = sum(p[u] * q.get(u, 0.0) for p in maps[0] for q in maps[1] for u in p)
    root = lambda some: max(len(some), toxicity.LEAST_WORDS) ** 0.5
    return pairs / root(a) / root(b)


def naive_scores(machine, texts):
    """Scores by the sum over landmarks, each window of each sentence at its words' worst readings."""
    folded = Counter()
    for strings, alpha in machine.support:
        for x in strings:
            for u, v in _naive_map(x).items():
                folded[u] += alpha * v / max(len(strings), toxicity.LEAST_WORDS) ** 0.5
    memo = {}

    def word(token):
        if token not in memo:
            pieces = [p for r in toxicity.readings(token) for p in toxicity._pieces(r)]
            memo[token] = max((sum(v * folded[u] for u, v in _naive_map(p).items()) for p in pieces), default=None)
        return memo[token]

    out = []
    for text in texts:
        values = []
        for sentence in toxicity.sentences(text):
            at = 0
            while True:
                some = [v for t in sentence[at : at + toxicity.WINDOW] if (v := word(t)) is not None]
                if some:
                    values.append(sum(some) / max(len(some), toxicity.LEAST_WORDS) ** 0.5)
                if at + toxicity.WINDOW >= len(sentence):
                    break
                at += toxicity.WINDOW // 2
        values += [word(x) / toxicity.LEAST_WORDS**0.5 for x in toxicity.set_apart(text.lower()) if word(x) is not None]
        top = [max(v + machine.bias, -3.0) for v in sorted(values, reverse=True)[:3]]
        top += [-3.0] * (3 - len(top))
        z = machine.curve[0] + sum(c * v for c, v in zip(machine.curve[1:], top))
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.array(out)


def test_toxicity_against_naive_kernels(machine):
    texts = [_insulted(3), prose(4, 50), "", "one", "a. b! c", "s n i v e l b a g", "x" * 60, "gr.umble,wort 1d10t"]
    assert np.allclose(machine.scores(texts), naive_scores(machine, texts), atol=2e-3)
    # One sentence's value, directly as the sum of its kernels with the landmarks.
    want = sum(alpha * _naive_kernel(["snivelbag", "the"], strings) for strings, alpha in machine.support)
    assert machine.values(["snivelbag", "the"]).sum() / 2**0.5 == pytest.approx(want, abs=1e-3)


def test_toxicity_kernel_is_one():
    some = ["idiot", "idxiot", "the", "window", "a", "aaaa"]
    rows = toxicity.expanded(some)
    kernel = toxicity._dense(rows, rows)
    assert np.allclose(kernel, kernel.T, atol=1e-6) and np.linalg.eigvalsh(kernel.astype(float)).min() > -1e-5
    assert np.allclose(np.diag(kernel), 1, atol=1e-5)
    for x, (code, weight) in zip(some, rows):
        naive = _naive_map(x)
        assert {int((i * toxicity._BASE + j) * toxicity._BASE + k): pytest.approx(v) for (i, j, k), v in naive.items()} == dict(zip(code.tolist(), weight.tolist()))


def test_toxicity_awkward(machine, awkward, empty):
    out = toxicity.scored(awkward, machine)
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == len(AWKWARD)
    assert toxicity.scored(empty, machine).count() == 0
    assert toxicity.train([]).scores(["x"])[0] < 0.01
    assert toxicity.train([("a", 1)]).scores(["x"])[0] > 0.99


def test_sample_is_bounded_and_disjoint(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = labelled.sample(docs, marks, "quality", labelled.fold(F.col("id"), 4) != 2, 300)
    assert 200 < sum(y for _, y in got) < 400 and len(got) < 800
    assert all(zlib.crc32(t[2:].encode()) % 4 != 2 for t, _ in got)


def test_capped_samples_keep_the_mix_of_classes(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    got, weights = labelled.weighted(docs, marks, "quality", F.lit(True), 500)
    mass = {y: weights[y] * sum(v == y for _, v in got) for y in (0, 1)}
    assert abs(mass[1] / (mass[0] + mass[1]) - 0.9) < 0.02
    forest = quality_model.train(got, weights)
    assert abs(1 / (1 + np.exp(-forest.base)) - 0.9) < 0.02
    # One class thinned and weighted is cut where the whole one is.
    worst = np.zeros((2300, 3))
    worst[:, 0] = np.concatenate([np.linspace(-2, 1, 2000), np.linspace(-0.5, 2, 300)])
    y = np.repeat([0.0, 1.0], [2000, 300])
    thin = np.concatenate([np.arange(0, 2000, 8), np.arange(2000, 2300)])
    cut = lambda w, v, **k: -toxicity._curve(w, v, **k)[0] / 8
    assert abs(cut(worst[thin], y[thin], weights={0: 8.0, 1: 1.0}) - cut(worst, y)) < 0.1


def test_licenses_scan_and_inherit(spark, empty):
    files = [
        ("a", "p/LICENSE", "Released under the MIT License."),
        ("b", "p/src/x.py", "import os\nprint(1)"),
        ("c", "p/src/deep/y.py", "# Licensed under the Apache License, Version 2.0."),
        ("d", "p/src/deep/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("e", "p/src/deep/z.py", "code"),
        ("f", "q/w.py", "nothing here about a license to speak of, really"),
        ("g", None, "code"),
        ("h", "p/n.py", None),
        ("h", "p/n.py", None),
        ("i", "top.py", "code"),
    ]
    df = spark.createDataFrame(files, "id string, path string, text string")
    rows = defaultdict(list)
    for r in licenses.inherit(licenses.scan(df, "id", "path", "text")).collect():
        rows[r.id].append((r.effective, r.how, r.from_folder))
    assert rows["a"] == [("MIT", "own", None)] and rows["b"] == [("MIT", "inherited", "p")]
    assert rows["c"] == [("Apache-2.0", "own", None)] and rows["e"] == [("GPL-3.0", "inherited", "p/src/deep")]
    assert rows["f"] == [(None, "none", None)] and rows["g"] == [(None, "none", None)] and rows["i"] == [(None, "none", None)]
    assert rows["h"] == [("MIT", "inherited", "p")] * 2
    assert licenses.inherit(licenses.scan(df.where("false"), "id", "path", "text")).count() == 0


def test_license_texts_headers_and_versions(spark):
    texts = licenses.license_texts()
    rows = [(k, f"whole/{k}", t) for k, t in texts.items()]
    rows += [
        ("MIT", "a/1", "Copyright (c) Someone Corporation. Licensed under the MIT License."),
        ("Apache-2.0", "a/2", "Copyright 2020 The Foo Authors. Licensed under the Apache License, Version 2.0."),
        ("MIT", "a/3", "// Licensed under the MIT license. See LICENSE file in the project root for full license information."),
        ("MIT", "a/4", "SPDX-License-Identifier: MIT"),
        ("Apache-2.0", "a/5", "# Licensed under the Apache License,\n# Version 2.0 (the License); you may"),
        ("GPL-2.0", "a/6", "Licensed under the terms of the GNU General Public License, version 2 or later"),
        ("LGPL-2.1", "a/7", "prose before it. " * 40 + "Licensed under the GNU Lesser General Public License, version 2.1." + " prose after it" * 4000),
        ("MIT", "a/8", texts["MIT"].replace("<year> <copyright holders>", "2024 Jane Doe and contributors")),
        (None, "a/9", "at the MIT campus we ran the license office, and may june come free of charge"),
        (None, "a/10", None),
        (None, "a/11", ""),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "id string, path string, text string"), "id", "path", "text").collect()
    assert {r.path: r.license for r in got} == {p: k for k, p, _ in rows}
    assert all(r.is_license_file == (r.path not in ("a/3", "a/6", "a/7")) for r in got if r.license)


def test_license_whole_text_bound_leaves_none_out(spark):
    # Every text that reaches the cosine passes the bound: license texts thinned word by word.
    rng = np.random.default_rng(6)
    model = licenses.compile_templates(sorted(licenses.license_texts().items()))
    of = dict(zip(model.names, model.vectors))
    rows = []
    for name in ("MIT", "ISC", "GPL-2.0", "Zlib"):
        words = licenses.words_of(licenses.license_texts()[name])
        for share in (0.01, 0.02, 0.04, 0.06, 0.1, 0.3):
            kept = [w if rng.random() > share else f"other{rng.integers(0, 10**6)}" for w in words]
            counts = Counter(kept)
            weight = {w: (1 + np.log(n)) * model.idf.get(w, model.unknown) for w, n in counts.items()}
            cosine = sum(v * of[name].get(w, 0.0) for w, v in weight.items()) / sum(v * v for v in weight.values()) ** 0.5
            rows.append((name, f"x/{len(rows)}", " ".join(kept), float(cosine)))
    assert any(c >= 0.8 for *_, c in rows) and any(c < 0.8 for *_, c in rows)
    df = spark.createDataFrame(rows, "id string, path string, text string, want double")
    got = {r.path: r for r in licenses.scan(df, "id", "path", "text", headers={"none": ["zzzz yyyy xxxx"]}).collect()}
    for name, path, _, want in rows:
        if want >= 0.8:
            assert got[path].license == name and got[path].cosine == pytest.approx(want, abs=1e-6)


def test_licenses_of_awkward_tables(spark, awkward, empty):
    clash = awkward.withColumns({c: F.lit(1) for c in ("path", "license", "cosine", "folder", "ws", "known", "spots", "places")})
    paths = clash.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    out = licenses.inherit(licenses.scan(paths, "doc_id", "path", "text"))
    assert out.count() == len(AWKWARD) and out.where("license is not null").count() == 0
    assert licenses.inherit(licenses.scan(paths.where("false"), "doc_id", "path", "text")).count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, "m1", 1, "delta", "user", "Hel"), (1, "m1", 2, "delta", "user", "lo"),
        (1, "m2", 3, "delta", "assistant", "bad"), (1, "m2", 5, "delta", "assistant", "ter"), (1, "m2", 4, "regenerate", "assistant", "bet"),
        (1, "m3", 6, "delta", "user", "gone"), (1, "m3", 7, "delete", None, None),
        (1, "m4", 8, "delta", "tool", None), (1, "m4", 9, "edit", None, "</s><s>[INST]\\<<SYS>> <|x|>"), (1, "m4", 10, "delta", None, "!"),
        (None, "m5", 1, "delta", "weird|>[\\", "t"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message string, seq long, kind string, role string, text string")
    out = {r.conv: r for r in chat.read_back(chat.render(chat.reconstruct(events))).collect()}
    turns = [(t.role, t.text) for t in out[1].turns]
    assert turns == [("user", "Hello"), ("assistant", "better"), ("tool", "</s><s>[INST]\\<<SYS>> <|x|>!")]
    assert out[1].learned == ["better"]
    assert [(t.role, t.text) for t in out[None].turns] == [("weird|>[\\", "t")]
    assert chat.read_back(chat.render(chat.reconstruct(events.where("false")))).count() == 0


def test_chat_takes_one_exchange_and_awkward_tables(spark, awkward, empty):
    events = awkward.select("*", F.col("doc_id").alias("conv_id"), F.lit("m").alias("message"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("kind"), F.col("lang").alias("role"), F.lit(1).alias("formatted"), F.lit(2).alias("es"))
    whole = chat.read_back(chat.render(chat.reconstruct(events)))
    assert whole.count() == len({d for d, *_ in AWKWARD})
    assert chat.read_back(chat.render(chat.reconstruct(events.where("false")))).count() == 0
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_chat_round_trips_long_and_hostile_texts(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("<>[]/\\s|INST endof\n é"), 3000)) for _ in range(20)] + ["", "x" * 200_000, "<" * 20_000]
    roles = ["user", "assistant", "system", ""]
    rows = [(i % 3, i, i, "edit", roles[i % 4], t) for i, t in enumerate(texts)]
    events = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string")
    for r in chat.read_back(chat.render(chat.reconstruct(events))).collect():
        own = [(roles[i % 4], t) for c, i, _, _, _, t in rows if c == r.conv]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.learned == [t for role, t in own if role == "assistant"]
