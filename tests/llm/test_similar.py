"""Joins on shingles and passages beside brute force, learned operators by held-out accuracy, mixing by its bound."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import common, language_id, mixing, ngram_join, quality, sharing, substring_dedup
from shelfmark.llm.graph import components

SF = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components_by_hand(rows, size, percent):
    sets = [shingles(r.text, size) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r.doc_id)
    return Counter((r.doc_id, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def edited(spark, prose):
    """A family of near copies around the threshold, exact copies, short texts and unrelated ones."""
    rng, rows = random.Random(5), []
    base = prose(11, 120).split()
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    rows += [(300 + i, prose(100 + i, rng.randint(1, 9), "ab")) for i in range(150)]
    rows += [(500 + i, prose(i, 80)) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(edited, messy, size, percent):
    for df in (edited, messy):
        rows = df.select("doc_id", "text").collect()
        got = ngram_join.report(df, ngram_join.Similarity(size, percent)).collect()
        assert Counter(tuple(r) for r in got) == components_by_hand(rows, size, percent)


def test_ngram_join_in_small_blocks(edited, monkeypatch):
    monkeypatch.setattr(ngram_join, "_BLOCK_SETS", 7)
    monkeypatch.setattr(ngram_join, "_COLUMNS", 16)
    got = ngram_join.report(edited, ngram_join.Similarity(4, 85)).collect()
    assert Counter(tuple(r) for r in got) == components_by_hand(edited.collect(), 4, 85)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        percent = int(rng.choice([60, 80, 85, 95]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n * (100 - percent) // (100 + percent) + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            s = ngram_join.Similarity(5, percent)
            assert np.intersect1d(ngram_join.signatures(a, s), ngram_join.signatures(b, s)).size, (trial, n, percent)


def test_keep_one(messy):
    kept = ngram_join.keep_one(messy)
    assert kept.columns == messy.columns
    # One of 1, 1, 2 and one of 8, 9 stay; texts without words all do.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "4", "5", "6", "7", "8", "None", "None"]
    assert ngram_join.keep_one(messy.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == got[100] == 100 and 200 not in got


def test_compact_windows_are_those_of_the_tree():
    rng = np.random.default_rng(1)
    for n in (0, 4, 5, 30, 200):
        h = rng.permutation(n).astype(np.uint64)
        want = set()

        def build(low, high, h=h, want=want):
            if high - low < 5:
                return
            c = low + int(h[low:high].argmin())
            want.add((c, low, high - 1))
            build(low, c)
            build(c + 1, high)

        build(0, n)
        assert set(zip(*map(list, substring_dedup.windows(h, 5)), strict=True)) == want


def hashed(words, size):
    return np.array([hash(tuple(words[i:i + size])) % (1 << 63) for i in range(len(words) - size + 1)], np.uint64)


def passages_by_hand(x, y, passage):
    """All pairs of stretches, matched at their ends, that reach the similarity."""
    ends, out = (np.isin(x, y), np.isin(y, x)), []
    for a in np.flatnonzero(ends[0]):
        for b in np.flatnonzero(ends[0]) + 1:
            for c in np.flatnonzero(ends[1]) if b - a >= passage.least else ():
                for d in np.flatnonzero(ends[1]) + 1:
                    if d - c >= passage.least:
                        u, v = set(x[a:b].tolist()), set(y[c:d].tolist())
                        if 100 * len(u & v) >= passage.percent * len(u | v):
                            out.append((a, b, c, d))
    return out


def test_passages_with_insertions():
    words = [f"w{i}" for i in range(50)]
    x, y = hashed(words, 5), hashed([*words[:25], "new", "words", *words[25:]], 5)
    assert substring_dedup.passages_of(x, y, substring_dedup.Passage()) == [(0, 46, 0, 48)]
    assert substring_dedup.passages_of(y, x, substring_dedup.Passage()) == [(0, 48, 0, 46)]
    passage, reached = substring_dedup.Passage(words=12, size=3), 0
    for seed in range(60):
        rng = random.Random(seed)
        one = [f"w{i}" for i in range(rng.randint(12, 18))]
        two = list(one)
        for k in range(rng.randint(0, 2)):
            at = rng.randrange(1, len(two) - 1)
            two[at:at + rng.randint(0, 1)] = [f"n{k}{i}" for i in range(rng.randint(0, 2))]
        x, y = (hashed([*(f"{s}a{i}" for i in range(rng.randint(0, 5))), *w, *(f"{s}z{i}" for i in range(rng.randint(0, 5)))], 3)
                for s, w in (("x", one), ("y", two)))
        want = passages_by_hand(x, y, passage)
        reached += bool(want)
        for u, v, stretches in ((x, y, [w[:2] for w in want]), (y, x, [w[2:] for w in want])):
            found = substring_dedup.passages_of(u, v, passage)
            assert all(any(a < f[1] and f[0] < b for f in found) for a, b in stretches), seed
    assert reached > 20


def test_two_passages_that_stand_apart_in_the_other_text():
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(70)]
    x, y = hashed(one + two, 5), hashed([*one, *(f"c{i}" for i in range(90)), *two], 5)
    assert sorted(f[:2] for f in substring_dedup.passages_of(x, y, substring_dedup.Passage())) == [(0, 56), (60, 126)]


def test_blocks_find_passages_longer_than_the_least():
    words = [f"w{i}" for i in range(77)]
    x, y = hashed(words, 5), hashed([*words[:37], "some", "other", "words", *words[40:]], 5)
    rows = substring_dedup._compared([(1, 0, x), (2, 10, y)], substring_dedup.Passage())
    assert rows == [(2, 1, 10, 83, 0, 73)]


def test_substring_dedup(spark, messy):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, messy):
        texts = [(r.doc_id, words_of(r.text)) for r in df.select("doc_id", "text").collect()]
        seen = defaultdict(set)
        for k, (_, w) in enumerate(texts):
            for i in range(len(w) - 49):
                seen[tuple(w[i:i + 50])].add((k, i))
        need = defaultdict(set)
        for places in seen.values():
            if len({k for k, _ in places}) > 1:
                for k, i in places:
                    need[texts[k][0]].update(range(i, i + 50))
        got, cover, by_id = substring_dedup.report(df).collect(), defaultdict(set), {d: w for d, w in texts}
        for r in got:
            cover[r.doc_id].update(range(r.start, r.end))
        # Similar passages that are not equal are found as well.
        assert set(need) <= set(cover)
        assert sum(len(need[d] - cover[d]) for d in need) <= 0.01 * sum(map(len, need.values()))
        for r in got:
            if r.doc_id is not None and r.rep_doc_id is not None:
                a, b = (shingles(" ".join(x.decode() for x in by_id[d][s:e]), 5)
                        for d, s, e in ((r.doc_id, r.start, r.end), (r.rep_doc_id, r.rep_start, r.rep_end)))
                assert len(a & b) >= 0.8 * len(a | b)
    assert substring_dedup.report(messy.limit(0)).collect() == []


def test_remove_repeats(messy, prose):
    out = substring_dedup.remove_repeats(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    # The passage stays once among the three documents that have it.
    assert sum(prose(7, 60) in (r.text or "") for r in out.collect()) == 1


def test_passage_twice_in_one_text(spark, prose):
    """The smaller text, which represents, or the larger one has the passage at top and bottom."""
    passage, orders = prose(7, 60), set()
    for seed in range(6):
        rows = [(1, f"{passage} {prose(20 + seed, 300)} {passage}"), (2, f"{prose(40 + seed, 50)} {passage} {prose(60 + seed, 50)}")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        ids = {r.doc_id: r.text_id for r in substring_dedup._rows(df).collect()}
        if (ids[1] < ids[2]) in orders:
            continue
        orders.add(ids[1] < ids[2])
        got = {(r.doc_id, r.start, r.end) for r in substring_dedup.report(df).collect()}
        assert got == {(1, 0, 60), (1, 360, 420), (2, 50, 110)}
        assert sum((r.text or "").count(passage) for r in substring_dedup.remove_repeats(df).collect()) == 1
    assert orders == {True, False}


def test_language_id(spark, messy):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.report(messy).collect() if r.doc_id}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] in ("en", "de", "fr")
    kept = language_id.keep_identified(messy)
    assert kept.columns == messy.columns and {3, 4, 5}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.report(messy.limit(0)).collect() == []
    nothing = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.report(nothing).collect()} == {"und"}
    only = messy.withColumn("lang", F.lit("en"))
    assert {r.lang_pred for r in language_id.report(only).collect()} == {"und", "en"}


def test_quality(spark, messy):
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs, labels).join(labels, "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert sum(r.quality == r.predicted for r in tested) >= 0.95 * len(tested) and all(0 <= r.score <= 1 for r in rows)
    given = spark.createDataFrame([(1, 1), (2, None), (8, 0), (8, 1), (99, 1), (None, 0)], "doc_id long, quality int")
    got = quality.report(messy, given)
    assert got.count() == messy.count() and got.filter("score is null").count() == 0
    assert {r.score for r in quality.report(messy, given.limit(0)).collect()} == {0.5}
    assert quality.report(messy.limit(0), given).collect() == []
    named, column = quality.score(messy.withColumn("score", F.lit(1)), quality.fit(np.zeros((0, 16)), np.zeros(0)))
    assert column == "score_1" and named.count() == messy.count()


def test_mixing(spark, messy):
    counts, weights = {"a": 4000, "b": 900, "c": 40, "d": 333, None: 60}, {"a": 5, "b": 3, "c": 2}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, weights, block_rows=10, each=None).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    assert Counter(r.source for r in got) == Counter(counts)
    slots = {r.mix_slot: r.mix_source for r in got}
    assert sorted(slots) == list(range(len(slots)))
    # While every source lasts, each is less than a block from its share at any time.
    share, had = {"a": 5, "b": 3, "c": 2, mixing.POOL: 1}, Counter()
    for t in range(2 * 11):
        had[slots[t]] += 1
        assert all(abs(had[s] - (t + 1) * w / 11) < 1 for s, w in share.items())
    # Whole rows of a block follow each other, in the order of position.
    assert all(r.mix_slot == q.mix_slot or r.mix_slot < q.mix_slot for r, q in zip(
        sorted(got, key=lambda r: r.mix_position), sorted(got, key=lambda r: r.mix_position)[1:], strict=False))
    out = mixing.mix(messy.withColumn("mix_slot", F.lit("own")), {"a": 2})
    assert out.columns[-3:] == ["mix_source", "mix_slot_1", "mix_position"] and out.count() == messy.count()
    assert mixing.mix(messy, {}).count() == messy.count() and mixing.mix(messy.limit(0), {"a": 1}).collect() == []


def test_every_source_is_a_stream_of_its_own(spark):
    weights, each = {"s0": 6, "s1": 5, "s2": 4}, 2
    df = spark.range(20 * 400).selectExpr("id AS doc_id", "concat('s', id % 20) AS source")
    got = mixing.mix(df, weights, block_rows=10, each=each).collect()
    assert sorted(r.mix_position for r in got) == list(range(8000))
    slots, had = {r.mix_slot: r.mix_source for r in got}, Counter()
    share = {f"s{i}": weights.get(f"s{i}", each) for i in range(20)}
    total = sum(share.values())
    for t in range(total * (40 // 6)):  # as long as the heaviest source lasts
        had[slots[t]] += 1
        assert all(abs(had[s] - (t + 1) * w / total) < 1 for s, w in share.items())


def test_ranges_of_windows_are_of_one_size(spark, monkeypatch):
    """Min-hashes lie near zero; no range of signatures may get many times its share for that."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(" ".join(f"w{rng.random()}" for _ in range(30_000)),) for _ in range(3)], "text string")

    def counted(packed, ranges):
        rows = packed.select("range", F.octet_length("data").alias("bytes"))
        return rows.select(F.col("range").alias("sig"), F.col("bytes").alias("id"), F.lit(ranges).alias("place"))

    monkeypatch.setattr(sharing, "sharers", counted)
    rows = substring_dedup._repeated_windows(docs, substring_dedup.Passage(), 40 * 46 * 300_000 // 8).collect()
    sizes = Counter()
    for number, size, ranges in rows:
        sizes[number] += size
    assert ranges == 40 and max(sizes.values()) < 2 * sum(sizes.values()) / ranges


def test_tied_rows_are_handed_over_in_parts(monkeypatch):
    """Signatures that all owners share come back whole, in pieces of bounded size."""
    monkeypatch.setattr(sharing, "PART_ROWS", 100)
    gathered = sharing.Gatherer(4)
    for owner in range(1, 251):
        gathered.add(np.array([5, 7, 1 << 63], np.uint64), owner)
    batch = gathered._handed()
    parts = [memoryview(d.as_buffer()) for d in batch.column(1)]
    assert max(len(p) for p in parts) <= 24 + 100 * 48
    out = [b for n in range(4) for b in sharing._sharers(
        [p for p, r in zip(parts, batch.column(0).to_pylist(), strict=True) if r == n])]
    assert max(b.num_rows for b in out) <= 100
    got = Counter((r["sig"], r["id"], r["hub"]) for b in out for r in b.to_pylist())
    assert got == Counter((s, i, 1) for s in (5, 7, -(1 << 63)) for i in range(1, 251))


def test_ngram_join_starts_no_workers_for_a_table_of_the_driver(edited, monkeypatch):
    """A table made of a Python list takes a second set of Python workers on every executor."""
    def refused(*args, **options):
        raise AssertionError("createDataFrame in the operator")

    monkeypatch.setattr(type(edited.sparkSession), "createDataFrame", refused)
    _, found = ngram_join.set_components(edited)
    assert found.count() > 0


def test_batches_to_python_are_bounded_in_bytes(spark):
    """Rows of a MB, as packed columns can have, do not travel by their number alone."""
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    got = [r.n for r in common.stored(rows.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) == 40 and max(got) * 1_000_000 <= common.BATCH_BYTES + 1_000_000


def laid_out(spark, texts):
    """Members and shingles of one family, all texts open from end to end."""
    runs = [(i, hashed(text, 5)) for i, text in enumerate(texts, 1)]
    members = spark.createDataFrame(
        [(1, i, 0, len(r) - 1, [(0, len(r) - 1)]) for i, r in runs],
        "family long, id long, low long, high long, open array<struct<low long, high long>>")
    return members, spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in runs], "text_id long, s binary")


def test_parts_of_a_family_do_not_search_for_the_same_stretch_again(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_BLOCK", 10)
    same = [f"w{i}" for i in range(60)]
    texts = [[f"a{k}", *same, f"b{k}"] for k in range(60)]
    rows = substring_dedup._verified_in_blocks(*laid_out(spark, texts), substring_dedup.Passage()).collect()
    assert {r.id for r in rows} | {r.hub for r in rows} == set(range(1, 61))
    # Each text needs one other; every two parts of six once gave a passage of each of their texts.
    assert len(rows) < 2 * len(texts)


def test_texts_of_different_parts_meet(spark, monkeypatch):
    """One stretch of each text is shared within the family by two texts only, wherever these are dealt to."""
    monkeypatch.setattr(substring_dedup, "_BLOCK", 4)
    common_ = [f"w{i}" for i in range(50)]
    texts = [[*common_, f"x{k}", *(f"p{k // 2}-{i}" for i in range(55)), f"y{k}"] for k in range(24)]
    members, shingles_ = laid_out(spark, texts)
    rows = substring_dedup._verified_in_blocks(members, shingles_, substring_dedup.Passage()).collect()
    covered = defaultdict(set)
    for r in rows:
        covered[r.id].update(range(r.start, r.end))
        covered[r.hub].update(range(r.hub_start, r.hub_end))
    for i in range(1, 25):
        assert covered[i] >= {*range(46), *range(51, 102)}, i


def test_longest_stretches_part_by_part():
    """Parts hold every stretch that is matched well enough."""
    rng = random.Random(3)
    for seed in range(300):
        share = rng.choice([80, 90, 100])
        match = np.array([rng.random() < rng.choice([0.05, 0.95]) for _ in range(rng.randint(1, 60)) for _ in range(rng.randint(1, 9))])
        a, b, wide = substring_dedup._longest(match, share)
        apart = substring_dedup._apart(match, share, 1)
        assert max([substring_dedup._longest(match[p:q], share)[2] for p, q in apart], default=0) == wide, seed
        p, q = substring_dedup._around(match, share)
        c, d, again = substring_dedup._longest(match[p:q], share)
        assert again == wide and (not wide or (p + c, p + d) == (a, b)), seed
        total = np.concatenate([[0], np.cumsum(np.where(match, 100 - share, -share))])
        for s in range(len(match)):
            ends = np.flatnonzero(total[s + 1:] >= total[s])
            assert not len(ends) or any(p <= s and s + 1 + ends[-1] <= q for p, q in apart), seed


def test_a_line_in_common_is_no_family(spark, monkeypatch):
    """Texts that share no more than a line and a word here and there are not compared pair by pair."""
    monkeypatch.setattr(substring_dedup, "_BLOCK", 10)
    line, passage = [f"l{i}" for i in range(13)], [f"p{i}" for i in range(60)]
    texts = [[*line, *(f"t{k}-{i}" for i in range(90))] for k in range(100)]
    texts += [[*line, *(f"t{k}-{i}" for i in range(90)), *passage] for k in (100, 101)]
    members, shingles_ = laid_out(spark, texts)
    runs = shingles_.select(F.col("text_id").alias("id"), F.col("s").alias("x"))
    kept = substring_dedup._with_partners(members.join(runs, "id"), substring_dedup.Passage()).collect()
    assert sorted((r.id, r.low, r.high, len(r.x)) for r in kept) == [(101, 89, 158, 8 * 70), (102, 89, 158, 8 * 70)]
    compared = []
    blocks = substring_dedup._blocks_compared
    monkeypatch.setattr(substring_dedup, "_blocks_compared", lambda rows, p: compared.append(rows.count()) or blocks(rows, p))
    found = substring_dedup._verified_in_blocks(members, shingles_, substring_dedup.Passage()).collect()
    assert {(r.id, r.hub, r.start, r.end) for r in found} == {(102, 101, 103, 159)} and sum(compared) == 2


def test_blocks_give_rows_for_what_is_covered():
    """In a family of near copies each text needs a few passages, not those of every pair."""
    rng, runs = random.Random(4), []
    base = [f"w{i}" for i in range(300)]
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(300), 6):
            words[at] = f"x{rng.randrange(20)}"
        runs.append(hashed(words, 5))
    rows = substring_dedup._compared([(i, 0, x) for i, x in enumerate(runs)], substring_dedup.Passage())
    covered = defaultdict(set)
    for a, b, s, e, p, q in rows:
        covered[a].update(range(s, e))
        covered[b].update(range(p, q))
        one, two = set(runs[a][s:e].tolist()), set(runs[b][p:q].tolist())
        assert 100 * len(one & two) >= 80 * len(one | two)
    for i, x in enumerate(runs):
        need = set()
        for j, y in enumerate(runs):
            if i != j:
                for s, e, _, _ in substring_dedup.passages_of(x, y, substring_dedup.Passage()):
                    need.update(range(s, e))
        assert len(need - covered[i]) <= 0.05 * len(need), i
    # Each pair's passages were 173 rows.
    assert len(rows) <= 4 * len(runs)


def test_overlaps_do_not_depend_on_batches(spark, monkeypatch, prose):
    """Windows of many texts are paired at once, whatever batches they come in."""
    texts = [(k, f"{prose(200 + k, 30)} {prose(7, 60)} {prose(300 + k, 30)}") for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    repeated = common.stored(substring_dedup._repeated_windows(docs, substring_dedup.Passage(), 2_000))
    got = []
    for rows in (3, 10_000):
        out = common.stored(substring_dedup._shared_overlaps(repeated, substring_dedup.Passage().least), rows)
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] and len({r[1] for r in got[0]}) == 12
