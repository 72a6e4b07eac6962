"""Each operator against a plain version, on small rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from gristmill.llm import (
    decontaminate,
    licenses,
    lm_scoring,
    mixing,
    near_duplicates,
    quality_rules,
    resample,
    suffix_dedup,
    suffix_trees,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, a long text, nulls and blanks; a third of the rows come from one source."""
    passage, base = words("p", 60, 5000), words("b", 120, 5000)
    texts = [words(i, 40 + i % 50, 3000) for i in range(30)]
    texts += [base] * 4
    texts += [" ".join(w if k != i * 7 else "other" for k, w in enumerate(base.split())) for i in range(1, 9)]
    texts += [f"{words(900 + i, 15, 3000)} {passage} {words(950 + i, 20, 3000)}" for i in range(6)]
    texts += [None, "", " \n\t", "one two", "one two", "é" * 150, "é" * 150 + "x", "line\nline\nline\n" + words(5, 30), "a b c d e f " * 30]
    texts += [words("long", 3000, 90_000) + " " + base]
    return [(i, t, "en", None if i % 11 == 5 else f"s{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def parts(text):
    return (text or "").encode().split()


def test_quality_rules(docs, spark):
    got = {r.doc_id: r for r in quality_rules.scored(docs).collect()}
    for i, text, *_ in corpus():
        w = parts(text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert quality_rules.scored(empty(spark)).count() == 0
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_packed_and_struct_sorts_agree(docs, monkeypatch):
    usual = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(docs).collect()}
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 4)
    assert usual == {r.doc_id: r.n_repeat_words for r in quality_rules.measured(docs).collect()}


def test_bad_hosts_are_rejected(spark):
    rows = [(i, "a b", "en", "bad", 3) for i in range(40)] + [(100 + i, words(i, 30), "en", "bad" if i < 2 else f"good{i % 4}", 9) for i in range(60)]
    got = quality_rules.scored(spark.createDataFrame(rows, SCHEMA)).where("host_rejected").select("doc_id").collect()
    assert {r.doc_id for r in got} == {*range(40), 100, 101}


def test_mixing(docs, spark):
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    rows = corpus()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(parts(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken, most = defaultdict(int), defaultdict(int)
    for i, text, _, source, _ in rows:
        r = got[i]
        assert r.size == len(parts(text)) and r.source_size == sizes[source]
        assert r.target == pytest.approx(3 * sizes[source] if source in capped else share[source])
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[source] += r.taken
        most[source] = max(most[source], r.size)
    for s in order:
        goal = 3 * sizes[s] if s in capped else share[s]
        assert goal - most[s] <= taken[s] <= goal + 1e-6
    assert got == {r.doc_id: r for r in mixing.mixed(docs.repartition(5)).collect()}
    assert mixing.mixed(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert {r.doc_id: r.mix_copies for r in mixed.collect()} == {i: r.copies for i, r in got.items() if r.copies}


def test_mixing_rows_without_id(spark):
    # a third of each source has no id; the smaller is taken several times, the larger in part
    rows = [(None if i % 3 == 0 else i, words(i, 30, 3000), "en", f"s{i % 10 > 0}", 0) for i in range(300)]
    rows += [(None, None, "en", "s0", 0), (None, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(r.copies is not None and r.taken == r.size * r.copies for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.target] += r.taken
    assert all(goal - 30 <= n <= goal + 1e-6 for goal, n in taken.items())
    documents = mixing.mixed_documents(docs).collect()
    assert Counter((r.doc_id, r.mix_copies) for r in documents) == Counter((r.doc_id, r.copies) for r in got if r.copies)
    assert {r.mix_copies for r in documents if r.doc_id is None} >= {1, 3}


def test_rules_and_mix_of_repeated_rows(spark):
    """Equal rows each count and each get their row; a column named like the mix's own gives way to it."""
    text, bad = words("rr", 40, 3000), "a b c"
    rows = [(1, text, "en", "s", 0)] * 3 + [(1, bad, "en", "s", 0), (2, words("rs", 30, 3000), "en", "t", 0), (2, words("rs", 30, 3000), "en", "t", 0), (3, " ".join(["long"] * 1_000_000), "en", "t", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter((r.doc_id, r.n_words, r.base_failed) for r in quality_rules.scored(docs).collect()) == Counter({(1, 40, False): 3, (1, 3, True): 1, (2, 30, False): 2, (3, 1_000_000, True): 1})
    got = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter({(1, 40, 123): 3, (1, 3, 123): 1, (2, 30, 1_000_060): 2, (3, 1_000_000, 1_000_060): 1})
    mixed = mixing.mixed_documents(docs.withColumn("mix_copies", docs["n_chars"] + 77))
    assert mixed.columns == [*docs.columns, "mix_copies"] and {r.mix_copies for r in mixed.collect()} <= {1, 2, 3}


def plain_hits(text, items, n=10):
    def fold(t):
        return (t or "").encode().translate(decontaminate.FOLD).split()

    w, hit, found = fold(text), set(), set()
    for item, t in items:
        x = fold(t)
        size = min(n, len(x))
        for k in range(len(x) - size + 1 if size else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == x[k : k + size]:
                    hit |= set(range(p, p + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


BENCHMARK = [(2, words("p", 60, 5000)[40:260]), (10, words(3, 40, 3000).upper()), (11, "one, TWO"), (12, None), (13, "!!"), (14, words("none", 30, 10**6))]


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_decontamination(docs, spark, block):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, benchmark, block).collect()}
    for i, text, *_ in corpus():
        n, hit, items = plain_hits(text, BENCHMARK)
        assert (got[i].n_words, len(got[i].places), got[i]["items"]) == (n, hit, items)
    cut = decontaminate.cleaned(docs, benchmark, at_once=block)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r for r in cut.collect()}
    for i, text, *_ in corpus():
        n, hit, _ = plain_hits(text, BENCHMARK)
        assert (i in rows) == (hit <= 0.5 * n)
        if i in rows:
            assert plain_hits(rows[i].text, BENCHMARK)[1] == 0
            assert hit or rows[i].text == text


def test_decontamination_is_the_same_in_blocks(spark):
    one, two = words("one", 20, 10**6), words("two", 20, 10**6)
    inner = words("inner", 12, 10**6).split()
    texts = [
        f"{one} {words(1, 10, 3000)} {two}",  # 40% and 40%: dropped whole
        f"{words(2, 40, 3000)} {' '.join(inner[:6])} {one} {' '.join(inner[6:])} {words(3, 40, 3000)}",  # one cut joins another item's window
        f"{words(2, 40, 3000)} {' '.join(inner[:6])} {two} {' '.join(inner[6:])} {words(3, 40, 3000)}",
        words(4, 30, 3000),
        None,
    ]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    for first in (0, 1):
        benchmark = spark.createDataFrame([(first, one), (first + 10, two), (first + 20, " ".join(inner))], "item_id long, text string")
        whole = {r.doc_id: r.text for r in decontaminate.cleaned(rows, benchmark).collect()}
        assert set(whole) == {1, 2, 3, 4} and len(parts(whole[1])) == len(parts(whole[2])) == 80
        assert {r.doc_id: r.text for r in decontaminate.cleaned(rows, benchmark, at_once=5).collect()} == whole


def test_decontamination_of_repeated_rows_and_equal_hashes(spark, monkeypatch):
    text = words("p", 60, 5000)
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (1, "other words", "en", "s", 0), (None, text, "en", "s", 0), (2, " ".join([text] * 3000), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.scored(docs, benchmark).collect())
    assert got == Counter((i, *plain_hits(t, BENCHMARK)[:2]) for i, t, *_ in rows[:4]) + Counter([(2, 180_000, 3000 * plain_hits(text, BENCHMARK)[1])])
    assert decontaminate.scored(empty(spark), benchmark).count() == 0 and decontaminate.cleaned(empty(spark), benchmark).count() == 0
    # windows with one first hash are told apart by the second
    np = decontaminate.np
    ids = decontaminate.Words().of([b"a", b"b"])
    first, second = (decontaminate.rolled(ids, 2, f) for f in decontaminate.FACTORS)
    for others in ([7], [7, 9], []):
        known = decontaminate.Windows(np.array([2] * (1 + len(others))), np.repeat(first, 1 + len(others)), np.array([*second.tolist(), *others], np.uint64))
        assert known.hits(b"x A b a")[1].tolist() == [False, True, True, False]
    assert not decontaminate.Windows(np.array([2]), first, second + np.uint64(1)).hits(b"a b")[1].any()


def test_decontamination_query_columns(docs, spark):
    r = decontaminate.scored(docs, spark.createDataFrame(BENCHMARK, "item_id long, text string")).where("doc_id = 3").first()
    assert r.contaminated and r.items_sha256 == hashlib.sha256(b"10").hexdigest()
    assert decontaminate.scored(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def components_of(rows, size):
    def shingles(t):
        w = [x.lower() for x in parts(t)]
        n = min(size, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    sets = {i: shingles(t) for i, t, *_ in rows}
    to = {i: i for i in sets}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                to[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(docs, spark):
    expected = components_of(corpus(), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.scored(docs, 4).collect()}
    assert got == expected
    kept = near_duplicates.representatives(docs.unionByName(docs.where("doc_id in (2, 31)")), 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if c == i)
    assert near_duplicates.scored(empty(spark), 4).count() == 0


def test_links_between_members_unlike_the_centre(spark):
    """Texts in a chain and in a loose group: ends are linked only through others, and the smallest id is no centre of all."""
    base = words("c", 80, 9000).split()
    rows = []
    for i in range(40):
        r = random.Random(i)
        w = list(base)
        for k in r.sample(range(0, 80, 8), 1 + i % 6):
            w[k] = f"x{i if i % 3 else 0}_{k}"
        rows.append((100 - i, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.scored(docs, 4).collect()} == components_of(rows, 4)


def test_loose_groups_lose_no_link(spark):
    """Groups of near copies around one text at about the threshold: every link that brute force finds is found, in either kind of round."""
    rows = []
    for group in range(3):
        base = words(f"g{group}", 72, 9000).split()
        for i in range(70):
            r = random.Random(1000 * group + i)
            w = list(base)
            for k in r.sample(range(72), 1 + i % 3):
                w[k] = f"y{group}_{i}_{k}"
            rows.append((1000 - 3 * i - group, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = components_of(rows, 4)
    assert len({c for _, c in expected.values()}) > 20
    for members in (near_duplicates.BLOCK_MEMBERS, 8):
        near_duplicates.BLOCK_MEMBERS, usual = members, near_duplicates.BLOCK_MEMBERS
        try:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.scored(docs, 4).collect()} == expected
        finally:
            near_duplicates.BLOCK_MEMBERS = usual


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id each have their own text: unlike texts stay, equal rows are one, and links of either text count."""
    a, b = words("ra", 60, 9000), words("rb", 60, 9000)
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 2), (5, b, "en", "s", 2), (7, a, "en", "s", 3), (8, b + " more", "en", "s", 4), (9, None, "en", "s", 5), (9, words("rc", 60, 9000), "en", "s", 6), (9, "", "en", "s", 7)]
    rows.append((5, b.upper(), "en", "s", 8))  # the set of another row of its id
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates.scored(docs, 4).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (8, 5), (9, 9)}
    kept = near_duplicates.representatives(docs, 4)
    assert kept.columns == docs.columns
    # of the two spellings of one set the one with the smaller hash stays
    found = sorted((r.doc_id, (r.text or "-").lower(), r.n_chars if r.n_chars < 8 else 2) for r in kept.collect())
    assert found == sorted([(5, a, 1), (5, b, 2), (9, "-", 5), (9, "-", 7), (9, rows[6][1], 6)])


def test_rows_without_id(spark):
    text = words(1, 50)
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1)], SCHEMA)
    assert sorted((r.doc_id is None, r.doc_id) for r in near_duplicates.representatives(docs, 5).collect()) == [(False, 1), (True, None)]
    assert {r.doc_id: r.n_removed for r in suffix_dedup.scored(docs).collect()} == {None: 0, 1: 0, 2: len(text)}
    assert {r.doc_id: r.n_removed for r in suffix_trees.scored(docs).collect()} == {None: 0, 1: 0, 2: 50}


def removed(rows, size, split):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        x = split(t)
        gone = set()
        for p in range(len(x) - size + 1):
            key = tuple(x[p : p + size])
            if key in seen:
                gone |= set(range(p, p + size))
            seen.add(key)
        out[i] = x, gone
    return out


def test_suffix_dedup(docs, spark):
    got = {r.doc_id: r for r in suffix_dedup.scored(docs).collect()}
    for i, (x, gone) in removed(corpus(), 100, lambda t: (t or "").encode()).items():
        kept = bytes(b for k, b in enumerate(x) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(x), len(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.scored(empty(spark)).count() == 0
    cut = suffix_dedup.cleaned(docs)
    assert cut.columns == docs.columns and all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())


@pytest.mark.parametrize("crowded", [1000, 2, 0])
def test_suffix_trees(docs, monkeypatch, crowded):
    from gristmill.llm import repeats

    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "AT_ONCE", max(crowded, 1))
    got = {r.doc_id: r for r in suffix_trees.scored(docs).collect()}
    for i, (x, gone) in removed(corpus(), 20, parts).items():
        kept = b" ".join(b for k, b in enumerate(x) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(x), len(gone), hashlib.sha256(kept).hexdigest())


def test_crowded_and_hot_fronts_change_nothing(docs, monkeypatch):
    from gristmill.llm import repeats

    usual = {r.doc_id: r for r in suffix_dedup.scored(docs).collect()}
    monkeypatch.setattr(repeats, "MANY", 1)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    for crowded in (1000, 2, 0):
        monkeypatch.setattr(repeats, "CROWDED", crowded)
        monkeypatch.setattr(repeats, "REMEMBERED", 20 * crowded)
        assert {r.doc_id: r for r in suffix_dedup.scored(docs).collect()} == usual


def test_order_of_suffixes():
    """The order and the shared digits are those of sorting the suffixes as bytes; nodes are the stretches of leaves that share a depth."""
    from gristmill.llm import repeats

    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(400)) * 2
    at = repeats.np.arange(len(text) - 99)
    digit, digits = repeats.digits_of(repeats.np.frombuffer(text, repeats.np.uint8), at, suffix_dedup.BYTES)
    order, shared = repeats.sorted_suffixes(digit, len(at), digits)
    sorted_bytes = [text[i : i + 100] for i in order]
    assert sorted_bytes == sorted(text[i : i + 100] for i in at)
    for k in range(1, len(at)):
        same = next((i for i in range(100) if sorted_bytes[k][i] != sorted_bytes[k - 1][i]), 104)
        assert shared[k] == same // 8
    shared = repeats.np.array([0, 3, 5, 5, 1, 4, 0, 2])
    assert sorted(suffix_trees.internal_nodes(shared, 1)) == [(1, 0, 5), (2, 6, 7), (3, 0, 3), (4, 4, 5), (5, 1, 3)]
    assert suffix_trees.under_deep_nodes(shared, 5).tolist() == [0, 1, 1, 1, 4, 5, 6, 7]


def test_hot_fronts_have_one_length(spark, monkeypatch):
    from gristmill.llm import repeats

    gram = words("hot gram", 8)
    # few chunks mark the front as shared, most send its runs
    texts = [f"{words(i, 14, 3000)} {gram} {words(100 + i % 5, 14, 3000)} {words(200 + i, 9, 3000)}" for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    hot = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(repeats, "MANY", 1)
    monkeypatch.setattr(repeats, "CHUNK", 150)
    expected = {i: len(gone) for i, (_, gone) in removed(rows, 20, parts).items()}
    for crowded in (1, 12, 30):
        monkeypatch.setattr(repeats, "CROWDED", crowded)
        assert {r.doc_id: r.n_removed for r in suffix_trees.scored(hot).collect()} == expected
    # of a run in question the digit is its front, never its document's number
    found = repeats.shared_fronts(hot, suffix_trees.WORDS).where("NOT repeated").collect()
    kinds = repeats.mixed(repeats.np.arange(len(rows), dtype=repeats.np.uint64)).view(repeats.np.int64).tolist()
    assert found and not {r.digit for r in found} & set(kinds)


def test_repeats_of_repeated_ids(spark):
    """Rows with one id and unlike texts are documents of their own, in order of a hash of the text; equal rows each get the result of one."""
    from pyspark.sql import functions as F

    p = words("passage", 60, 5000)
    rows = [(1, p), (2, words("x", 40, 3000) + " " + p), (2, "short text"), (2, "short text"), (None, p), (3, p + " " + words("y", 30, 3000)), (3, words("z", 30, 3000) + " " + p), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hashes[r[1]]))
    for scored, size, split in ((suffix_dedup.scored, 100, lambda t: (t or "").encode()), (suffix_trees.scored, 20, parts)):
        plain = removed([(k, t) for k, (_, t) in enumerate(ordered)], size, split)
        expected = Counter((i, len(plain[ordered.index((i, t))][1]) if i is not None else 0) for i, t in rows)
        assert Counter((r.doc_id, r.n_removed) for r in scored(docs).collect()) == expected
    cut = suffix_dedup.cleaned(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 2").count() == 3


def bigram_model(texts, vocabulary, spec):
    """P(w | v) from plain counts of texts (lists of words)."""
    one, two = Counter(), Counter()
    for t in texts:
        one.update(["<", *t, ">"])
        two.update(zip(["<", *t], [*t, ">"], strict=True))
    total = sum(n for w, n in one.items() if w != "<")

    def p(v, w):
        alone = (one[w] + spec.smooth) / (total + spec.smooth * len(vocabulary))
        return (two[v, w] + spec.strength * alone) / (one[v] + spec.strength)

    return p


@pytest.mark.parametrize("chars", [12_000_000, 700])
def test_language_models(docs, spark, monkeypatch, chars):
    """Against plain counts that leave each document out; after any word the probabilities of the vocabulary sum to one."""
    monkeypatch.setattr(lm_scoring, "CHUNK_CHARS", chars)
    spec = lm_scoring.LanguageModel()
    rows = [(i, [w.decode().lower() for w in parts(t)]) for i, t, *_ in corpus()] + [(3, ["again", "again"])]
    more = docs.unionByName(spark.createDataFrame([(3, "Again again", "en", "s", 0)], SCHEMA))
    good = spark.createDataFrame([(i,) for i in range(0, 20)] + [(None,), (5,), (777,)], "doc_id long")
    vocabulary = {w for _, t in rows for w in t} | {">"}
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.scored(more, good).collect()}
    assert len(got) == len({(i, len(t)) for i, t in rows})
    for k, (i, t) in enumerate(rows):
        others = [(j, x) for m, (j, x) in enumerate(rows) if m != k and x]
        r = got[i, len(t)]
        if not t:
            assert r.target_loss is r.background_loss is r.loss_difference is None
            continue
        if k % 7 and i not in (3, 31):
            continue
        for column, model in (("target_loss", [x for j, x in others if j < 20]), ("background_loss", [x for _, x in others])):
            p = bigram_model(model, vocabulary, spec)
            assert getattr(r, column) == pytest.approx(-sum(math.log(p(v, w)) for v, w in zip(["<", *t], [*t, ">"], strict=True)) / (len(t) + 1))
            for v in (t[0], t[-1], "<", "nowhere"):
                assert sum(p(v, w) for w in vocabulary) == pytest.approx(1)
        assert r.loss_difference == pytest.approx(r.target_loss - r.background_loss)
    # texts that occur again are less of a surprise to the rest
    assert got[30, 120].background_loss < min(r.background_loss for (i, _), r in got.items() if i < 30)
    assert lm_scoring.scored(empty(spark), good).count() == 0
    uniform = lm_scoring.scored(docs, good.limit(0)).where("doc_id = 1").first()
    assert uniform.target_loss == pytest.approx(math.log(len(vocabulary - {"again"})))


def test_resampling(docs, spark):
    good = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    spec = resample.Resampling(share=0.4)
    got = resample.resampled(docs, good, spec).collect()
    k = int(0.4 * len(got))
    assert sum(r.kept for r in got) == k
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.key)[:k]}
    again = resample.resampled(docs.repartition(7), good, spec).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(r.doc_id, r.kept) for r in again}
    assert resample.resampled(empty(spark), good, spec).count() == 0
    tied = spark.createDataFrame([(i, 1.0) for i in range(10)], "doc_id long, key double")
    assert resample.largest(tied, 4).where("kept").count() == 4
    assert resample.largest(tied, 0).where("kept").count() == 0 and resample.largest(tied, 99).where("kept").count() == 10


def test_resampling_prefers_text_like_the_target(spark):
    rows = [(i, words(i, 60, 50), "en", "s", 0) for i in range(60)] + [(100 + i, words(i, 60, 50).replace("w", "zz"), "en", "s", 0) for i in range(60)]
    got = resample.resampled(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in range(30)], "doc_id long"), resample.Resampling(share=0.5))
    assert got.where("kept AND doc_id < 60").count() >= 57


def test_licenses(spark):
    from gristmill.llm.license_texts import TEXTS, templates

    filler = words("license", 300, 3000)
    mit = TEXTS["MIT"]
    texts = [
        ("text\nLicensed under CC BY-NC 4.0.\nmore", {(1, "CC-BY-NC-4.0")}),
        ("Licensed under the Apache License, Version 2.0.", {(0, "Apache-2.0")}),
        ("a\nThis work is licensed under the GNU General Public License, version 3.\nb\nReleased under the MIT License.", {(1, "GPL-3.0"), (3, "MIT")}),
        ("Released under the MIT License.\nLicensed under CC BY 4.0.", {(0, "MIT"), (1, "CC-BY-4.0")}),
        ("Released under the MIT License. Licensed under CC BY 4.0. All rights reserved.", {(0, "MIT"), (0, "CC-BY-4.0"), (0, "all-rights-reserved")}),
        (f"{filler}\n\nCopyright (c) 2020 Someone\n{mit}\n{filler}", {(3, "MIT")}),
        (mit.replace("free of charge", "without charge").replace("\n", "\r\n\r\n"), {(0, "MIT")}),
        ("# SPDX-License-Identifier: Apache-2.0\ncode", {(0, "Apache-2.0")}),
        (f"{TEXTS['BSD-3-Clause']}\n{TEXTS['ISC']}", {(0, "BSD-3-Clause"), (5, "ISC")}),
        (TEXTS["BSD-2-Clause"].upper(), {(0, "BSD-2-Clause")}),
        ("This work is licensed under the GNU General Public License, version 4.", set()),
        ("The copyright page was lost; she had the right to be reserved, all of it", set()),
        ("All rights reserved.\n" * 3, {(0, "all-rights-reserved"), (1, "all-rights-reserved"), (2, "all-rights-reserved")}),
        (f"{filler} " * 50 + "\u0130 Licensed under CC BY-SA 4.0", {(0, "CC-BY-SA-4.0")}),
        (None, set()),
        ("", set()),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, (t, _) in enumerate(texts)] + [(0, texts[0][0], "en", "s", 0, "x"), (None, texts[1][0], "en", "s", 0, "x")], SCHEMA + ", license string")
    got = licenses.scanned(docs).collect()
    confirmed = Counter((r.doc_id, r.line, r.license) for r in got if r.confirmed)
    expected = Counter((i, line, name) for i, (_, found) in enumerate(texts) for line, name in found) + Counter([(0, 1, "CC-BY-NC-4.0"), (None, 0, "Apache-2.0")])
    assert confirmed == expected
    near = next(r for r in got if r.doc_id == 10)
    assert not near.confirmed and near.missing_words and near.license in ("GPL-2.0", "GPL-3.0")
    assert next(r for r in got if r.doc_id == 6).extra_words == ["without"]
    assert licenses.scanned(empty(spark)).count() == 0
    assert len({text for _, text in templates()}) == len(templates())


def test_licenses_against_plain_search(spark):
    """Every template, at random places among other words: what plain search finds as a run of words is what is confirmed, and nothing else is."""
    from gristmill.llm.license_texts import templates

    r = random.Random(8)
    rows = []
    for i in range(120):
        pieces = [words(f"{i}-{k}", r.randrange(5, 60), 500) for k in range(3)]
        for _ in range(r.randrange(3)):
            text = r.choice(templates())[1]
            pieces.insert(r.randrange(4), text if r.random() < 0.6 else text.upper().replace(" ", "\n"))
        rows.append((i, "\n".join(pieces), "en", "s", 0))
    got = defaultdict(set)
    for x in licenses.scanned(spark.createDataFrame(rows, SCHEMA)).where("confirmed").collect():
        got[x.doc_id].add(x.license)
    known = [(name, licenses.words_of(text)) for name, text in templates()]
    for i, text, *_ in rows:
        w = licenses.words_of(text)
        spans = [(p, p + len(t), name) for name, t in known for p in range(len(w) - len(t) + 1) if w[p : p + len(t)] == t]
        # a notice inside a longer one is not told apart
        outer = {name for a, b, name in spans if not any(c <= a and b <= d and d - c > b - a for c, d, _ in spans)}
        assert got[i] == outer


def test_url_filters(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = [("a", "x.org", True, day(10)), ("a", "x.org", False, day(50)), ("a", "x.org", True, day(90)), ("b", "sub.x.org", True, day(0)), ("b", "sub.x.org", False, day(0)), ("c", "y.net", True, day(5)), (None, "z", True, day(1)), ("c", "q.net", True, None)]
    entries = spark.createDataFrame(entries, "list string, pattern string, added boolean, at timestamp")
    urls = ["http://x.org/a", "https://User@SUB.X.org:80/p?x", "http://notx.org/", "nothing", None, "http://y.net"]
    rows = [(1000 * i + d, u, day(d)) for i, u in enumerate(urls) for d in (0, 9, 10, 49, 50, 89, 90, 300)] + [(99999, "http://x.org", None)]
    got = {r.page_id: r for r in url_filters.evaluated(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp"), entries).collect()}
    assert len(got) == len(rows)
    for page, url, at in rows:
        host = {urls[0]: "x.org", urls[1]: "sub.x.org", urls[5]: "y.net"}.get(url)
        active = at is not None and ((host in ("x.org", "sub.x.org") and (day(10) <= at < day(50) or at >= day(90))) or (host == "y.net" and at >= day(5)))
        assert got[page].blocked == bool(active), (url, at)


def test_url_filters_keep_rows(spark):
    import datetime as dt

    at = dt.datetime(2024, 3, 1)
    schema = "page_id long, url string, fetched_at timestamp, lists string, pattern string, host string, month int"
    rows = [(1, "http://x.org/a", at)] * 3 + [(1, "http://x.org/b", at), (1, None, at), (1, None, at), (None, "http://x.org/a", at), (2, "x" * 2_000_000, at), (3, "http://" + "a." * 30 + "x.org/" + "p" * 1_000_000, at)]
    captures = spark.createDataFrame([(*r, "l", "p", "h", 1) for r in rows], schema)
    entries = spark.createDataFrame([("a", "x.org", True, dt.datetime(2024, 1, 1))] * 2, "list string, pattern string, added boolean, at timestamp")
    got = url_filters.evaluated(captures, entries)
    assert Counter((r.page_id, r.blocked, r.lists, r.n_lists) for r in got.collect()) == Counter({(1, True, "a", 1): 4, (1, False, "", 0): 2, (None, True, "a", 1): 1, (2, False, "", 0): 1, (3, True, "a", 1): 1})
    assert url_filters.evaluated(captures, entries.limit(0)).where("blocked").count() == 0 and url_filters.evaluated(captures, entries.limit(0)).count() == len(rows)
    assert url_filters.evaluated(captures.limit(0), entries).count() == 0


def plain_grams(text, buckets):
    import xxhash

    h = [xxhash.xxh3_64_intdigest(w.lower()) for w in parts(text)]
    two = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:], strict=False)]
    return [x % buckets for x in h] + [(x ^ (x >> 29)) % buckets for x in two]


def test_resampling_against_plain_counts(docs, spark):
    """Ratios, weights, noise and the sample from plain counts; rows without id, repeated rows and clashing columns."""
    import xxhash
    from pyspark.sql import functions as F

    spec = resample.Resampling(buckets=97, share=0.5, smooth=0.5, seed=3)
    rows = [(i, t) for i, t, *_ in corpus()] + [(None, words("n1", 30, 3000)), (None, words("n2", 30, 3000)), (4, words(4, 44, 3000)), (4, "unlike")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "good", "kept", "bucket")})
    good = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(4,), (None,)], "doc_id long")
    named = {*range(0, 40, 3), 4}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(plain_grams(t, 97))
        target.update(plain_grams(t, 97) if i in named else [])
    totals = [sum(c.values()) + 0.5 * 97 for c in (raw, target)]
    ratio = [math.log((target[b] + 0.5) / totals[1]) - math.log((raw[b] + 0.5) / totals[0]) for b in range(97)]
    expected = []
    for i, t in rows:
        weight = sum(ratio[b] for b in plain_grams(t, 97))
        even = ((xxhash.xxh3_64_intdigest(str(i), 3) >> 11) + 0.5) / 2**53
        expected.append((i, weight, weight - math.log(-math.log(even))))
    got = resample.resampled(more, good, spec).collect()
    order = lambda x: (x[0] is None, x[0], x[1])
    for r, (i, weight, key) in zip(sorted(((r.doc_id, r.log_weight, r.key) for r in got), key=order), sorted(expected, key=order), strict=True):
        assert r[0] == i and r[1] == pytest.approx(weight) and r[2] == pytest.approx(key)
    k = len(rows) // 2
    least = sorted((key for *_, key in expected), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= least - 1e-9) for r in got)


def test_resampling_takes_tied_rows_in_part(spark):
    """Equal rows, rows without id, and equal keys of unlike ids: the sample holds exactly its share."""
    for rows in ([(1, "a b c")] * 100, [(None, "a b c")] * 100, [(i // 3, "same words here") for i in range(100)]):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = resample.resampled(frame, spark.createDataFrame([(1,)], "doc_id long"))
        assert got.count() == 100 and got.where("kept").count() == 75


def test_decontamination_in_blocks_with_clashing_columns(docs, spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    names = ["__key", "__n_words", "__places", "key", "hits"]
    more = docs.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in names})
    got = decontaminate.cleaned(more, items, at_once=2)
    assert got.columns == more.columns
    expected = {r.doc_id: r.text for r in decontaminate.cleaned(docs, items).collect()}
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == expected and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names)


def test_clashing_columns(docs, spark):
    """Columns that carry the names of an operator's own survive, with their values."""
    from pyspark.sql import functions as F

    names = ["found", "n_words", "size", "place", "source_size", "good", "passes", "threshold", "base_failed", "kept", "__found", "__id", "__key", "__s", "__p", "__t"]
    more = docs.where("doc_id IS NOT NULL").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    for out in (quality_rules.accepted(more), near_duplicates.representatives(more, 5), suffix_dedup.cleaned(more), decontaminate.cleaned(more, benchmark), mixing.mixed_documents(more)):
        assert out.columns[: len(more.columns)] == more.columns
        assert out.where(" OR ".join(f"NOT {c} <=> concat('{c}', doc_id)" for c in names)).count() == 0
