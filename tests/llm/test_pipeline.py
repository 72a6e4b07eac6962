"""The pipeline against a plain version of its stages."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline

from .test_operators import BENCHMARK, components_of, corpus, parts, plain_hits, words


def rows():
    more = [(200 + i, words(700 + i, 60, 4000), "fr", f"s{i % 2}", 0) for i in range(30)]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source, _ in corpus() + more]


def accepted(text):
    w = parts(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)


def cut(docs):
    """Without bytes that 100-byte strings repeat; characters go whole, and so do documents that lose all words."""
    seen, out = set(), []
    for i, text, *rest in sorted(docs):
        x = (text or "").encode()
        gone = set()
        for p in range(len(x) - 99):
            gone |= set(range(p, p + 100)) if x[p : p + 100] in seen else set()
            seen.add(x[p : p + 100])
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not set(range(at, at + n)) <= gone:
                kept.append(c)
            at += n
        if not gone or "".join(kept).strip():
            out.append((i, "".join(kept) if text is not None else None, *rest))
    return out


def without_items(text):
    """Without the stretches from the first to the last character of hit words, until there is none."""
    while text:
        spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
        w, hit = [text[a:b].lower() for a, b in spans], set()
        for _, t in BENCHMARK:
            x = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
            size = min(10, len(x))
            for k in range(len(x) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    hit |= set(range(p, p + size)) if w[p : p + size] == x[k : k + size] else set()
        if not hit:
            break
        keep = [True] * len(text)
        for k in hit:
            end = spans[k][1] if k + 1 not in hit else spans[k + 1][0]
            keep[spans[k][0] : end] = [False] * (end - spans[k][0])
        text = "".join(c for c, stays in zip(text, keep, strict=True) if stays)
    return text


def plain_targets(sizes):
    """Targets of the sources: by weight, at most three times a source's size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left, share = total - sum(3 * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full) or 1
        over = {s for s in order if s not in full and weight[s] * left / share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * left / share for s in order}
        full |= over


def test_pipeline(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = [r for r in rows() if accepted(r[1])]
    groups = components_of(docs, 5)
    docs = cut([r for r in docs if groups[r[0]][1] == r[0]])
    clean = []
    for i, text, lang, source, _ in docs:
        n, hit, _ = plain_hits(text, BENCHMARK)
        if hit <= 0.5 * n:
            clean.append((i, without_items(text), lang, source))
    expected = {r[0]: r for r in clean}
    # the mix, by the operator's own places and thresholds over the rows that are left
    sizes = defaultdict(int)
    for r in clean:
        sizes[r[3]] += len(parts(r[1]))
    goals = plain_targets(sizes)
    copies = {}
    for source, size in sizes.items():
        passes = int(goals[source] // size) if size else 0
        left = goals[source] - passes * size
        for r in sorted((r for r in clean if r[3] == source), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()[:12]):
            left -= len(parts(r[1]))
            copies[r[0]] = passes + (left >= 0)
            if left < 0:
                left = -math.inf
    assert {i: r.mix_copies for i, r in got.items()} == {i: n for i, n in copies.items() if n}
    for i, r in got.items():
        assert (r.text, r.lang, r.source, r.n_chars) == (*expected[i][1:], len(expected[i][1])) and r.mix_copies >= 1
    # whole sources with room to spare are all taken; none exceeds three times its words
    for source in {r[3] for r in clean}:
        size = sum(len(parts(r[1])) for r in clean if r[3] == source)
        taken = sum(len(parts(r.text)) * r.mix_copies for r in got.values() if r.source == source)
        assert taken <= 3 * size


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]


def test_odd_tables(spark, tmp_path):
    """No rows; rows without id, repeated ids with unlike texts, equal rows, nulls, a very long text and columns with the stages' own names."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    a, b, c = words("oa", 60, 9000), words("ob", 60, 9000), words("oc", 60, 9000)
    odd = [(1, a, "en", "s", 0)] * 2 + [(1, b, "en", "s", 0), (None, c, "en", "s", 0), (None, c, "en", None, 0), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    odd += [(4, words("long", 200_000, 10**7), "en", "s", 0), (5, a + " and more", "en", "s", 0)]
    names = ["found", "component", "key", "node", "bucket", "size", "place", "n_words", "hits", "kept", "digit", "good", "row", "other_column_0", "dotted.name"]
    names += ["__found", "__id", "__hash", "__number", "__part", "__key", "__n_words", "__places", "__s", "__p", "__t", "_s", "_turn", "rules", "print", "first"]
    docs = spark.createDataFrame(odd, schema).withColumns({x: F.concat_ws("-", F.lit(x), "doc_id") for x in names})
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "mix_copies"]
    rows = got.collect()
    # the only source with words takes all of its words once
    assert Counter((r.doc_id, r.text) for r in rows if r.source == "s") <= Counter([(1, a), (1, b), (None, c), (4, odd[8][1])])
    assert {r.doc_id for r in rows} >= {4} and all(r[x] == (f"{x}-{r.doc_id}" if r.doc_id is not None else x) for r in rows for x in names)
