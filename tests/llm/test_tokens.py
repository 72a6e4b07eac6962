"""Phrases, packing and alignment against plain versions, with nulls, empty and long texts, ties, repeated rows, odd white space and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import alignment, collocations, packing, subwords

from .test_operators import words

LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " ", "\n\t ", "a  b\n c \t", "  lead", "tail  ", "x y z", "　a b　 c", "é 日本語 テスト", "a<|endoftext|> b <s>", "~" * 900 + "é", "▁ a ▁b", "naïve  co\u0000de", "🙂🙃 " * 40]


def texts():
    r = random.Random(7)
    phrase = ["Alpha beta gamma delta", "beta gamma", "new york", "a b. c d", "x"]
    out = [" ".join(r.choice(phrase) if r.random() < 0.6 else f"w{r.randrange(30)}" + r.choice(["", ".", ",", "!"]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return out + out[:3] + ODD


def frame(spark, rows):
    """Rows of doc_id and text, with columns that carry the operators' own names."""
    made = spark.createDataFrame([(i, t, None if k % 9 == 4 else ("en", "de")[k % 5 == 1]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string")
    return made.withColumns({c: F.lit("z") for c in ("key", "n", "row", "chunk", "block", "length", "w0", "part", "ids", "offset")}).repartition(3)


def plain_collocations(rows, least, held, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        best = []
        for p, a in found.items():
            if 100 * longer[p] < held * a:
                score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:most])]
    return sorted(out)


@pytest.mark.parametrize("spec", [collocations.Collocations(least=3), collocations.Collocations(least=2, most=7, held=60)])
def test_collocations(spark, spec, monkeypatch):
    """A small map has many false hits, and blocks are small: neither changes a count."""
    monkeypatch.setattr(collocations, "MAP_BITS", 10)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 700)
    docs = frame(spark, enumerate(texts()))
    rows = [(r.lang or "und", r.text) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations.mined(docs, spec).collect())) == plain_collocations(rows, spec.least, spec.held, spec.most)


def test_collocations_count_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "", 0, 4 * 10**15), ("en", "a", 1, 3 * 10**15), ("en", "b", 1, 10**15), ("en", "a b", 2, 10**15)], "lang string, phrase string, size int, f long")
    (row,) = collocations.scores(found, collocations.Collocations()).collect()
    assert row.score == 2_000_000 * 10**15 // (4 * 10**15)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.mined(empty).count() == 0 and packing.packed(empty).count() == 0 and alignment.scored(empty).count() == 0


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_units_give_the_ids_of_whole_texts(libraries):
    first, second = libraries
    first.encode_special_tokens = True
    data = subwords.Vocabularies().read()
    a, b = subwords.BytePairs(*data[:2]), subwords.Pieces(data[2])
    some = [t for t in texts() if t]
    units = subwords.Units.of(pa.array(some, pa.large_string()))
    for coder, plain in ((a, lambda t: first.encode(" " + t, add_special_tokens=False).ids), (b, second.encode)):
        ids, ends = subwords.dealt(*coder.spaced(units.distinct), units.places)
        ends = np.append(0, ends)[units.starts]
        for t, begin, end in zip(some, ends[:-1], ends[1:], strict=True):
            # the mark of a space in a text is no unit of its own; alignment leaves such texts out
            if "▁" not in t or coder is a:
                assert ids[begin:end].tolist() == plain(t), t


def test_packing(spark, libraries, monkeypatch):
    first = libraries[0]
    first.encode_special_tokens = False
    monkeypatch.setattr(packing, "BLOCK", 40)
    rows = [*enumerate(texts()), (3, "again"), (3, "again"), (None, "no id"), (900, words("long", 3000, 9000))]
    docs, spec = frame(spark, rows), packing.Packing(room=256)
    got = packing.packed(docs, spec, with_ids=True).collect()
    expected = Counter()
    for doc, text in rows:
        ids = first.encode(text or "", add_special_tokens=False).ids + [0]
        cut = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        for piece, (start, end) in enumerate([(0, cut), *((at, at + 256) for at in range(cut, len(ids), 256))]):
            expected[doc, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()), tuple(ids[start:end])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length, tuple(r.ids)))
    for parts in held.values():
        assert [o for o, *_ in sorted(parts)] == [sum(n for _, n, _ in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) <= 256
    least = -(-sum(r.length for r in got) // 256)
    assert len(held) <= least + 3
    made = {r.sequence_id: r for r in packing.sequences(docs, spec).collect()}
    assert {tuple(r.ids) for r in made.values()} == {sum((i for *_, i in sorted(p)), ()) for p in held.values()}
    assert all(sum(s.length for s in r.spans) == len(r.ids) for r in made.values())


def test_sum_of_squares_by_the_definition():
    """Every piece goes where the sum of squares becomes smallest, to the fullest of equal ones."""
    r = random.Random(3)
    sizes = np.array([r.randrange(1, 31) for _ in range(300)])
    sequence, offset = packing.packed_sizes(sizes, 30)
    gaps: dict[int, int] = {}
    for at in np.argsort(-sizes, kind="stable"):
        size = int(sizes[at])

        def after(gap, size=size):
            count = Counter(g for g in gaps.values() if g)
            count[gap] -= 1
            count[gap - size] += 1
            return sum(n * n for g, n in count.items() if g)

        fits = {g for g in gaps.values() if g >= size}
        if fits:
            gap = min(fits, key=lambda g: (after(g), g))
            assert gaps[sequence[at]] == gap
        else:
            gap = 30
            assert sequence[at] not in gaps
        assert offset[at] == 30 - gap
        gaps[sequence[at]] = gap - size


def spell(coder, ids):
    return [bytes([int(coder.id_to_piece(i)[3:5], 16)]) if coder.is_byte(i) else coder.id_to_piece(i).replace("▁", " ").encode() for i in ids]


def plain_alignment(rows, first, second):
    data = subwords.Vocabularies().read()
    table = subwords.BytePairs(*data[:2]).spelled
    found, count = [], Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        left, right = [table[i] for i in a], spell(second, b)
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            found.append((doc, 0, 0, [], Counter()))
            continue
        groups, at, x, y = [], [0, 0], [], []
        for i in range(len(a)):
            x.append(a[i])
            at[0] += len(left[i])
            while at[1] < at[0]:
                y.append(b[sum(len(g[1]) for g in groups) + len(y)])
                at[1] += len(spell(second, y[-1:])[0])
            if at[0] == at[1]:
                groups.append((x, y))
                x, y = [], []
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        count.update(links.keys())
        found.append((doc, len(a), len(b), groups, links))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    return sorted(
        (
            (doc if doc is not None else -1, n_a, n_b, len(groups), sum(links.values()), sum(m for (p, q), m in links.items() if count[p, q] == best[p]), sum(m * count[k] for k, m in links.items()))
            + (hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "",)
            for doc, n_a, n_b, groups, links in found
        ),
        key=str,
    )


def test_alignment(spark, libraries, monkeypatch):
    """Whole texts and byte ranges joined in several rounds, several chunks and parts, wide groups by distinct ids."""
    first, second = libraries
    first.encode_special_tokens = True
    rows = [*enumerate(texts()), (3, "again again"), (3, "again again"), (None, "no id"), (900, words("long", 900, 900)), (901, "日本語 テスト " * 300)]
    expected = plain_alignment(rows, first, second)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(alignment, "WIDE", 4)
    for size, fan in ((1 << 16, 16), (100, 2)):
        monkeypatch.setattr(alignment, "SECTION_BYTES", size)
        monkeypatch.setattr(alignment, "FAN", fan)
        got = sorted(((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, alignment.scored(frame(spark, rows)).collect())), key=str)
        assert got == expected


def test_fragments_are_a_monoid():
    """Tokens cut at any bytes give the fragment of the whole, in whatever order neighbours are joined."""
    tables = alignment.Tables(subwords.Vocabularies().read())
    tokens = alignment.Tokens.of(pa.array(["some words, naïve 日本語 and unbreakable~~~~~~~~ runs of them " * 3], pa.large_string()), tables)
    whole = alignment.Fragment.of(tokens.a, tokens.ends_a, tokens.b, tokens.ends_b, tables).whole(tables)
    r, end = random.Random(1), int(tokens.ends_a[-1])
    for _ in range(25):
        cuts = [0, *sorted(r.sample(range(1, end), r.randrange(1, 12))), end]
        parts = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            in_a, in_b = ((e > low) & (e <= high) for e in (tokens.ends_a, tokens.ends_b))
            parts.append(alignment.Fragment.of(tokens.a[in_a], tokens.ends_a[in_a], tokens.b[in_b], tokens.ends_b[in_b], tables))
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], tables)]
        made = parts[0].whole(tables)
        assert (made.groups, made.n_groups, made.n_a, made.n_b) == (whole.groups, whole.n_groups, whole.n_a, whole.n_b)
        assert np.array_equal(made.pairs, whole.pairs) and np.array_equal(made.times, whole.times) and not len(made.suffix[0])
