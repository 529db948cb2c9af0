"""Operators 11 to 13 against plain versions, on sf0.001 and on a table of edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from turmalina.llm import cross_tokenizer_alignment, periodic_runs, source_mixing
from turmalina.llm.queries import ORACLE, PIECES, QUERIES, TOKENIZER
from turmalina.llm.tokens import byte_letters

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, target string, "
          "doc string, taken int, pairs string, start string")
LONG = "several words of one text, " * 30_000


def _row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, 1, 7, "x", "y", 3, "z", "s")


EDGE = [_row(*r) for r in (
    (1, None), (2, ""), (3, " \n\t "), (4, "one", None), (5, "one two three", "b"), (5, "one two three", "b"),
    (None, "null id null id null id null id"), (None, "null id", "c"), (7, LONG), (8, LONG, "b"),
    (9, "▁ mark"), (10, "<|endoftext|> <s> </s> <unk> <0x41> 🙂 ½ l'a'\r\n\tté́ \x00 x"), (11, "  two  blanks   three "),
    (12, "été où ça l'été　x ｘ ﬁ"), (13, "a a a a a a b a b a b a b a b c c"),
    (14, " ".join(["p q r"] * 9 + ["p q x"] + ["p q r"] * 9)), (15, "(){}[];\n\n\n  if (x) {\n\treturn 1;\r\n}\n"),
    (16, "w " * 5000), (17, "x" * 5000), (18, "漢字かな交じり文 " * 20))]


@pytest.fixture(scope="module", params=["docs", "edge", "empty"])
def any_docs(request, spark):
    edge = spark.createDataFrame(EDGE, SCHEMA)
    return {"docs": spark.read.parquet(f"{SF}/documents.parquet"), "edge": edge, "empty": edge.limit(0)}[request.param]


# --- 11 ---

@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {c: x for x, c in byte_letters().items()}

    def tokens(text):
        """(id, end) of both sides, or None where a side's bytes aren't the text's."""
        if not text:
            return None
        raw, out = (" " + text).encode(), []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        out.append([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids])
        out.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                    for i in b.encode(text)])
        if any(b"".join(x for _, x in side) != raw for side in out):
            return None
        return [list(zip([i for i, _ in side], np.cumsum([len(x) for _, x in side]).tolist())) for side in out]

    return tokens


def _plain_alignment(texts, tokens):
    per_doc, counts = [], collections.Counter()
    for text in texts:
        found = tokens(text)
        if found is None:
            per_doc.append(None)
            continue
        a, b = found
        end_b = {e: i for i, e in b}
        links = [(i, end_b[e]) for i, e in a if e in end_b]
        counts.update(links)
        per_doc.append((a, b, links))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for found in per_doc:
        if found is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, links = found
        ends = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        at_a = at_b = 0
        for e in ends:
            to_a, to_b = at_a, at_b
            while to_a < len(a) and a[to_a][1] <= e:
                to_a += 1
            while to_b < len(b) and b[to_b][1] <= e:
                to_b += 1
            groups.append(",".join(str(i) for i, _ in a[at_a:to_a]) + "|" + ",".join(str(i) for i, _ in b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        yield (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
               sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


def test_alignment_equals_plain(any_docs, both, monkeypatch):
    rows = any_docs.collect()
    expected = collections.Counter(
        (r.doc_id, *found) for r, found in zip(rows, _plain_alignment([r.text for r in rows], both)))
    got = collections.Counter(tuple(r) for r in cross_tokenizer_alignment.report(any_docs, TOKENIZER, PIECES).collect())
    assert got == expected
    if any(r.doc_id == 10 and "endoftext" in r.text for r in rows):
        assert sum(r[1] == 0 for r in expected) == 3  # null, empty, the mark


def test_overlaps_and_segments(both, monkeypatch):
    """The alignment in pieces of one text equals the whole one, and holds every overlap."""
    import pyarrow as pa
    text = "Some (words), with\n lines and numbers 1234 " * 40
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    found = {}
    for size in (1 << 20, 200):
        monkeypatch.setattr(cross_tokenizer_alignment, "SEGMENT", size)
        (_, _, parts), = cross_tokenizer_alignment._slices([batch], TOKENIZER, PIECES)
        tokens, pairs, base, n_parts = ([], []), set(), [0, 0], 0
        for frames, at_a, at_b, wrong in parts:
            assert not wrong.any()
            pairs |= {(x + base[0], y + base[1]) for x, y in zip(at_a.tolist(), at_b.tolist())}
            for side, frame in enumerate(frames):
                tokens[side].extend(frame["id"].tolist())
                base[side] += len(frame)
            n_parts += 1
        found[size] = (tokens, pairs)
    assert n_parts > 5 and found[200] == found[1 << 20]
    a, b = both(text)
    start = lambda side, k: side[k - 1][1] if k else 0
    assert found[200][1] == {(x, y) for x in range(len(a)) for y in range(len(b))
                             if max(start(a, x), start(b, y)) < min(a[x][1], b[y][1])}


def test_alignments_tile_the_text(any_docs, both):
    for r in cross_tokenizer_alignment.alignments(any_docs.filter("length(text) < 20000"), TOKENIZER, PIECES).collect():
        assert len(r.ids_a) == len(r.ends_a) and len(r.ids_b) == len(r.ends_b)
        assert r.group_ends == sorted(set(r.ends_a) & set(r.ends_b))
        assert len(r.overlap_a) == (len(r.ids_a) + len(r.ids_b) - len(r.group_ends) if r.ids_a else 0)


# --- 12 ---

def _plain_runs(words, least=6, power=4):
    """All (start, length, period) by looking at every lag."""
    found, n = [], len(words)
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            stretch = words[start:start + length]
            smaller = any(all(stretch[k] == stretch[k - p] for k in range(p, length)) for p in range(1, q))
            if length >= max(least, power * q) and not smaller:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    figures = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *figures, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(kept))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    """Few letters, so that runs are many, overlap and nest."""
    draw = random.Random(seed)
    rows = []
    for _ in range(120):
        row = [draw.randrange(draw.choice([1, 2, 2, 3])) for _ in range(draw.randrange(0, 60))]
        for _ in range(draw.randrange(3)):
            part = [draw.randrange(3) for _ in range(draw.randrange(1, 9))]
            at = draw.randrange(len(row) + 1)
            row[at:at] = part * draw.randrange(2, 7) + part[:draw.randrange(len(part))]
        rows.append(row)
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    words = np.array([w for r in rows for w in r], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row, start, length, period = periodic_runs.periodic_runs(words, bounds)
    got = collections.defaultdict(list)
    for r, s, n, q in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[r].append((s, n, q))
    assert [got[i] for i in range(len(rows))] == [_plain_runs(r) for r in rows]


def test_runs_equal_plain(any_docs):
    small = any_docs.filter("text IS NULL OR length(text) < 6000")
    expected = collections.Counter(_plain_report(r.doc_id, r.text) for r in small.collect())
    got = periodic_runs.report(any_docs).collect()
    ids = {r[0] for r in expected}
    assert len(got) == any_docs.count()
    short = collections.Counter(tuple(r) for r in periodic_runs.report(small).collect())
    assert short == expected
    assert {tuple(r) for r in got if r.doc_id in ids} >= {r for r in expected}


def test_one_word_many_times():
    """A million equal words are one run, in little time."""
    words = np.full(1_000_000, 12345, np.uint64)
    row, start, length, period = periodic_runs.periodic_runs(words, np.array([0, 1_000_000]))
    assert (row.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0], [0], [1_000_000], [1])


def test_runs_and_collapse_agree(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in periodic_runs.runs(docs).collect()] == [(1, 1, 15, 3)]
    assert {r.doc_id: r.text for r in periodic_runs.collapse(docs).collect()} == {1: "x a b c y", 2: ""}


# --- 13 ---

def _plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in clamped)
        if not free:
            break
        level = (total - sum(epochs * sizes[s] for s in clamped)) / free
        more = {s for s in names if s not in clamped and epochs * sizes[s] <= weight[s] * level}
        if not more:
            break
        clamped |= more
    return {s: float(epochs * sizes[s]) if s in clamped else weight[s] * level for s in names}


def test_mix_meets_its_targets(any_docs):
    rows = any_docs.collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    expected = _plain_targets(dict(sizes))
    got = source_mixing.mix(any_docs, keep=any_docs.columns).collect()
    assert collections.Counter((r.doc.doc_id, r.doc.text, r.size, r.source_size, r.target) for r in got) == collections.Counter(
        (r.doc_id, r.text, size(r.text), sizes[r.source], expected[r.source]) for r in rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part and 0 <= r.part <= r.size
    shared = 1 + max(collections.Counter(r.doc_id for r in rows).values(), default=0)
    assert all(abs(taken[s] - expected[s]) <= shared for s in expected)
    again = source_mixing.mix(any_docs.repartition(7), keep=any_docs.columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    other = source_mixing.mix(any_docs, seed=1).collect()
    assert not rows or len(rows) < 100 or sorted(r.taken for r in other) != sorted(r.taken for r in got)


def test_mix_clamps_and_reshares(spark):
    """A small heavy source is clamped; a source without words and many equal ids are no trouble."""
    rows = [(i, "w " * 10, "big") for i in range(300)] + [(i, "w", "a") for i in range(5)] + [(1, " ", "c")]
    rows += [(None, "w " * 4, "d")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = {r.source: r for r in source_mixing.plan(source_mixing.sized(docs)).collect()}
    assert plan["a"].target == 15.0 and plan["c"].target == 0.0
    assert sum(r.target for r in plan.values()) == pytest.approx(3000 + 5 + 160)


def test_repeated_rows_are_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found, texts = collections.Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in source_mixing.repeated(docs).collect():
        found[r.doc_id] += size(r.text)
        assert texts[r.doc_id].startswith(r.text)
    assert found == collections.Counter({r.doc_id: r.taken for r in source_mixing.report(docs).collect() if r.taken})
