"""The ten operators against plain versions, on sf0.001 and on a table of edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turmalina.llm import (
    best_fit_packing, common, decontamination, hidden_markov, hilbert_sharding, language_id, nearest_neighbours,
    ngram_jaccard_join, packed_matrices, pii, tokens, url_filter,
)
from turmalina.llm.common import held_out
from turmalina.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "long words of one very long text " * 20_000
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, n string, spans int"
EDGE = [  # the last three columns clash with names that operators use
    (1, None, "en", "a", 0, 1, "x", 1), (2, "", None, None, None, None, None, None), (3, " \n\t ", "en", "b", 3, 1, "x", 2),
    (4, "one", "en", "a", 3, 1, "x", 2), (5, "one two three", "de", "a", 3, 1, "x", 2), (5, "one two three", "de", "a", 3, 1, "x", 2),
    (None, "mail me at x.y@example.com or +1 (017) 555-0199 now", "en", "a", 3, 1, "x", 2),
    (7, LONG, "en", "a", 3, 1, "x", 2), (8, LONG, "en", "b", 3, 1, "x", 2), (9, LONG + " end", "en", "b", 3, 1, "x", 2),
    (10, "été où ça l'été, it's 4111 1111 1111 1111 and 10.0.0.256 or 010.1.2.3.4\n\n  x", "fr", "c", 3, 1, "x", 2),
    (11, "12345 678", None, "c", 9, 1, "x", 2), (12, "a@b.c@d.e.f +1+22 33 44 55 66", "en", "c", 9, 1, "x", 2),
    (13, "<|endoftext|> 🙂 ½ l'a'", "fr", "c", 9, 1, "x", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC_SCHEMA)


@pytest.fixture(scope="module", params=["docs", "edge", "empty"])
def any_docs(request, docs, edge):
    return {"docs": docs, "edge": edge, "empty": edge.limit(0)}[request.param]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def multiset(rows):
    return collections.Counter(rows)


def test_packing_is_whole_and_tight(any_docs, tokenizer):
    rows = best_fit_packing.pack(any_docs, TOKENIZER).collect()
    expected, total = collections.Counter(), 0
    for r in any_docs.collect():
        ids = ids_of(tokenizer, r.text)
        total += len(ids)
        head = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            expected[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert multiset((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert sum(n for _, n in own) <= 1024
    assert len(by_sequence) <= -(-total // 1024) * 1.02 + 1


@pytest.mark.parametrize("plan", [best_fit_packing.matching, packed_matrices.decreasing])
def test_plans_use_each_piece_once(plan):
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = dict(collections.Counter(rng.integers(1, 65, rng.integers(1, 400)).tolist()))
        runs = plan(counts, 64)
        assert all(sum(n * c for n, c in contents) <= 64 for _, contents in runs)
        used = collections.Counter()
        for n, contents in runs:
            for length, copies in contents:
                used[length] += n * copies
        assert used == counts
        large = sum(c for x, c in counts.items() if 3 * x > 64)
        assert all(sum(c for x, c in contents if 3 * x > 64) <= 2 for _, contents in runs) or not large


def test_matrices_hold_every_document(any_docs, tokenizer):
    rows = packed_matrices.matrices(any_docs, TOKENIZER).collect()
    found = collections.defaultdict(list)
    for r in rows:
        line = np.frombuffer(r.ids, "<u4")
        assert len(line) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[:-1] == r.position_resets
        assert r.n_tokens == r.cu_seqlens[-1] and not line[r.n_tokens:].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found[d].append((s, tuple(line[a:b].tolist())))
    expected = collections.defaultdict(list)
    for r in any_docs.collect():
        ids = ids_of(tokenizer, r.text)
        head = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(head, len(ids) + 1, 1024)]
        expected[r.doc_id] += [(a, tuple(ids[a:b])) for a, b in zip(edges, edges[1:])]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_encoder_of_a_worker_stays_small(tokenizer):
    """However many distinct pieces a worker has met, what it keeps of them is some 30 MB."""
    encoder = tokens.Encoder(TOKENIZER)
    for part in range(6):
        text = " ".join(f"q{i:x}" for i in range(part * 100_000, (part + 1) * 100_000)).encode()
        rows = list(encoder.rows(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    assert rows[0][-40:].tolist() == ids_of(tokenizer, text.decode()[-400:])[-41:-1]
    assert sum(a.nbytes for a in (encoder.keys, encoder.values, encoder.ids, encoder.ends)) <= 32 << 20


def shingles(text, width=4):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def linked(rows, percent=85):
    """(n_shingles, component_id) per row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                comp = [comp[i] if c == comp[j] else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return multiset((rows[k][0], len(sets[k]), least[comp[k]]) for k in range(len(rows)))


def test_jaccard_components(any_docs):
    rows = [(r.doc_id, r.text) for r in any_docs.collect()]
    got = ngram_jaccard_join.jaccard_components(any_docs)
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)


def test_jaccard_chains_of_near_copies(spark):
    """Many near copies of one text, some linked only through others."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for d in range(1, 150):
        own = base[:]
        for at in rng.choice(200, rng.integers(0, 7), replace=False):
            own[at] = f"x{rng.integers(1000)}"
        rows.append((d, " ".join(own)))
    rows += [(1000 + d, " ".join(base[:60] + [f"y{d}_{i}" for i in range(140)])) for d in range(40)]  # a shared passage only
    got = ngram_jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)


def test_large_group_beside_many_texts_meets_more_pivots(spark, monkeypatch):
    """How far a group is paired out goes by its members, however many other texts there are."""
    base = [f"w{i}" for i in range(100)]
    rows = [(d, " ".join([f"u{d}_{i}" for i in range(8)])) for d in range(1000, 4000)]
    rows += [(d, " ".join(base[:d] + base[d + 20:])) for d in range(80)] + [(99, " ".join(base))]
    pivots, seen = ngram_jaccard_join._pivots, []
    monkeypatch.setattr(ngram_jaccard_join, "_pivots", lambda lists, percent: seen.append(1) or pivots(lists, percent))
    got = ngram_jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)
    assert len(seen) > 1


def test_index_pairs_and_sets_are_moved_in_parts(spark, monkeypatch):
    """What lies on disk at a time is a part of the index, the pairs and the sets, and no prefix once
    the index is there."""
    rng = np.random.default_rng(5)
    rows = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(60)]
        for d in range(6):
            own = base[:]
            own[rng.integers(60)] = f"x{d}"
            rows.append((100 * group + d, " ".join(own)))
    rows += [(5000, rows[0][1]), (5001, None), (None, rows[-1][1]), (5002, "two words"), rows[7]]
    parts, held, handed = {}, {}, ngram_jaccard_join.written_in_parts

    def seen(spark, part_of, n, name):
        out = handed(spark, part_of, n, name)
        parts[name] = max(n, parts.get(name, 0))
        held[name] = [f.columns for f in common._handed if "prefix" in f.columns]
        return out

    monkeypatch.setattr(ngram_jaccard_join, "written_in_parts", seen)
    monkeypatch.setattr(ngram_jaccard_join, "PART", 50)
    monkeypatch.setattr(ngram_jaccard_join, "PARTS", 2)
    got = ngram_jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)
    assert min(parts[name] for name in ("entries", "pairs", "whole", "found")) > 1
    assert len(held["entries"]) == 1 and not held["pairs"] and not held["found"]


def test_lists_of_one_group_have_one_pivot(spark):
    """Also a list that the group's best class is not in is held against it."""
    rows = [(key, 0) for key in range(5)] + [(key, c) for key in range(5) for c in range(1, 9) if (key + c) % 4]
    rows += [(9, c) for c in range(1, 9)]
    lists = spark.createDataFrame([(k, c, 100) for k, c in rows], "key bigint, cid bigint, n bigint")
    pairs = {(r.a, r.b) for r in ngram_jaccard_join._pivots(lists, 85).collect()}
    assert pairs == {(c, 0) for c in range(1, 9)}


def test_missed_shingles_rule_out_pairs_of_a_size_list(spark):
    """Two classes pair by size only if each may reach the other's size with what it has of the pivot."""
    rows = [(1, 10, 100, 10, 101), (1, 11, 101, 11, 99), (1, 12, 101, 12, 100)]
    lists = spark.createDataFrame(rows, "key bigint, cid bigint, n bigint, comp bigint, reach bigint")
    assert {(r.a, r.b) for r in ngram_jaccard_join._list_pairs(lists, 85).collect()} == {(10, 12)}


def test_one_of_each(edge):
    kept = ngram_jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "None", "7", "10", "11", "12", "13"])


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub(r"[^0-9]", "", m.group())]
        if 13 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) in range(0, 1000, 10):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans(any_docs):
    got = pii.report(any_docs, pii.learn(any_docs)).collect()
    expected = collections.Counter()
    for r in any_docs.collect():
        spans = plain_spans(r.text or "")
        line = ",".join("%s:%d:%d" % s for s in spans)
        counts = [sum(k == s[0] for s in spans) for k in pii.KINDS]
        expected[r.doc_id, *counts, hashlib.sha256(line.encode()).hexdigest()] += 1
    assert multiset((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"please call us at +49 30 {1000000 + 37 * i} soon, sheet {i} of 2024") for i in range(40)]
    rows += [(100, "please call us at 030 1234567 soon"), (101, "nothing to see, sheet 7 of 2024")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    patterns = pii.learn(docs)
    got = {r.doc_id: r for r in pii.report(docs, patterns).collect()}
    assert got[100].n_phone == 0 and got[100].spans == "phone:18:29" and got[101].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs, patterns).collect()}
    assert masked[100] == "please call us at <phone> soon" and masked[101] == rows[-1][1]


def test_hidden_markov_scores(any_docs):
    rows = any_docs.collect()
    got = hidden_markov.score(any_docs, held_out(F.col("doc_id"), 7, 2), own=50, cached=80, rounds=2).collect()
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2 for r in rows]
    tokens = [words(r.text) + [None] for r in rows]
    count = collections.Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(count.values()), len(count)
    expected = sorted((str(r.doc_id), h, len(own), sum(count[w] > 0 for w in own), n,
                       round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), 5))
                      for r, own, h in zip(rows, tokens, held))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if len(rows) == 200:
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_forward_and_expected_counts_are_exact():
    rng = np.random.default_rng(5)
    K, C, T = 3, 5, 6
    start, move, emit = rng.dirichlet(np.ones(K)), rng.dirichlet(np.ones(K), K), rng.dirichlet(np.ones(C), K).T
    text = rng.integers(0, C, T)
    paths = list(itertools.product(range(K), repeat=T))
    p = [start[s[0]] * np.prod([move[a, b] for a, b in zip(s, s[1:])]) * np.prod([emit[w, k] for w, k in zip(text, s)]) for s in paths]
    got = hidden_markov.forward(np.concatenate([text, text[:2]]), np.array([0, T, T, T + 2]), (start, move, emit))
    assert got[0] == pytest.approx(np.log10(sum(p))) and got[1] == 0
    begins = np.zeros((T, 1), bool)
    begins[0] = True
    s, m, e = hidden_markov.expected_counts(text[:, None], begins, tuple(x.astype(np.float32) for x in (start, move, emit)))
    moves = np.zeros((K, K))
    for path, q in zip(paths, p):
        for a, b in zip(path, path[1:]):
            moves[a, b] += q / sum(p)
    assert np.allclose(m, moves, atol=1e-4) and np.isclose(s.sum(), 1, atol=1e-4) and np.isclose(e.sum(), T, atol=1e-3)


def test_hilbert_curve_visits_neighbours(spark):
    grid = spark.createDataFrame(list(itertools.product(range(4), repeat=3)), "a long, b long, c long")
    rows = sorted(hilbert_sharding.with_curve(grid, ["a", "b", "c"], 2).collect(), key=lambda r: r.curve)
    assert [r.curve for r in rows] == list(range(64))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(rows, rows[1:]))


def test_shards(any_docs):
    rows = hilbert_sharding.shard(any_docs).collect()
    expected = multiset((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in any_docs.collect())
    assert multiset((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


ITEMS = [(1, "the of"), (2, "One two, three"), (3, None), (4, ""), (None, "mail me at x"), (5, "long words of one very long text long words of one VERY")]


@pytest.mark.parametrize("block_words", [1_000_000, 6])
def test_decontamination(spark, any_docs, block_words):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").union(spark.read.parquet(f"{SF}/benchmark.parquet"))
    items = items if block_words > 6 else items.limit(9)
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = alnum(r.text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i:i + size])].add(r.item_id)
    sizes = {len(w) for w in windows}
    expected = collections.Counter()
    for r in any_docs.collect():
        w, hit, found = alnum(r.text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        names = sorted(str(i) for i in found if i is not None)
        expected[r.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    got = decontamination.report(any_docs, items, block_words=block_words).collect()
    assert multiset((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected


def test_clean_leaves_no_window(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = decontamination.clean(docs, items, max_coverage=1.0)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    hit = {r.doc_id for r in decontamination.report(docs, items).collect() if r.contaminated}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all((r.text != before[r.doc_id]) == (r.doc_id in hit) for r in clean.collect())


def test_nearest_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] + [0.1] * 63), (None, [0.1] * 64),
                                 (10_060, [1.0, 2.0]), (10_080, [None] * 64), (10_100, [float("inf")] * 64)], "vec_id bigint, embedding array<float>")
    copies = vectors.filter("vec_id = 40").select(
        F.explode(F.sequence(F.lit(20_000).cast("long"), F.lit(20_039).cast("long"))).alias("vec_id"), "embedding")
    table = vectors.union(odd).union(copies).union(vectors.filter("vec_id = 3"))
    got = nearest_neighbours.nearest(table, table.filter("vec_id % 20 = 0"), target=0.97).collect()
    good = vectors.union(copies).collect()
    ids, x = np.array([r.vec_id for r in good]), np.array([r.embedding for r in good], float)
    by_query = collections.defaultdict(list)
    for r in got:
        by_query[r.query_id].append(r)
    assert set(by_query) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        s = (x * x[ids == q][0]).sum(1)
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len(set(best) & {r.vec_id for r in own})
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hits / (20 * len(by_query)) >= 0.9
    few = vectors.filter("vec_id < 5")
    assert nearest_neighbours.nearest(few, few.filter("vec_id = 0")).count() == 4
    assert nearest_neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


URLS = [(1, None), (2, "no scheme"), (3, "http://A.Example.com/en/x?y"), (4, "http://www.example.com/en/"), (5, "http://x.www.example.com/en/a"),
        (6, "https://net/es/"), (7, "https://b.net/fr/#t"), (8, "https://b.net/fr"), (9, "https://notnet.org/es/"), (10, "http://example.com"),
        (11, "ftp://x.com?/en/"), (12, "://"), (12, "://"), (None, "http://fooexample.com/en/"), (13, "http://s.org/a\nb/c")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in URLS], "page_id bigint, url string, host string, path string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    expected = collections.Counter()
    for i, u in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        expected[i, host, path, best[2], best[1]] += 1
    assert multiset((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expected
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.org/{'pills' if i % 2 else 'news'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(5, None, None)], "doc_id bigint, quality int, toxic int")
    got = url_filter.judge(pages, labels, min_support=0.01).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) and r.rule is None for r in got)


def test_long_urls_lose_no_combination(spark):
    """Pages of 14 frequent tokens and more: the tokens that only together tell bad pages are the rarest."""
    rng, rows = random.Random(3), []
    for i in range(300):
        told, bad = [t for t in ("ra", "rb") if rng.random() < 0.45], i % 10 == 0
        told = ["ra", "rb"] if bad else told[:1]
        rows.append((["t" + c for c in "abcdefghijklmnopqrst" if rng.random() < 0.7] + told, bad))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    assert max(len(own) for own, _ in rows) > url_filter.MOST
    got = {tuple(sorted(r["items"])): round(r.confidence, 9) for r in url_filter.mine(labelled, min_support=0.05).collect()}
    tokens, kept = sorted({t for own, _ in rows for t in own}), {}
    sets = [(set(own), bad) for own, bad in rows]
    for size in (1, 2, 3, 4):
        for items in itertools.combinations(tokens, size):
            if not any(set(k) < set(items) for k in kept):
                on = [bad for own, bad in sets if own.issuperset(items)]
                if on and sum(on) >= 15 and sum(on) / len(on) >= 0.5:
                    kept[items] = round(sum(on) / len(on), 9)
    assert got == kept and kept[("ra", "rb")] == 1
    whole = url_filter.mine(labelled, min_support=0.05, most=99).collect()
    assert {tuple(sorted(r["items"])): round(r.confidence, 9) for r in whole} == kept


def test_language_id(any_docs):
    rows = any_docs.withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    got = language_id.identify(rows, language_id.learn(rows.filter("NOT held_out")), ("doc_id", "held_out", "lang", "text")).collect()
    assert len(got) == any_docs.count()
    for r in got:
        lettered = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    if len(got) == 200:
        assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_code_lengths_are_those_of_a_plain_ppm():
    rng = np.random.default_rng(2)
    S, order = 5, 2
    text = [0] * order + rng.integers(0, S - 1, 60).tolist()
    grams = np.zeros(S ** (order + 1), np.int64)
    for i in range(order, len(text)):
        grams[text[i] + S * text[i - 1] + S * S * text[i - 2]] += 1
    table = language_id.code_lengths(grams, S, order)
    for one, two, symbol in itertools.product(range(S), repeat=3):  # nearest byte, the one before, the coded one
        bits, seen, done = 0.0, set(), False
        for depth in range(order, -1, -1):
            context = [one, two][:depth]
            n = collections.Counter(text[i] for i in range(order, len(text)) if [text[i - 1], text[i - 2]][:depth] == context and text[i] not in seen)
            if n:
                whole = sum(n.values()) + (len(n) if len(seen | set(n)) < S else 0)
                if symbol in n:
                    bits, done = bits + math.log2(whole / n[symbol]), True
                    break
                bits += math.log2(whole / len(n))
            seen |= set(n)
        if not done:
            bits += math.log2(S - len(seen))
        assert table[symbol + S * one + S * S * two] == pytest.approx(bits, abs=1e-4)
    assert np.allclose((2.0 ** -table.reshape(-1, S)).sum(1), 1, atol=1e-5)


def test_languages_of_minority_scripts(spark):
    """Many Latin rows with many letters don't leave two small languages without symbols of their own."""
    latin = "the quick brown fox jumps over 13 lazy dogs; 'pack' my (box) with: five, dozen. liquor-jugs? 2456789 0! "
    cyrillic = {"ru": "быстрая лиса прыгает через ленивую собаку", "uk": "швидка лисиця їде ґанком і стрибає"}
    rows = [(i, latin * 20, "en") for i in range(60)]
    rows += [(100 + i, text, lang) for i, (lang, text) in enumerate(sorted(cyrillic.items()) * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for cached in (1 << 19, 10, 0):
        model = language_id.learn(docs, cached=cached)
        got = language_id.identify(docs, model, ("doc_id", "lang", "text")).collect()
        assert all(r.lang == r.lang_pred for r in got)
        swapped = spark.createDataFrame([(1, "\u043b\u0438\u0441\u0430"), (2, "\u0457\u0434\u0435")], "doc_id bigint, text string")
        assert [r.lang_pred for r in sorted(language_id.identify(swapped, model).collect())] == ["ru", "uk"]


def test_code_lengths_tell_all_bytes_apart(spark):
    """A text's cost is that of a plain PPM over 256 byte values."""
    learning = [bytes(range(33, 127)).decode().lower() * 2, "jkjk \u00e7\u00ea\u00fc\u00df jk", "kkkj"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(learning)], "doc_id bigint, text string, lang string")
    model = language_id.learn(docs, cached=7)
    counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for t in learning:
        data = b"   " + t.encode()
        for i in range(3, len(data)):
            for depth in range(4):
                counts[depth][data[i - depth:i]][data[i]] += 1
    for text in ("jk", "kj", "\u00fc\u00df", "zq\u4e2d"):
        data, bits = b"   " + text.encode(), 0.0
        for i in range(3, len(data)):
            seen = set()
            for depth in range(3, -1, -1):
                n = {b: c for b, c in counts[depth][data[i - depth:i]].items() if b not in seen}
                if data[i] in n:
                    bits += math.log2((sum(n.values()) + len(n)) / n[data[i]])
                    break
                bits += math.log2((sum(n.values()) + len(n)) / len(n)) if n else 0
                seen |= set(n)
            else:
                bits += math.log2(256 - len(seen))
        own = np.frombuffer(text.encode(), np.uint8)
        code = language_id._grams(own, np.array([0, len(own)]), 3)
        assert model.bits(code).sum() == pytest.approx(bits, abs=1e-4)


def test_added_tokens_have_their_own_ids(spark):
    """Against an unchanged tokenizer, which splits texts on the file's added tokens first."""
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one two <|endoftext|><|endoftext|> \u00a0x, y", "cut here <|endof", "text|> and on", "", "plain"]
    plain = Tokenizer.from_file(TOKENIZER)
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    ids = [ids_of(plain, t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in best_fit_packing.pack(docs, TOKENIZER).collect()}
    assert packed == {d: (len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for d, own in enumerate(ids)}
    found = {}
    for r in packed_matrices.matrices(docs, TOKENIZER).collect():
        line = np.frombuffer(r.ids, "<u4").tolist()
        found |= {d: line[a:b] for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:])}
    assert found == dict(enumerate(ids))


def test_support_and_spans_do_not_depend_on_size(spark):
    """A context of ten seeds counts beside many seeds, and patterns that are joined say the same."""
    texts = F.when(F.col("id") < 10, F.concat(F.lit("rare desk at +49 30 "), (F.col("id") + 1000000).cast("string"), F.lit(" soon")))
    texts = texts.otherwise(F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@example.com")))
    docs = spark.range(1_100_000).select(F.col("id").alias("doc_id"), texts.alias("text"))
    patterns = pii.learn(docs, rounds=1)
    assert patterns["desk at _number"] == "phone"
    few = docs.limit(40).union(spark.createDataFrame([(-1, "rare desk at 030 1234567 soon"), (-2, None)], "doc_id bigint, text string"))
    one = pii.learn(few)
    many = pii.learn(few, most=0)
    assert isinstance(one, dict) and not isinstance(many, dict)
    assert sorted(pii.report(few, one).collect()) == sorted(pii.report(few, many).collect())
    assert multiset(pii.mask(few, one).collect()) == multiset(pii.mask(few, many).collect())
    assert {r.doc_id: r.text for r in pii.mask(few, many).collect()}[-1] == "rare desk at <phone> soon"


def test_the_encoder_keeps_the_library_tokenizer_only_where_a_text_needs_it():
    own = tokens.Encoder(TOKENIZER)

    def ids(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [row.tolist() for row in own.rows(data, np.array([0, len(data)]))][0]

    plain = Tokenizer.from_file(TOKENIZER)
    for text, needed in (("one two, three", False), (f"one {own.added[0].decode()} two", True)):
        assert ids(text) == plain.encode(text, add_special_tokens=False).ids
        assert (own._plain is not None) == needed
