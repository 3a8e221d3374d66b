"""Extraction, joins, packing, rules, plane files, decontamination, URL filter and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import decontamination, html_extract, ngram_join, packing, plane_format, quality_rules, tokens, url_filter
from lakeweave.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connection, same

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n ", "one", "a b c d e", "x " * 30000, "The end. The end.", "É ß <|endoftext|> tail", "同じ 文", "a\tb\x0bc d"]


def documents(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connection(sf_dir).sql(ORACLE_SQL[name]))


# quality rules


def rules_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices("abc", k=rng.randrange(60))).replace("a b", "a\nb") for _ in range(80)] + ["w%d " % i for i in range(5)] * 2
    got = {r["doc_id"]: r for r in quality_rules.scored(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], rules_by_hand(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablations_read_the_ledger(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book = quality_rules.ledger(docs).cache()
    kept = book.where(quality_rules.passes(F.col("failures"), "v1")).count()
    for r in quality_rules.ablations(book, "v1").collect():
        assert r["kept_without"] == kept + r["failed_alone"] and r["failed_alone"] <= r["failed"]


def test_kept_documents_keep_clashing_columns(spark):
    docs = documents(spark, ["word%d " % i * 3 for i in range(3)] + [" ".join(f"t{k}" for k in range(50))], failures="mine", n_words="x")
    out = quality_rules.kept_documents(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [3]
    assert quality_rules.kept_documents(docs.where("false")).count() == 0


# HTML


PAGE = """<html><head><title>t</title><style>p{x}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies, you know.</div><div id="content"><h2>The  title</h2><p>First &eacute;, with a <a href="#">link</a> in it.<br>More text.
<p>Second &lt;one&gt;, as long as needed.<ul><li>item a<li>item b</ul><div class="ad-box ads">Buy it now, today!</div></div>
<aside>Side text, not wanted.</aside><section class="comments"><p>Great text, I liked it very much, really.</p></section><form>Name</form><footer>All rights.</footer><script>var a = "<p>no</p>"</script></body>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE).split("\n") == ["The title", "First é, with a link in it. More text.", "Second <one>, as long as needed.", "item a", "item b"]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<div>" * 5000 + "deep", "<p>" * 3000, '<a "' * 2000, "&#x0;&bogus;"])
def test_broken_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_extraction_matches_the_templates(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


# n-gram join


def join_by_hand(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], links


def near_copies(seed):
    rng = random.Random(seed)
    texts = list(ODD) + ["a b c d e"]
    for _ in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [256, 3])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_copies(block)
    roots, links = join_by_hand(texts)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(documents(spark, texts, rep="x", bands=1)).collect()}
    assert len(got) == len(texts)
    assert [(got[i]["class_id"], got[i]["n_links"]) for i in range(len(texts))] == [(roots[i], links[i]) for i in range(len(texts))]


def test_join_by_shuffle_and_empty(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    texts = near_copies(9)[:40]
    roots, _ = join_by_hand(texts)
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_join(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == roots
    assert ngram_join.jaccard_join(documents(spark, ["x"]).where("false")).count() == 0


def test_one_of_each_and_repeated_rows(spark):
    same_text = " ".join(f"w{i}" for i in range(30))
    docs = documents(spark, [same_text, same_text, "other words here and there again", None], gone="c")
    out = ngram_join.one_of_each(docs.union(docs))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def unclear_ids():
    """Rows (id, text): near copies with null ids, ids that stand on two texts, and texts without a near copy beside them."""
    base = [[f"{g}{i}" for i in range(60)] for g in "abcdef"]
    text = lambda g, last: " ".join([*base[g][:-1], last])
    return [
        (5, text(0, "u")), (5, text(1, "u")), (7, text(1, "v")), (8, text(0, "v")),
        (None, text(2, "u")), (None, text(2, "v")), (None, text(3, "u")), (None, text(3, "u")), (3, text(3, "v")),
        (9, text(4, "u")), (9, text(5, "u")), (None, text(5, "v")), (None, None), (11, ""),
    ]


@pytest.mark.parametrize(("block", "broadcast"), [(256, 1_000_000), (3, 0)])
def test_join_with_null_ids_and_one_id_on_two_texts(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    rows = unclear_ids()
    roots, links = join_by_hand([t for _, t in rows])
    ids = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        ids[r].append(i)
    want = [(i, min((x for x in ids[r] if x is not None), default=None), links[k]) for k, ((i, _), r) in enumerate(zip(rows, roots, strict=True))]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == Counter(want)


def test_one_of_each_with_null_ids_and_one_id_on_two_texts(spark):
    rows = unclear_ids()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()]
    roots, _ = join_by_hand([t for _, t in rows])
    class_of = {row: root for row, root in zip(rows, roots, strict=True)}
    assert sorted(class_of[row] for row in got) == sorted(set(roots))
    for row in got:
        mates = [i for (i, _), r in zip(rows, roots, strict=True) if r == class_of[row] and i is not None]
        assert row[0] == min(mates, default=None)


def test_chained_groups_meet_by_bucket(spark, monkeypatch):
    """A long chain of texts that each share half of the next, with near copies in it: classes and links as by hand."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2600)]
    texts = [" ".join(words[20 * k : 20 * k + 60]) for k in range(120)]
    for k in range(0, 120, 7):
        w = texts[k].split()
        texts += [" ".join([*w[:50], f"x{k}{j}", *w[51:]]) for j in range(rng.randrange(1, 4))]
    texts += [" ".join(["same"] * 3 + [f"v{j}"] + [f"s{i}" for i in range(60)]) for j in range(40)]  # a group of near copies
    rng.shuffle(texts)
    roots, links = join_by_hand(texts)
    seen = []
    real = ngram_join._groups
    monkeypatch.setattr(ngram_join, "_groups", lambda *a: seen.append(real(*a)) or seen[-1])
    # bands of one row: nearly everything of the chain collides
    monkeypatch.setattr(ngram_join, "choose_bands", lambda threshold, recall, most=128: (24, 2))
    for r in ngram_join.jaccard_join(documents(spark, texts)).collect():
        assert (r["class_id"], r["n_text_links"]) == (roots[r["doc_id"]], links[r["doc_id"]]), r
    modes = {r["band"] >= 0: r["n"] for r in seen[0].groupBy("band").agg(F.count("*").alias("n")).collect()}
    assert modes.get(True)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_places_every_piece_once(lengths):
    capacity = 30
    slots, bins = packing.plan(dict(Counter(lengths)), capacity)
    filled = defaultdict(list)
    for n, number in Counter(lengths).items():
        s = slots[n]
        for r in range(number):
            k = max(i for i, f in enumerate(s.first) if f <= r)
            past = r - s.first[k]
            filled[s.bin[k] + past // s.copies[k]].append((s.offset[k] + past % s.copies[k] * n, n))
    assert len(filled) == bins
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def exact_bins(lengths, capacity):
    """Fewest bins, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - lengths[k]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_reduction_loses_no_bin(lengths):
    fixed, rest = packing.reduce_instance(dict(Counter(lengths)), 12)
    left = [n for n, c in rest.items() for _ in range(c)]
    assert sum(g.count for g in fixed) + exact_bins(left, 12) == exact_bins(lengths, 12)


def test_plans_of_hot_lengths_stay_small():
    import time

    draw = random.Random(5)
    for histogram in ({1000: 10**7}, {700: 10**9, 1: 3}, {680: 10**8, 690: 10**7 + 1, 5: 2}, {n: draw.randrange(1, 10**7) for n in range(1, 2049)}):
        began = time.perf_counter()
        fixed, rest = packing.reduce_instance(histogram, 2048)
        slots, bins = packing.plan(histogram, 2048)
        assert time.perf_counter() - began < (2 if len(histogram) < 9 else 20)
        assert len(fixed) <= 4 * len(histogram) and sum(len(s.first) for s in slots.values()) <= 12 * len(histogram) + 50
        assert bins >= -(-sum(n * c for n, c in histogram.items()) // 2048)
        placed = Counter()
        for g in fixed:
            for n, k in g.items:
                placed[n] += k * g.count
        assert placed + Counter(rest) == Counter(histogram)


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ODD + ["word " * k for k in (1, 40, 2000, 5000)]
    docs = documents(spark, texts, length=3)
    bpe = Tokenizer.from_file(WORD_BPE)
    want = {}
    for i, t in enumerate(texts):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want[i, p] = (a, len(part), zlib.crc32(part.tobytes()))
    rows = packing.pack(docs, WORD_BPE).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len({r["sequence_id"] for r in rows}) == -(-sum(v[1] for v in want.values()) // 2048)
    assert packing.pack(docs.where("false"), WORD_BPE).count() == 0


# token ids


def test_word_by_word_encoding_is_exact():
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(WORD_BPE)
    texts = [t for t in ODD if t] + ["a.b, c...d 's it's. don't! İstanbul ΟΔΟΣ x y　z <|STARTOFTEXT|> q<|endoftext|>r", "a\x1cb\x85c 12.5, x. y.\tz ½ ①", "ﬁ ́a a ́ Ａ", "x.. y., (z). u."]
    got = tokens.encoder(WORD_BPE).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [bpe.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), max_size=12), st.sampled_from([4, 32]), st.integers(1, 40))
def test_shards_round_trip(docs, planes, block):
    out = BytesIO()
    writer = plane_format.ShardWriter(out, block, planes)
    rows = [(None if k == 2 else k, np.array(ids, "<u4").tobytes()) for k, ids in enumerate(docs)]
    for row in rows:
        writer.add(*row)
    writer.close()
    assert list(plane_format.read_shard(BytesIO(out.getvalue()))) == rows


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(WORD_BPE)
    docs = documents(spark, ODD)
    manifest = plane_format.write_tokens(docs, WORD_BPE, 2, block=64, path=f"file://{tmp_path}/shards")
    at = 0
    for r, t in zip(plane_format.read_tokens(manifest).orderBy("doc_id").collect(), ODD, strict=True):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, ids)
        at += len(ids)
    assert plane_format.read_tokens(plane_format.write_tokens(docs.where("false"), WORD_BPE, 2)).count() == 0


# decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("part", [(0, 1), (0, 0.5), (0.5, 1)])
def test_decontamination_finds_edited_passages(spark, part):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    items = [[rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(400)}" for _ in range(rng.randrange(12, 40))] for _ in range(30)]
    texts, want = [], {}
    for d in range(160):
        host = [rng.choice(common) if rng.random() < 0.5 else f"h{rng.randrange(5000)}" for _ in range(rng.randrange(0, 200))]
        if d % 2:
            k = rng.randrange(len(items))
            passage = list(items[k])
            for _ in range(int(0.2 * len(passage))):
                at, kind = rng.randrange(int(part[0] * len(passage)), max(1, int(part[1] * len(passage)))), rng.randrange(3)
                passage[at : at + (kind > 0)] = ["zz%d" % rng.randrange(999)] if kind < 2 else []
            at = rng.randrange(len(host) + 1)
            host[at:at] = passage
            want[d] = k
        texts.append(" ".join(host).replace(" c1 ", "\nC1  "))
    docs = documents(spark, [*texts, *ODD], item_id=5)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert sum((d, k) in found for d, k in want.items()) >= 0.98 * len(want)
    for r in rows:
        stretch = texts[r["doc_id"]].lower().split()[r["start_word"] : r["end_word"]]
        assert edit_distance(stretch, items[r["item_id"]]) == r["distance"] <= int(0.2 * len(items[r["item_id"]]))
    kept = {r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()}
    assert kept == set(range(len(texts) + len(ODD))) - {r["doc_id"] for r in rows}
    assert decontamination.clean_documents(docs, bench.where("false")).count() == docs.count()


def test_near_embeddings_of_near_words():
    """CGK: walks of two sequences a few edits apart read the same word at most steps; those of unlike ones don't."""
    rng = np.random.default_rng(1)
    a = rng.integers(1 << 63, size=60, dtype=np.uint64)
    for other, low, high in ((np.delete(a, [20, 41]), 0.0, 0.5), (rng.integers(1 << 63, size=60, dtype=np.uint64), 0.6, 1.0)):
        apart = []
        for r in range(20):
            both = np.concatenate((a, other))
            reads = np.zeros((64, 2), np.uint64)
            for step, going, read, _ in decontamination.walk(both, np.array([0, 60]), np.array([60, len(both)]), r, np.array([64, 64])):
                reads[step, going] = read
            apart.append((reads[:, 0] != reads[:, 1]).mean())
        assert low <= np.mean(apart) <= high


def test_items_missed_by_the_index_are_held_exactly(spark):
    items = [["a", "b", "c"] * 5, ["x"] * 12, ["q", "r"]]
    words = [decontamination.tokens([" ".join(i).encode()])[1][:-1] for i in items]
    index = decontamination.build_index([1, 2, 3], words, 0.4, recall=1.5, most=2, trials=200)  # a recall that can't be reached
    index.scanned, index.keys = [0, 1, 2], index.keys + np.uint64(1)
    texts = [" ".join(["a", "b", "z", "y"] + ["a", "b", "c"] * 4), "q r", "", None, "x " * 8, "no match here"]
    got = {(t, i): d for t, i, d, *_ in decontamination.matches(index, [None if t is None else t.encode() for t in texts])}
    want = {}
    for t, text in enumerate(texts):
        w = (text or "").split()
        for i, item in enumerate(items, 1):
            best = min((edit_distance(item, w[a:b]) for a in range(len(w)) for b in range(a, len(w) + 1)), default=99)
            if best <= int(0.4 * len(item)):
                want[t, i] = best
    assert got == want


def test_candidates_are_held_against_their_items_together(monkeypatch):
    """Stretches are those of the definition, candidate by candidate, but no candidate has a look-up of its own."""
    rng = random.Random(9)
    items = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 30))] for _ in range(12)]
    texts = [" ".join([f"w{rng.randrange(60)}" for _ in range(rng.randrange(50))] + (items[k % 12][: rng.randrange(30)] if k % 3 else [])).encode() for k in range(150)]
    index = decontamination.build_index(list(range(12)), [decontamination.tokens([" ".join(i).encode()])[1][:-1] for i in items], 0.3, 0.99)
    lookups = []
    plain = np.isin
    monkeypatch.setattr(np, "isin", lambda *a, **k: lookups.append(1) or plain(*a, **k))
    found = decontamination.matches(index, texts)
    monkeypatch.undo()
    assert len(found) > 20 and not lookups

    _, w, n = decontamination.tokens(texts)
    words, sizes = np.delete(w, np.cumsum(n) - 1), n - 1
    ends, want, number = np.cumsum(sizes), set(), 0
    for item, place in zip(*decontamination._candidates(index, words, sizes), strict=True):
        limit, length = index.limits[item], len(index.items[item])
        for text in {int(np.searchsorted(ends, min(max(at, 0), len(words) - 1), side="right")) for at in (place, place + limit)}:
            low, high = max(place - limit, ends[text] - sizes[text]), min(place + length + limit, ends[text])
            number += 1
            if high > low and np.isin(words[low:high], index.items[item]).sum() >= length - limit:
                want.add((int(item), text, int(low), int(high)))
    for piece in (50, 1 << 19):
        monkeypatch.setattr(decontamination, "LOOKED_UP", piece)
        assert set(decontamination._stretches(index, words, sizes)) == want
    assert number > 2 * len(want) > 0


def test_every_item_is_tried_where_repetitions_do_not_suffice():
    """Short items of few words at a high rate, two repetitions: what the index misses is held exactly, all of it."""
    rng = np.random.default_rng(5)
    items = [rng.integers(1, 8, size=10).astype(np.uint64) if k % 2 else rng.integers(1 << 60, size=30, dtype=np.uint64) for k in range(60)]
    index = decontamination.build_index(list(range(60)), items, 0.6, recall=0.99, most=2, trials=600)
    assert len(index.sizes) == 2 and 0 < len(index.scanned) < 60
    picked, fresh = np.repeat(np.arange(60), 30), np.random.default_rng(77)
    missed = decontamination._missed(index, picked, np.resize((0, 1, 2), len(picked)), fresh)
    unheld = [k for k in missed if k not in set(index.scanned)]
    assert len(missed) > 0.02 * len(picked) and len(unheld) <= 0.005 * len(picked)


def test_items_without_an_id_clean_too(spark):
    docs = documents(spark, ["say one two three four five six seven now", "clean text of other words here"])
    bench = spark.createDataFrame([(None, "one two three four five six seven")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()] == [1]
    assert [tuple(r)[:3] for r in decontamination.contaminated(docs, bench).collect()] == [(0, None, 0)]


def test_rows_are_kept_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, "say one two three four five six seven now", "a"), (1, "nothing of it", "b"), (None, "one two three four five six seven", "c"), (None, "else", "d"), (2, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    assert sorted(r["_gone"] for r in decontamination.clean_documents(docs, bench).collect()) == ["b", "d", "e"]


def test_exact_passages_are_all_found(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).where("distance = 0").collect()}
    flat = lambda t: " " + " ".join(t.encode().lower().decode().split(" ")).replace("\n", " ") + " "
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if flat(b["text"]) in flat(d["text"])}
    assert want <= found


# URLs


URLS = [
    (1, "http://a.com", "a.com", "", None, None),
    (2, "http://A.COM/x?y#z", "a.com", "/x", "com/", "allow"),
    (3, "https://Example.com/en/a", "example.com", "/en/a", "example.com/en/", "block"),
    (4, "https://www.example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (5, "https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (6, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (7, "http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    (8, "http://b.net/de/1", "b.net", "/de/1", None, None),
    (9, None, "", "", None, None),
    (10, "no scheme/com/", "", "", None, None),
    (11, "x://h?q=/com/", "h", "", None, None),
    (12, "x://", "", "", None, None),
    (13, "a://b://c.com/d", "b:", "//c.com/d", None, None),
]


@pytest.fixture(scope="module")
def urls_model(spark):
    return url_filter.fit(url_filter.seed_urls(spark))


def test_hosts_paths_and_rules(spark, urls_model):
    pages = spark.createDataFrame([(i, u) for i, u, *_ in URLS], "page_id long, url string").withColumn("label", F.lit("x"))
    got = {r["page_id"]: r for r in urls_model.judged(pages).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in (("allow", "block") if verdict is None else (verdict,))
    assert urls_model.judged(pages.where("false")).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rows = url_filter.seed_urls(spark).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(5))).cache()
    model = url_filter.fit(rows.where("fold > 0"))
    held = model.judged(rows.where("fold = 0"), rules=())
    right = held.select(F.avg(F.when((F.col("verdict") == "block") == (F.col("label") == 1), 1.0).otherwise(0.0))).first()[0]
    assert right >= 0.9
    weights = model.importances()
    assert max(weights.values()) < 0.5 and sum(w > 0 for w in weights.values()) >= 10
    rows.unpersist()


def test_both_verdicts_come_from_the_trees(urls_model, spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = {r["verdict"]: r["count"] for r in urls_model.judged(pages).where("rule IS NULL").groupBy("verdict").count().collect()}
    assert 0 < found["block"] < 0.1 * found["allow"]


def features_by_hand(url, odds):
    from math import log2

    host = path = ""
    url = url or ""
    if "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    m = re.search(r"\?([^#]*)", url)
    query = m[1] if m else ""
    labels = host.split(".")
    words = [w for w in re.split(r"[.\-]", host) if w not in ("", "www", "m")]
    names = [w for w in re.split(r"[.\-0-9]", re.sub(r"\.[^.]*$", "", host)) if w not in ("", "www", "example")]
    longest = max(names, key=lambda w: (len(w), w)) if names else ""
    digits = lambda s: sum(c in "0123456789" for c in s)
    share = [host.count(c) / len(host) for c in set(host)]
    file = re.search(r"\.[A-Za-z0-9]{1,5}$", path)
    keys = {"top": labels[-1], "domain": ".".join(labels[-2:]), "ending": longest[-2:], "file": file[0] if file else ""}
    value = [
        len(url), len(host), len(path), len(labels), sum(x != "" for x in path.split("/")), digits(url) / max(len(url), 1), digits(host), host.count("-"), path.count("-"),
        -sum(p * log2(p) for p in share), sum(x != "" for x in query.split("&")), len(query), max(map(len, labels)), min(map(len, words), default=0), int(bool(re.fullmatch(r"\d+(\.\d+){3}", host))),
    ]
    return dict(zip(url_filter.FEATURES, [*value, *(dict(odds[s]).get(k, 0.0) for s, k in keys.items())], strict=True))


def test_features_by_hand(spark, urls_model):
    urls = [u for _, u, *_ in URLS] + ["http://A-b.Example.org/x/y-z.php?a=1&&b=22#q?z", "https://10.2.3.4/", "http://www.thea12.xyz/p//q.html?", "ü://hö.com/é", "http://a.b/" + "x/" * 5000]
    rows = url_filter.with_host_and_path(spark.createDataFrame([(u,) for u in urls], "url string"))
    got = rows.select("url", *(c.alias(f) for f, c in url_filter.feature_columns(F.col("url"), F.col("host"), F.col("path"), urls_model.odds).items())).collect()
    for r in got:
        for f, want in features_by_hand(r["url"], urls_model.odds).items():
            assert r[f] == pytest.approx(want, abs=1e-9), (r["url"], f)


def test_clashing_names_ties_and_repeated_rows(spark, urls_model):
    names = "page_id url host path rule verdict block_score features probability rawPrediction prediction entropy page".split()
    df = spark.createDataFrame([(1, "http://a.b.org/c/d", *["mine"] * 11)] * 2, "page_id long, " + ", ".join(f"{c} string" for c in names[1:]))
    rules = [("allow", "org", "/c/d"), ("block", "b.org", "/c"), ("allow", "b.org", "/c")]
    out = urls_model.judged(df, rules=rules)
    assert sorted(out.columns) == sorted(names) and len(set(out.columns)) == len(names)
    assert [(r["host"], r["rule"], r["verdict"], r["entropy"], r["features"]) for r in out.collect()] == [("a.b.org", "b.org/c", "block", "mine", "mine")] * 2


# pipeline


def test_pipeline_stages(spark, sf_dir):
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        before, kept = kept, cp.written(stage(spark, kept, sf_dir), name)
        assert kept.columns == columns and kept.exceptAll(before).isEmpty()
        if name == "ngram_jaccard_join":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            ids = sorted(texts)
            roots, _ = join_by_hand([texts[i] for i in ids])
            assert {r["doc_id"] for r in kept.collect()} == {ids[r] for r in roots}
        if name == "quality_rules":
            passed = {r["doc_id"] for r in quality_rules.scored(before).where("kept").collect()}
            assert {r["doc_id"] for r in kept.collect()} == passed
    packed = cp.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}
    assert packed.count() == cp.run(spark, sf_dir).count()


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated ids and rows, an empty table, and columns with the names the stages use."""
    cp = pytest.importorskip("corpus_pipeline")
    draw = random.Random(6)
    prose = [" ".join(draw.choice("river stone garden quiet morning letter under bridge seldom market window answer".split()) + str(draw.randrange(900)) for _ in range(80)) + "." for _ in range(5)]
    names = "doc_id text lang source n_chars _gone _odd set_key _head _rep _twice failures score page rep comp a d".split()
    texts = [None, "", " \n", "word " * 200_000, *prose, prose[0], "x" * 300_000, " ".join(prose) * 40]
    rows = [(k if k % 4 else None, t, "en", "s", 1, *["mine"] * 13) for k, t in enumerate(texts)] + [(5, prose[1], "en", "s", 1, *["mine"] * 13)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names[5:]))
    for start in (docs, docs.where("false")):
        kept = start
        for name, stage in cp.STAGES[:-1]:
            after = cp.written(stage(spark, kept if name != "ngram_jaccard_join" else start, sf_dir), name)
            assert after.columns == docs.columns
            assert after.exceptAll(start).isEmpty() or name == "ngram_jaccard_join"
            kept = after
        texts_left = [r["text"] for r in kept.collect()]
        assert len([t for t in texts_left if t]) == len({t for t in texts_left if t})
        packed = cp.STAGES[-1][1](spark, kept, sf_dir)
        assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_words_with_unusual_letters_are_encoded_exactly():
    """Runs of Latin letters take a short path; near misses of it (marks, case, signs, contractions) must not differ."""
    import random

    from tokenizers import Tokenizer

    bpe, draw = Tokenizer.from_file(WORD_BPE), random.Random(7)
    letters = "abzéèßÿøÀÖØÞµªKÅẞİſŉ'’.,!\"-_0 9²\t́αΣςж日"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    texts += ["don't it's! x'll ''s '…' é'é 're", "á é. ﬁne º × ÷ ½ Ⅷ 12é é12", "x<|endoftext|>y", "", " \n"]
    got = tokens.encoder(WORD_BPE).encode([t.encode() for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, repr(t)
