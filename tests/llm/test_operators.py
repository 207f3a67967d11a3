"""Every operator against brute force, on documents with nulls, empty and long texts, copies, ties and clashing columns, and on no documents."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm import components as graph
from vellum.llm import decontaminate, language, near_join, pieces, spotsigs, suffix_tree, token_counts, token_shards, toxicity, vectext, voronoi, warc, wavelet
from vellum.llm.common import shared_folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def spaced(text: str) -> list[str]:
    return [w for w in re.split("[ \t-\r]+", lowered(text or "")) if w]


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)


def expected(rows, f):
    return sorted(((r[0], *f(r[1] or "")) for r in rows), key=repr)


def test_hashes_agree_with_words():
    texts = ["a bb  a", "", "ccc\nbb", "x" * 2_000_000]
    found = {}
    for a, b, chunk in vectext.chunks(texts):
        starts, hashes, first = vectext.spaced_words(chunk)
        for i in range(b - a):
            for w, h in zip(texts[a + i].split(), hashes[first[i] : first[i + 1]].tolist(), strict=True):
                assert found.setdefault(w, h) == h == vectext.hash_text(w)
    assert len(set(found.values())) == len(found)


def contaminated(items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text or ""))
        for i in range(max(len(w) - 9, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))

    def f(text):
        w = WORD.findall(lowered(text))
        hit, its = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    its |= windows[tuple(w[i : i + k])]
        return len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)

    return f


@pytest.mark.parametrize("block", [250_000, 7])
def test_decontaminate(spark, docs, rows, none, block):
    base = rows[0][1].split(" ")
    items = [(1, " ".join(base[5:18]).upper()), (2, "four words, are here"), (3, None), (4, "..."), (10, " ".join(base[7:17])), (11, "日本語")]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.report(docs, table, block_windows=block), *columns) == expected(rows, contaminated(items))
    assert decontaminate.report(none, table).count() == 0
    if block == 7:
        return
    assert not any(r.contaminated for r in decontaminate.report(docs, table.where("false")).collect())
    kept = decontaminate.decontaminate(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not contaminated(items)(r[1] or "")[4] for r in rows)
    cut = decontaminate.decontaminate(docs, table, remove="spans")
    assert cut.count() == len(rows) and not any(r.contaminated for r in decontaminate.report(cut, table).collect() if r.doc_id != 24)


def test_spot_signatures(docs, rows, none):
    found = [tuple(r) for r in spotsigs.compared(docs).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    for k, row in enumerate(ordered):
        a, b = row[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        x, y, z = (spotsigs.signature_sets([t])[0] for t in (a, edited, b))
        want = (row[0], len(a), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint(x), spotsigs.fingerprint(y), spotsigs.likeness(x, y), spotsigs.likeness(x, z))
        assert want in found
    assert len(found) == len(rows)
    assert spotsigs.compared(none).count() == 0


def test_spot_signatures_cover_every_content_word():
    rare = [f"rare{i}" for i in range(200)]
    texts = [" ".join(["the", *rare]), " ".join([*rare, "the"]), "rare0 of", " ".join(rare[:100] + ["the"] + rare[100:])]
    for text, own in zip(texts, spotsigs.signature_sets(texts), strict=True):
        assert len(own) >= len(text.split()) - 1 - spotsigs.CHAIN
        for i, w in enumerate(words := text.split()):
            if w.startswith("rare"):  # another word in its place is another fingerprint
                other = spotsigs.signature_sets([" ".join([*words[:i], "changed", *words[i + 1 :]])])[0]
                assert not np.array_equal(own, other) and spotsigs.likeness(own, other) > 0.9 - (len(words) < 9)
    assert all(len(x) for x in spotsigs.signature_sets(["the", "word the", "the of", "!", "a b the"]))


def test_spot_signature_matches(spark):
    rng = random.Random(6)
    rows: list[tuple] = [(100, None), (101, ""), (102, "  "), (103, "word")]
    for i in range(24):
        if i % 6 == 0:
            words = [rng.choice(["the", "of", "w%d" % rng.randrange(999), "v%d" % rng.randrange(999)]) for _ in range(80)]
        else:
            words = list(words)
            words[rng.randrange(80)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows.append((200, rows[5][1]))
    links, members = spotsigs.matches(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    sets = {r[0]: set(spotsigs.signature_sets([r[1] or ""])[0].tolist()) for r in rows if r[0] is not None}
    name = {m.doc_id: m.class_id for m in members.collect()}
    want = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.add((min(name[a], name[b]), max(name[a], name[b])))
    assert {(r.a, r.b) for r in links.collect()} == want and want


def test_wavelet_matrix():
    rng = random.Random(5)
    ids = np.array([rng.choice([0, 1, 7, 40_000, 9]) for _ in range(3000)], np.uint32)
    w = wavelet.WaveletMatrix(wavelet.encode(ids, np.arange(2), np.array([0, 1000, 3000])))
    assert (w.all() == ids).all() and [w.access(i) for i in range(600)] == ids[:600].tolist()
    assert w.count(7) == (ids == 7).sum() and w.count(8) == 0 and w.rank(9, 1234) == (ids[:1234] == 9).sum()
    assert w.occurrences(40_000)[:50] == np.flatnonzero(ids == 40_000)[:50].tolist()
    assert (w.document(0) == ids[:1000]).all()
    with pytest.raises(IndexError):
        w.access(3000)
    assert len(wavelet.WaveletMatrix(wavelet.encode(np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(1))).all()) == 0


def test_token_shards(spark, docs, rows, none):
    library = token_shards.tokenizer("word_bpe_49k.json")
    folder = shared_folder(spark, "shards")
    found = sorted((tuple(r) for r in token_shards.read_shards(token_shards.write_shards(docs, folder, shard_tokens=2000), folder).collect()), key=lambda r: r[1])
    coded = sorted(((r[0] is not None, r[0] or 0, np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], np.uint16).tobytes()) for r in rows))
    start = 0
    for got, (known, doc, raw) in zip(found, coded, strict=True):
        ids = np.frombuffer(raw, np.uint16)
        assert got == (doc if known else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    folder = shared_folder(spark, "shards")
    assert token_shards.read_shards(token_shards.write_shards(none, folder), folder).count() == 0


def components(rows):
    sets = []
    for r in rows:
        w = spaced(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups: dict[int, list] = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


def edited_groups():
    """Chains and stars of near copies, and one passage that many other texts share."""
    rng = random.Random(9)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage, out = fresh(40), []
    for _ in range(12):
        text = fresh(rng.randrange(8, 150))
        for k in range(rng.randrange(1, 7)):
            copy = list(text)
            for at in rng.sample(range(len(copy)), min(len(copy), k)):
                copy[at] = fresh(1)[0]
            out.append(" ".join(copy))
            if k % 2:
                text = copy
    for n in (3, 30, 60, 100):
        out.append(" ".join(fresh(n) + passage))
    return [(i, t) for i, t in enumerate(out)]


def prose(seed: int, n: int, name: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "tion", "er", "ing", "ha", "wh", "st"], "de": ["der", "und", "sch", "ung", "keit", "ö", "ä", "ei"]}[name]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def linked_sets(seed, groups, copies, words, edits):
    """Groups of near copies around a text, some far enough from each other to be no links."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        text = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(words)]
        for _ in range(copies):
            copy = list(text)
            for at in rng.sample(range(words), rng.randrange(edits + 1)):
                copy[at] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_jaccard_join(spark, docs, rows, none):
    assert by_id(near_join.join(docs), "n_shingles", "component_id") == components(rows)
    assert near_join.join(none).count() == 0
    small = edited_groups()
    assert by_id(near_join.join(spark.createDataFrame(small, "doc_id long, text string").repartition(3)), "n_shingles", "component_id") == components(small)


@pytest.mark.parametrize(("limit", "edits"), [(20, 3), (20, 9), (6, 5)])
def test_regions_that_no_task_holds(spark, limit, edits, monkeypatch):
    """Pivots, Voronoi cells with copies of boundary sets, further levels, and blocks where there is no progress."""
    monkeypatch.setattr(voronoi, "PIVOTS", 5)
    monkeypatch.setattr(voronoi, "LEAF", 3)
    rng = random.Random(edits)
    passage = [f"p{k}" for k in range(40)]
    rows = linked_sets(edits, 4, 25, 100, edits)
    rows = [(i, t + " " + " ".join(passage if i % 4 else rng.sample(passage, 40))) for i, t in rows]
    out = near_join.join(spark.createDataFrame(rows, "doc_id long, text string"), limit_sets=limit)
    assert by_id(out, "n_shingles", "component_id") == components(rows)


@pytest.mark.parametrize("leaf", [2, 24])
def test_connect_in_memory(leaf, monkeypatch):
    monkeypatch.setattr(voronoi, "LEAF", leaf)
    for seed in range(8):
        rows = linked_sets(seed, 5, 20, 60, 2 + seed)
        sets = list(near_join.shingle_sets([t for _, t in rows]))
        label = voronoi.connect(sets, 80)
        want = {d: c for d, _, c in components(rows)}
        groups = {}
        for (i, _), x in zip(rows, label.tolist(), strict=True):
            groups.setdefault(x, set()).add(i)
        for g in groups.values():
            assert {want[i] for i in g} == {min(g)} and g == {i for i in want if want[i] == min(g)}


def test_cells_hold_every_linked_pair():
    """Each linked pair is in a common cell, whatever the leaders are."""
    rng = np.random.default_rng(1)
    for seed in range(5):
        sets = list(near_join.shingle_sets([t for _, t in linked_sets(seed, 6, 12, 50, 8)]))
        n = np.array([len(x) for x in sets])
        pivots = [sets[i] for i in rng.choice(len(sets), 5, replace=False)]
        shared = voronoi.shared_with(pivots, np.concatenate(sets), n)
        want = np.array([[len(np.intersect1d(p, x)) for x in sets] for p in pivots])
        assert (shared == want).all()
        inside = [own for _, own in voronoi.cells(1 - shared / (n + np.array([len(p) for p in pivots])[:, None] - shared), 80)]
        for i in range(len(sets)):
            for j in range(i):
                if voronoi.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j], 80):
                    assert any(own[i] and own[j] for own in inside)


def test_components(spark):
    rng = random.Random(4)
    edges = {(a, b) for a, b in ((rng.randrange(4000), rng.randrange(4000)) for _ in range(1500)) if a != b} | {(i, i + 1) for i in range(5000, 5400)} | {(7000, i) for i in range(7001, 7500)}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    packed = [tuple(np.array(side, np.int64).tobytes() for side in zip(*part, strict=True)) for part in np.array_split(np.array(sorted(edges, key=lambda e: hash(e))), 7)]
    found = graph.as_rows(graph.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in packed], "a binary, b binary"))).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, find(x)) for x in list(parent))
    assert graph.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def kept_of(rows):
    """Rows that stay: (doc_id, text) and how often."""
    sets = [set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w := spaced(r[1])) >= 5 else {tuple(w)} if w else set() for r in rows]
    names = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = names[i], names[j]
                names = [min(a, b) if x in (a, b) else x for x in names]
    out, best = Counter(), {}
    for r, s, name in zip(rows, sets, names, strict=True):
        if r[0] is None or not s:
            out[r[0], r[1]] += 1
        else:
            best[name] = min(best.get(name, r), r, key=lambda x: x[0])
    return out + Counter((r[0], r[1]) for r in best.values())


def test_keep_one(spark, docs, rows, none):
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == kept_of(rows)
    assert near_join.keep_one(none).count() == 0
    # unrelated texts of one doc_id, repeated rows, columns with names that need quotes
    more = [(1, prose(1, 40), 7, "a", 1.0), (1, prose(2, 40), 7, "a", 1.0), (1, prose(1, 40), 7, "a", 1.0), (2, prose(1, 40), 7, "b", 2.0), (None, prose(1, 40), 7, "c", None), (3, None, 7, "d", None), (3, None, 7, "d", None)]
    schema = StructType.fromDDL("doc_id long, text string, __first int, `page-url` string, `a b.c` double")
    out = near_join.keep_one(spark.createDataFrame(more, schema))
    assert out.columns == schema.names and Counter((r[0], r[1]) for r in out.collect()) == kept_of(more)
    assert {r["__first"] for r in out.collect()} == {7}


def test_any_column_name_passes(spark):
    schema = StructType.fromDDL("doc_id long, text string, lang string, `page-url` string, `a b.c` double, row int, words int")
    docs = spark.createDataFrame([(i, prose(i, 30), "en", "u", 1.0, 1, 2) for i in range(20)], schema)
    items = spark.createDataFrame([(None, prose(3, 30)), (7, prose(3, 30)), (None, None)], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items)
    assert out.columns == schema.names and out.count() == 19
    hit = decontaminate.report(docs, items).where("contaminated").collect()
    assert [(r.doc_id, r.n_items, r.items_sha256) for r in hit] == [(3, 1, hashlib.sha256(b"7").hexdigest())]
    assert language.identify(docs, language.fit(docs)).select("row.*").columns == schema.names
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).select("row.*").columns == schema.names
    assert token_counts.token_counts(docs, schema.names).columns[:7] == schema.names
    assert pieces.encode(docs, schema.names).columns[:7] == schema.names
    assert all(f.collect() for f in (token_counts.token_counts(docs, schema.names), pieces.encode(docs, schema.names)))


def test_suffix_tree(docs, rows, none):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    model, words = suffix_tree.train(docs.where(~suffix_tree.held_out(F.col("doc_id"))))
    c = Counter(w for r in train for w in [*spaced(r[1]), None])
    n, v = sum(c.values()), len(c)
    found = sorted((tuple(r) for r in suffix_tree.score(docs, model, words).collect()), key=repr)
    want = sorted(((r[0], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for r in rows for t in [[*spaced(r[1]), None]]), key=repr)
    for got, exact in zip(found, want, strict=True):
        assert got[:4] == exact[:4] and math.isclose(got[4], exact[4], rel_tol=1e-9) and got[5] < 0
    assert suffix_tree.score(none, model, words).count() == 0
    empty, counts = suffix_tree.train(none)
    assert suffix_tree.score(docs, empty, counts).count() == len(rows)


def test_suffix_tree_states_of_whole_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(150)]
    passage = "quartz ridge velvet lantern hollow"
    texts += [passage, f"x {passage}", f"{passage} y", "quartz velvet ridge hollow lantern", None, "", passage, "z" * 100_000 + " " + passage]
    learned = [i % 3 != 0 or i >= 150 for i in range(len(texts))]
    learned[152] = learned[153] = False
    docs = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(texts, learned, strict=True))], "doc_id long, text string, mine boolean")
    model, counts = suffix_tree.train(docs.where("mine"))
    plain = {r.doc_id: r.score for r in suffix_tree.score(docs, model, counts).collect()}
    found = {r.doc_id: r.score for r in suffix_tree.score(docs, model, counts, F.col("mine")).collect()}

    def units(text):
        chunk = vectext.Chunk([text or ""])
        codes = vectext.lower_ascii(chunk.codes)
        starts, _ = vectext.runs(~vectext.white(codes))
        symbols, begin = model.tree.alphabet.spelled(chunk, codes, starts, chunk.per_text(starts))
        logs, out = model.tree.each(symbols, begin), [0.0]
        for s, x in zip(symbols.tolist(), logs.tolist(), strict=True):
            out[-1] += x
            if s in (suffix_tree.GAP, suffix_tree.END):
                out.append(0.0)
        return out[:-1]

    places = []  # text, context, following word and whether it is the last, probability in the shorter suffix
    for i, text in enumerate(texts):
        own, logs = spaced(text), units(text)
        assert math.isclose(sum(logs), plain[i], rel_tol=1e-6)
        places += [(i, own[k], (own[k + 1], k + 2 == len(own)), 10 ** max(logs[k + 1], -300)) for k in range(len(own) - 1)]
    hot = {w for w, n in Counter(w for x, y in zip(texts, learned, strict=True) if y for w in spaced(x)).items() if n >= suffix_tree.HOT_LEAST}
    followers = {}
    for i, w, x, _ in places:
        if learned[i] and w not in hot:
            followers.setdefault(w, Counter())[x] += 1
    want, states = dict(plain), set()
    for w, n in followers.items():
        total, gain = sum(n.values()), 0.0
        for i, v, x, p in places:
            if v == w and learned[i]:
                weight = max(len(n) - (n[x] == 1), 1)
                gain += math.log(((n[x] - 1) / p + weight) / (total - 1 + weight))
        if total >= 2 and gain / total >= suffix_tree.DIVERGENCE:
            states.add(w)
    for i, w, x, p in places:
        if w in states:
            n = followers[w]
            want[i] += math.log10((n[x] / p + len(n)) / (sum(n.values()) + len(n)))
    assert {"quartz", "ridge", "velvet", "lantern"} <= states and len(found) == len(texts)
    assert all(math.isclose(found[i], want[i], rel_tol=1e-3, abs_tol=0.05) and found[i] < 0 for i in want)
    assert found[152] > plain[152] and found[153] < plain[153]


def test_suffix_tree_states_of_frequent_words(spark):
    rng = random.Random(9)
    words = ["a", "be", "orville", "deville", "merville"] + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(x for _ in range(rng.randrange(1, 9)) for x in (rng.choice(words[:5]), rng.choice(words), rng.choice(["deville quartz", "orville a velvet", "merville ridge", "be"]))) for _ in range(200)]
    texts += ["deville quartz", "deville ridge", "orville a velvet", None, "", texts[7], "orville", "unseen deville unseen"]
    learned = [i % 4 != 0 and i < 200 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(texts, learned, strict=True))], "doc_id long, text string, mine boolean").repartition(3)
    model, counts = suffix_tree.train(docs.where("mine"))
    plain = {r.doc_id: r for r in suffix_tree.score(docs, model, counts).collect()}
    found = {r.doc_id: r for r in suffix_tree.score(docs, model, counts, F.col("mine")).collect()}
    n = Counter(w for x, y in zip(texts, learned, strict=True) if y for w in spaced(x))
    hot = {w for w in n if n[w] >= suffix_tree.HOT_LEAST}
    assert {"a", "be", "orville", "deville", "merville"} <= hot and len(hot) < len(n)

    places = []  # text, context, following word and whether it is the last, probability in the shorter suffix
    for i, text in enumerate(texts):
        chunk = vectext.Chunk([text or ""])
        starts, _ = vectext.runs(~vectext.white(chunk.codes))
        symbols, begin = model.tree.alphabet.spelled(chunk, chunk.codes, starts, chunk.per_text(starts))
        stops = np.flatnonzero((symbols == suffix_tree.GAP) | (symbols == suffix_tree.END))
        logs = [x.sum() for x in np.split(model.tree.each(symbols, begin), stops[:-1] + 1)]
        own = spaced(text)
        places += [(i, own[k], (own[k + 1], k + 2 == len(own)), 10 ** max(logs[k + 1], -300)) for k in range(len(own) - 1)]
    followers = {}
    for i, w, x, _ in places:
        if learned[i]:
            followers.setdefault(w, Counter())[x] += 1
    want, states = {i: r.score for i, r in plain.items()}, set()
    for w, n in followers.items():
        total, gain = sum(n.values()), 0.0
        for i, v, x, p in places:
            if v == w and learned[i]:
                weight = max(len(n) - (n[x] == 1), 1)
                gain += math.log(((n[x] - 1) / p + weight) / (total - 1 + weight))
        if total >= 2 and gain / total >= suffix_tree.DIVERGENCE:
            states.add(w)
    for i, w, x, p in places:
        if w in states:
            n = followers[w]
            want[i] += math.log10((n[x] / p + len(n)) / (sum(n.values()) + len(n)))
    assert {"orville", "deville", "merville"} <= states and len(found) == len(texts)
    assert all(math.isclose(found[i].score, want[i], rel_tol=1e-3, abs_tol=0.05) for i in want)
    assert all(found[i][:4] == plain[i][:4] and math.isclose(found[i].base_score, plain[i].base_score, rel_tol=1e-9) for i in plain)
    assert found[200].score > plain[200].score and found[201].score < plain[201].score
    alone = suffix_tree.score(docs.where("doc_id in (203, 204, 206)"), model, counts, F.col("mine")).collect()  # no place to look up
    assert {r.doc_id: r.score for r in alone} == {i: plain[i].score for i in (203, 204, 206)}


def test_suffix_tree_moves_few_bytes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    model, words = suffix_tree.train(docs)
    rows = docs.selectExpr("doc_id", "text", "doc_id % 7 != 2 AS learned").toArrow().to_batches(100)
    size = lambda batches: sum(len(x) for b in batches for c in b.columns if pa.types.is_binary(c.type) for x in c.drop_null().to_pylist())
    first = list(suffix_tree._first_pass(SimpleNamespace(value=model), 20, True)(rows))
    assert len(model.hot) and size(first) < 10.5 * model.tokens  # 9.0; before arrays were squeezed 13.6, 12.0 with LZ4
    parts, counts = suffix_tree.parts_for(docs), {r["bucket"]: r for r in words.collect()}

    def scored(rows, lose=False):
        """The maps of ``score`` without Spark's exchanges; states of broadcast words are none, since their sums are zeros."""
        first = [b for some in rows for b in suffix_tree._first_pass(SimpleNamespace(value=model), parts, True)(some)]
        deal = lambda batches: [[b.filter(pc.equal(b.column("bucket"), k)) for b in batches] for k in range(parts)]
        zeros = {"totals": bytes(16 * len(model.hot)), "divergence": bytes(8 * len(model.hot))}
        second = []
        for k, own in enumerate(deal(first)):
            for name in ("keys", "counts", *zeros):
                own = [b.append_column(name, pa.array([zeros.get(name)] * b.num_rows, pa.binary())) for b in own]
            if k in counts:
                own.insert(0, pa.RecordBatch.from_arrays([pa.array([counts[k][c.name] if c.name in ("bucket", "keys", "counts") else None], c.type) for c in own[0].schema], schema=own[0].schema))
            second += suffix_tree._second_pass(parts, True)(own)
        if lose:
            second = second[:-1]
        return sorted((tuple(r.values()) for own in deal(second) for b in suffix_tree._sum_texts(own) for r in b.to_pylist()), key=repr)

    once = scored([rows])
    want = sorted((tuple(r)[:3] for r in suffix_tree.score(docs, model, words).collect()), key=repr)
    assert counts and [r[:3] for r in once] == want
    with pytest.raises(RuntimeError, match="pieces of a pack"):
        scored([rows], lose=True)
    twice = scored([rows, rows])  # two packs that are alike
    assert [r[:3] for r in twice] == [r[:3] for r in once for _ in range(2)]
    monkeypatch.setattr(suffix_tree, "TEXTS", 30)
    for many, one in zip(scored([rows]), once, strict=True):
        assert many[:3] == one[:3] and math.isclose(many[3], one[3], rel_tol=1e-9) and math.isclose(many[4], one[4], rel_tol=1e-6)


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_squeezed_arrays(n):
    rng = np.random.default_rng(n)
    keys = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
    arrays = [suffix_tree.steps(keys), rng.integers(0, 3, n, np.uint32), rng.normal(size=n), rng.normal(size=n).astype(np.float16), np.zeros(n, np.int64) - 1]
    data = suffix_tree.squeezed(*arrays)
    found = suffix_tree.unsqueezed(data, *(a.dtype for a in arrays))
    assert all(a.dtype == b.dtype and a.tobytes() == b.tobytes() for a, b in zip(arrays, found, strict=True))
    assert np.array_equal(np.cumsum(suffix_tree.unsqueezed(data, np.uint64)[0], dtype=np.uint64), keys)


def test_suffix_tree_is_a_distribution(docs):
    tree = suffix_tree.train(docs)[0].tree
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(1), 1, atol=1e-4)
    assert len(tree.contexts[1]) > 3
    for d in range(2, suffix_tree.DEPTH + 1):  # suffixes of states are states
        assert set((tree.contexts[d] & np.uint64((1 << 6 * (d - 1)) - 1)).tolist()) <= set(tree.contexts[d - 1].tolist())


def test_suffix_tree_spells_rare_code_points(spark):
    frequent = [chr(0x4E00 + i) for i in range(suffix_tree.SYMBOLS)]
    texts = ["".join(frequent) * 5] * 40 + ["жю"] * 150 + ["".join(chr(0x5000 + i) for i in range(4000))] + ["жш", "шю"]
    model, words = suffix_tree.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    asked = ["жю", "юж", "шю", "ыю", "\U0010ffff"]
    rows = suffix_tree.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, words).collect()
    score = {asked[r.doc_id]: r.score for r in rows}
    assert score["жю"] > score["шю"] + 1 > score["ыю"] + 2 and score["жю"] > score["юж"] + 1 and all(map(math.isfinite, score.values()))
    # spellings can be read back
    alphabet = model.tree.alphabet
    chunk = vectext.Chunk(["ж 一", "", "\U0010ffffш" + chr(0x5000 + 3999)])
    starts, _ = vectext.runs(~vectext.white(chunk.codes))
    symbols, begin = alphabet.spelled(chunk, chunk.codes, starts, chunk.per_text(starts))
    back = {(int(alphabet.table[c]), int(alphabet.number[c])): chr(c) for c in map(ord, "жш\U0010ffff" + chr(0x5000 + 3999))}
    out, i = [], 0
    while i < len(symbols):
        digits = suffix_tree.ESCAPED.get(int(symbols[i]), 0)
        number = 0
        for d in symbols[i + 1 : i + 1 + digits]:
            number = number * suffix_tree.DIGITS + int(d) - suffix_tree.FIRST
        out.append(back[int(symbols[i]), number] if digits else {suffix_tree.END: "|", suffix_tree.GAP: " "}.get(int(symbols[i]), "一"))
        i += 1 + digits
    assert "".join(out) == "ж 一||\U0010ffffш" + chr(0x5000 + 3999) + "|"
    assert begin.tolist() == [0, begin[1], begin[1] + 1, len(symbols)]


def test_toxicity_chain(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)]
        toxic, low = i % 5 == 0, i % 3 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grobian", "lump"])
        rows.append((i, " ".join(words) + " |%|" * (10 if low else 0)))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    rows += [(1000, None), (1001, ""), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, table)
    out = {r.row.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(docs, chain).collect()}
    assert all((out[i][1] >= 0.5) == (i % 5 == 0) and (out[i][0] >= 0.5) == (i % 3 == 0) for i in range(600))
    assert out[1000][1] < 0.5 and toxicity.score(docs, chain).count() == len(rows)
    unlabelled = toxicity.fit(docs, table.where("false"))
    assert all(r.p_toxic == 0 for r in toxicity.score(docs, unlabelled).collect())
    assert toxicity.score(none, chain).count() == 0


def test_toxicity_with_labels_of_one_category(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grobian", "lump"])
        rows.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    rows += [(2000 + i, f"xyz {i}") for i in range(400)]
    labels += [(2000 + i, 1, None) for i in range(400)] + [(3000, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for chain in (toxicity.fit(docs, table), toxicity.train(docs, table.withColumn("quality", 1 - F.col("quality")), ["quality", "toxic"], 500)):
        out = {r.row.doc_id: (r[1], r[2]) for r in toxicity.score(docs, chain, ["doc_id"]).collect()}
        found = [i for i in range(600) if out[i][1] >= 0.5]
        assert all(i % 5 == 0 for i in found) and len(found) > 100
        assert {p for p, _ in out.values()} == {0.0}


def test_token_counts(docs, rows, none):
    c = token_counts.Counter("byte_bpe_50k.json")
    found = token_counts.token_counts(docs, ["doc_id"])
    assert by_id(found, "n_bytes", "n_tokens") == expected(rows, lambda t: (len(t.encode()), c.whole(t)))
    assert token_counts.token_counts(none, ["doc_id"]).count() == 0


def test_splitter_against_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'smtdrevlL \n\t.!1²é\xa0日") for _ in range(rng.randrange(40))) for _ in range(2000)]
    c = token_counts.Counter("byte_bpe_50k.json")
    assert c.counts(texts).tolist() == [c.whole(t) for t in texts]
    e = token_shards.Encoder("word_bpe_49k.json")
    assert [x.tolist() for x in e.encode(texts)] == [[*e.library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def best_score(m, word):
    """All segmentations, by plain dynamic programming over every substring."""
    values = {p: s for p, (_, s, _) in ((k, v) for k, v in m.automaton.items())}
    best = [0.0] + [-1e300] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            if piece in values:
                best[end] = max(best[end], best[start] + values[piece])
        if word[end - 1] not in values:
            best[end] = max(best[end], best[end - 1] + m.fallback)
    return best[-1]


def test_pieces(docs, rows, none):
    m = pieces.model("piece_bpe_32k.model")
    rng = random.Random(4)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("theandingéß日\x01") for _ in range(rng.randrange(12)))
        assert math.isclose(m.viterbi(word)[0], best_score(m, word))
    out = pieces.encode(docs, ["doc_id"]).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        assert m.decode(np.array(r.ids, np.int64)) == texts[r.doc_id] and r.n_tokens == len(r.ids)
    assert pieces.encode(none, ["doc_id"]).count() == 0


def test_warc(spark):
    same = "é" * 600
    rows = [(1, "http://a/x y", same), (2, None, same), (9, "u", same), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "\r\n\r\nContent-Length: 3\r\n\r\n" * 200), (None, "u", same), (9, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    raw, members = shared_folder(spark, "raw"), shared_folder(spark, "members")
    out = warc.read(warc.normalised(warc.archive(pages, raw, file_bytes=2000), raw, members), members)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = html == same and page_id is not None and page_id < 9
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    raw, members = shared_folder(spark, "raw"), shared_folder(spark, "members")
    assert warc.read(warc.normalised(warc.archive(pages.where("false"), raw), raw, members), members).count() == 0


def test_normaliser_reads_members_by_offset():
    import gzip

    records = [warc.warc_record(i, "u", b"p" * i, i, hashlib.sha1(b"p" * i).hexdigest()) for i in range(50)]
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out))
    assert [warc.read_member(out, o, n)["payload"] for o, n, _, _ in index] == [b"p" * i for i in range(50)]
    assert gzip.decompress(out.getvalue()) == b"".join(records)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.normalise(io.BytesIO(gzip.compress(b"".join(records)[:-30])), io.BytesIO()))


def test_language(spark, docs, rows, none):
    train = spark.createDataFrame([(i, prose(i, 40, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    model = language.fit(train)
    out = {r.row.doc_id: (r.lang_pred, r.score, r.spans) for r in language.identify(docs, model, ["doc_id"], spans=True).collect()}
    assert out[9][0] == out[12][0] == out[30][0] == "und" and out[36][0] == "de" and out[0][0] == "en"
    assert all(0 <= s <= 1 for _, s, _ in out.values())
    mixed = spark.createDataFrame([(1, prose(500, 60, "en") + " " + prose(501, 40, "de"))], "doc_id long, text string")
    r = language.identify(mixed, model, spans=True).first()
    assert [s.lang for s in r.spans] == ["en", "de"] and r.lang_pred == "en"
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(none)).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    rows = [(i, prose(i, 5), "en") for i in range(2500)] + [(None, "μια γλώσσα που έχει μόνο μια γραμμή", "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["el", "en"]
    out = {r.row.lang: r.lang_pred for r in language.identify(docs, model, ["lang"]).collect()}
    assert out == {"el": "el", "en": "en"}
    small = language.train(docs, train_docs=100)
    assert small.languages == ["el", "en"] and len(small.table[0]) == 2
    greek = language.identify(docs.where("lang = 'el'"), small, ["lang"]).first()
    assert greek.lang_pred == "el" and greek.score == 1


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    scores, first = rng.normal(0, 6, (16, 3)), np.array([0, 6, 6, 11, 16])
    labels = language.viterbi(scores, first, 5.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 5.0 * sum(x != y for x, y in itertools.pairwise(p))
        if b > a:
            assert math.isclose(value(labels[a:b].tolist()), max(map(value, itertools.product(range(3), repeat=b - a))))
