import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.llm import bpe, graph, langid, mixing, quality, queries, shared, simhash, spans, textscan, topk, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, taken int, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [
        (1, "the quick brown fox. jumps over it. and runs away now. once more today.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, "   \n\t ", None, "b"),
        (5, "the quick brown fox. jumps over it. and runs away now. once more today.", "en", "a"),
        (5, "the quick brown fox. jumps over it. and runs away now. once more today.", "en", "a"),
        (None, "no id here", "de", None),
        (7, long, "en", "b"),
        (8, "12 34 !?", "de", "c"),
        (9, "日本語 текст mixed ünïcode 😀", None, "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, 0) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(sf_dir):
    return duckdb.sql(f"select * from '{sf_dir}/documents.parquet' order by doc_id").df()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda d: d[cols].astype(object).where(d[cols].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).astype(str).sort_values(cols).values.tolist()
    assert plain(got) == plain(want)


# 1


def test_language_id_held_out(spark, sf_dir):
    d = docs_of(sf_dir).set_index("doc_id")
    got = queries.queries()["op1_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == d.lang.loc[held.index]).mean() >= 0.95
    assert got.score.between(0, 1).all() and len(got) == len(d)


def test_language_id_marks_spans_and_odd_rows(spark, sf_dir, odd, empty):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    d = docs_of(sf_dir)
    en, de = (" ".join(d[(d.lang == g) & (d.n_chars > 1500)].text.iloc[0].split()[:60]) for g in ("en", "de"))
    _, _, marked = langid.label([en + " " + de], model)
    assert [s[2] for s in marked[0]] == ["en", "de"] and abs(marked[0][0][1] - len(en)) < 20
    got = {(r["doc_id"]): r for r in langid.identify(odd, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == got[8]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[9]["lang_pred"] in model["languages"]
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(odd, langid.train(empty)).select("lang_pred").distinct().first()[0] == "und"


def test_marks_are_no_letters(spark, sf_dir):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert langid.label(["\u2764\ufe0f 123", "\u0301 \u0308", "e\u0301t\u00e9"], model)[0][:2] == ["und", "und"]
    assert langid.label(["\u0301 a", "\u0301"], model)[2][1] == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 7), min_size=1, max_size=4), st.integers(0, 9))
def test_viterbi_is_exact(lengths, seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(size=(sum(lengths), 3))
    texts = np.repeat(np.arange(len(lengths)) * 2, lengths)
    got = langid.viterbi(scores, texts, 1.5)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p: sum(s[k, j] for k, j in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(value(p) for p in np.ndindex(*[3] * n))
        assert math.isclose(value(got[at : at + n]), best, abs_tol=1e-9)
        at += n


# 2


def test_url_filter_carries_over_aliases(spark):
    link = lambda u: f'<head><link href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://a.example.net/x", None),
        (2, "http://Mirror.org/p", link("https://a.example.net/x#top")),
        (3, "http://mirror.org/q", '<meta http-equiv="refresh" content="0; url=/p">'),
        (4, "http://a.example.net/en/ok", ""),
        (5, "http://other.com/z", link("http://a.example.net/en/ok") + link("http://x.net/bad")),
        (6, None, "x"),
        (7, "no scheme", link("http://x.net/")),
        (8, "http://x.net?a", ""),
        (8, "http://x.net?a", ""),
        (9, "http://alone.com/#f", "<p>canonical</p>"),
        (10, "http://later.com/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = spark.createDataFrame([("http://later.com/", "http://mirror.org/q"), (None, "x://y")], "src string, dst string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages, more).collect()}
    assert [got[k]["verdict"] for k in range(1, 11)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[1]["rule"] == "net/" and got[4]["rule"] == "example.net/en/" and got[2]["rule"] is None and got[8]["path"] == ""
    assert got[10]["n_aliases"] == 4 and got[6]["host"] == "" and urlfilter.filter_urls(pages, more).count() == 11
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_references_are_resolved_and_sql_agrees(spark, tmp_path):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.com/x/y?q", link("/go?u=http://x.net/b")),
        (2, "http://b.com/x/y.html", link("d.html")),
        (3, "http://b.com/x/d.html", link("http://z.net/bad")),
        (4, "http://c.com/p", link("?id=3")),
        (5, "http://c.com/p?id=3", link("https://w.org/fr/x?a=1&amp;b=2")),
        (6, "http://w.org/fr/x?a=1&b=2", None),
        (7, "http://e.com/a/b/c", link("../../t/./u")),
        (8, "http://e.com/t/u", '<meta http-equiv=refresh content="0;url=//q.net/">'),
        (9, "http://f.com", '<base href="http://g.com/k/">' + link("l")),
        (10, "http://g.com/k/l", link("http://r.net/") + link("mailto:a@b") + link("#top")),
        (11, "http://h.com/a/", link("..")),
        (12, "http://h.com/", link("http://r.net/")),
        (13, "nothing", link("x")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages).collect()}
    verdicts = "allow block block allow allow allow block block block block block block allow".split()
    assert [got[k]["verdict"] for k in range(1, 14)] == verdicts
    edges = {(r["src"], r["dst"]) for r in urlfilter.alias_edges(pages).collect()}
    assert ("http://a.com/x/y?q", "http://a.com/go?u=http://x.net/b") in edges and ("http://h.com/a/", "http://h.com/") in edges
    assert not any(d.startswith(("mailto", "#")) for _, d in edges)
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    want = {r[0]: r for r in con.sql(urlfilter.OP2_SQL).fetchall()}
    assert {k: (r["verdict"], r["n_aliases"], r["rule"]) for k, r in got.items()} == {k: (r[4], r[5], r[3]) for k, r in want.items()}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(999, 999), (500, None)] + [(600, k) for k in range(601, 660)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = dict(map(tuple, graph.connected_components(df).collect()))
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(df.limit(0)).count() == 0


# 3


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://h/{k} ü", f"<html>{k % 7} " + "word " * 50 + "</html>") for k in range(60)] + [(61, None, None), (62, "u", ""), (None, "n", "solo"), (64, "big", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    back = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(back) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "")]
        win = max((i for i in same if i is not None), default=None)
        r = back[k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if k == win else ("revisit", win))
        assert r["payload"] == (data if k == win else None)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    assert all(f.read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little") for f in files if f.stat().st_size)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


# 4


def tiktoken_of():
    import public_tokenizers as P
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder.load(path, pattern)


def test_bpe_equals_the_library(spark, sf_dir):
    lib, own = tiktoken_of()
    d = docs_of(sf_dir)
    got = queries.queries()["op4_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(d.doc_id, d.text, strict=True):
        ids = lib.encode_ordinary(t or "")
        r = got.loc[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    rng = random.Random(3)
    letters = [*"abcdeth  \n\t'sreé日本語한１ ٣\x1c\x85_-#!?😀👍ßÅ̊", "'ll", "'re", "  ", "ing", "𝒜"]
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert own.encode(s) == lib.encode_ordinary(s) and own.decode(own.encode(s)) == s.encode()


@settings(max_examples=60, deadline=None)
@given(st.text("ethrins -'é", max_size=80), st.integers(0, 80), st.integers(0, 20), st.text("ethrins", max_size=10))
def test_bpe_appends_and_edits_are_exact(text, at, gone, new):
    own = test_bpe_appends_and_edits_are_exact.encoder
    data = text.encode()
    at, gone = min(at, len(data)), min(gone, max(0, len(data) - at))
    p = bpe.Prefixes(own, data)
    p.edit(at, at + gone, new.encode())
    p.append(b" more")
    assert p.last == bpe.Prefixes(own, p.data).last and own.decode(p.tokens()) == p.data


test_bpe_appends_and_edits_are_exact.encoder = bpe.Encoder.load(*bpe.vocabulary())


def test_bpe_odd_rows(spark, odd, empty):
    back = bpe.decode_documents(bpe.encode_documents(odd, *bpe.vocabulary()), *bpe.vocabulary())
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"]) for r in back.collect())
    assert set(odd.columns) < set(back.columns) and bpe.encode_documents(empty, *bpe.vocabulary()).count() == 0


# 5


def fingerprint_of(text, k=3):
    words = WORD.findall((text or "").translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)))
    grams = [" ".join(words[j : j + k]) for j in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def grouped(fps, reach):
    root = {}
    for f in fps:
        root.setdefault(f, f)
    names = list(root)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            if (a ^ b).bit_count() <= reach:
                root[find(a)] = find(b)
    return {f: find(f) for f in names}


def test_simhash_equals_brute_force(spark, sf_dir):
    d = docs_of(sf_dir)
    got = queries.queries()["op5_simhash"](spark, sf_dir).toPandas().set_index("doc_id")
    fps = {i: fingerprint_of(t) for i, t in zip(d.doc_id, d.text, strict=True)}
    root = grouped(fps.values(), 2)
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    for i in fps:
        assert got.loc[i].fingerprint == f"{fps[i]:016x}" and got.loc[i].component_id == first[root[fps[i]]]


@pytest.mark.parametrize("depth_leaf", [(40, 7), (10**6, 65_536), (60, 32)])
def test_vantage_trees_lose_no_link(spark, monkeypatch, depth_leaf):
    leaf, block = depth_leaf
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(250)] + [0, 1, 3]
    for f in fps[:120]:
        fps.append(f ^ (1 << rng.randrange(64)))
        fps.append(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << a) for a in range(64)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r["node"] & (2**64 - 1): r["root"] for r in simhash.components(df, 2, leaf).collect()}
    want = grouped(fps, 2)
    groups = defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
    for g in groups.values():
        assert len({got.get(f) for f in g}) == 1 and (len(g) == 1) == (next(iter(g)) not in got)


def test_similar_documents_find_near_copies(spark, odd):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (400, 400, 90, 1500)]
    near = lambda w, n: [("new" + str(rng.random()) if k in set(rng.sample(range(len(w)), n)) else x) for k, x in enumerate(w)]
    texts = [*base, near(base[0], 6), near(base[3], 20), base[2], [*base[1][:200], *base[0][:200]]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = dict((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect())
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 3, 6: 2, 7: 7}
    groups = simhash.similar_documents(odd)
    kept = simhash.one_of_each(odd, groups)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 8, 9] and kept.columns == odd.columns


def linked_by_brute_force(texts, similarity=0.8, k=5):
    """The groups of texts (a dict by id) whose sets of k words link at the similarity, as sets of ids."""
    grams = {}
    for i, t in texts.items():
        w = t.lower().split()
        grams[i] = {" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    holders, counts, root = defaultdict(list), Counter(), {i: i for i in texts}
    for i, g in grams.items():
        for x in g:
            counts.update((j, i) for j in holders[x])
            holders[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), both in counts.items():
        if both / (len(grams[i]) + len(grams[j]) - both) >= similarity:
            root[find(i)] = find(j)
    groups = defaultdict(set)
    for i in texts:
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def groups_of(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[r["component_id"]].add(r["doc_id"])
    return {frozenset(g) for g in groups.values()}


def test_similar_documents_equal_brute_force(spark, monkeypatch):
    """Both ways: texts from 0.7 to 0.9, cells with few sets and with many, tiles, and shingles that all texts share."""
    rng = random.Random(5)
    line = [f"c{k}" for k in range(30)]
    texts = []
    for n in (20, 60, 150, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(30_000)}" for _ in range(n)]
            texts.append(base)
            for share in (0.01, 0.02, 0.02, 0.025, 0.03, 0.04):
                texts.append([f"x{rng.random()}" if rng.random() < share else w for w in base])
            texts.append(base[: int(n * rng.uniform(0.75, 0.9))])
            texts.append(line + base)
    base = [f"h{k}" for k in range(120)]
    texts += [[f"y{rng.random()}" if rng.random() < 0.022 else w for w in base] for _ in range(60)]
    texts += [line, line + line, []]
    texts = {k: " ".join(t) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = linked_by_brute_force(texts)
    assert sum(len(g) > 1 for g in want) > 20 and sum(len(g) == 1 for g in want) > 20
    for few, tile, sampled in ((16, 1 << 21, 16_384), (2, 1000, 0)):
        for name, value in (("FEW", few), ("TILE", tile), ("SAMPLED", sampled)):
            monkeypatch.setattr(simhash, name, value)
        assert groups_of(simhash.similar_documents(df).collect()) == want


def test_similar_documents_link_beyond_15_bits(spark):
    """Pairs at 0.8 or more whose fingerprints lie far apart."""
    rng, texts = random.Random(3), {}
    while len(texts) < 12:
        a = [f"w{rng.randrange(9_000)}" for _ in range(44)]
        b = [*a[:40], *(f"v{rng.randrange(9_000)}" for _ in range(4))]
        if (fingerprint_of(" ".join(a), 5) ^ fingerprint_of(" ".join(b), 5)).bit_count() > 15:
            texts |= {len(texts): " ".join(a), len(texts) + 1: " ".join(b)}
    got = groups_of(simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert got == {frozenset((k, k + 1)) for k in range(0, 12, 2)}


def test_similar_documents_compare_sets(spark):
    """A text and the same twice in a row have nearly one set of shingles: 296 of 300."""
    text = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(1, text), (2, f"{text} {text}"), (3, f"{text} {text} {text}"), (4, text.replace("w", "v"))], "doc_id long, text string")
    assert groups_of(simhash.similar_documents(df).collect()) == {frozenset((1, 2, 3)), frozenset((4,))}


def test_one_of_each_keeps_different_texts_of_an_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(50)) for c in "abc"]
    rows = [(1, texts[0]), (2, texts[0] + " more"), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[1]), (4, ""), (4, ""), (4, None), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.one_of_each(df, simhash.similar_documents(df)).collect()]
    assert Counter(kept) == Counter([(1, texts[0]), (2, texts[1]), (2, texts[2]), (4, ""), (4, None), (None, texts[0])])


def test_simhash_odd_rows(spark, odd, empty):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 10 and {r[2] for r in got if r[0] in (2, 3, 4)} == {2} and {r[2] for r in got if r[0] in (1, 5)} == {1}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_documents(empty).count() == 0


# 6


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(1)
    plain = [f"word{k}" for k in range(300)]
    say = lambda n: [" ".join(rng.choice(plain) for _ in range(8)) + "." for _ in range(n)]
    rows, bad_at = [], {}
    for k in range(400):
        s = say(rng.randrange(3, 12))
        if k % 4 == 0:
            bad_at[k] = rng.randrange(len(s))
            s[bad_at[k]] = f"you {rng.choice(['vile', 'rotten', 'nasty'])} " + s[bad_at[k]]
        rows.append((k, " ".join(s), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(df.where("doc_id < 300"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    test = range(300, 400)
    assert sum(got[k]["predicted"] == (k % 4 == 0) for k in test) >= 97
    assert sum(got[k]["offending"] == [bad_at[k]] for k in test if k in bad_at) >= 22


def test_toxicity_held_out_and_odd_rows(spark, odd, empty):
    small = "/root/testdata/sf0.01"
    got = queries.queries()["op6_toxicity"](spark, small).toPandas()
    lab = duckdb.sql(f"select doc_id, toxic from '{small}/labels.parquet'").df().merge(got, on="doc_id")
    held = lab[lab.held_out]
    good = (held.predicted * held.toxic).sum()
    assert good >= 0.5 * held.toxic.sum() and (held.predicted * (1 - held.toxic)).sum() <= 0.03 * len(held) and got.score.between(0, 1).all()
    model = {"ids": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -5.0}
    out = {r["doc_id"]: r for r in toxicity.score_documents(odd, model).collect()}
    assert out[2]["score"] == out[3]["score"] == 0 and out[9]["n_sentences"] == 1
    assert toxicity.score_documents(empty, model).count() == 0
    blank = toxicity.train(odd.select("doc_id", "text").withColumn("label", F.lit(None).cast("int")))
    assert len(blank["ids"]) == 0


# 7


def test_mixing_rows_that_share_id_and_text(spark):
    rows = [(1, "a b c", "s")] * 3 + [(2, "d e", "s"), (2, "f g", "s"), (None, "h", "t"), (None, "i", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs)
    out = mixing.mixed_documents(docs, taken).collect()
    budget = {r["source"]: int(r["target"]) for r in taken.collect()}
    assert budget == {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in "st"}


def test_mixing_by_a_plain_loop(spark, odd, empty):
    rng = random.Random(4)
    rows = [(k, " ".join("x" * rng.randrange(0, 30)), None if k % 11 == 0 else "abcd"[min(3, rng.randrange(9))]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, pot = {}, set(), 1.5 * sum(size.values())
    while True:
        share = (pot - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and share * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = 2.0 * size[s] if s in full else share * weight[s]
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12) and r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(target[s]) for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    whole = mixing.mixed_documents(df, mixing.mix(df))
    assert whole.select(F.sum(shared.word_count("text"))).first()[0] == sum(taken.values()) and whole.columns == df.columns
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd, mixing.mix(odd)).columns == odd.columns


# 8


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc"]), max_size=40))
def test_repeated_words_brute_force(words):
    seen = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    cover = {k + j for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for j in range(5)}
    assert quality.repeated_words(ids, len(seen)) == len(cover)


def test_quality_base_counts_and_outliers(spark, sf_dir, odd, empty):
    d = docs_of(sf_dir).set_index("doc_id")
    got = queries.queries()["op8_quality"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in d.text.items():
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    rows = [(k, " ".join(f"word{(k * 37 + j) % 1000}" for j in range(100 + k % 80)), "en", "s") for k in range(400)]
    junk = [(1000 + k, " ".join(f"word{(k * 7 + j) % 997}###" for j in range(120)), "en", "s") for k in range(40)]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[k] for k, *_ in junk) and sum(out[k] for k, *_ in rows) == len(rows)
    strange = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert strange[2]["base_failed"] and strange[3]["n_words"] == 0 and strange[7]["n_words"] == 60_000 and quality.judge(empty).count() == 0


def test_quality_verdicts_by_brute_force(spark):
    """Verdicts against a minimum covariance determinant from 60 random starts with exact steps, on the same vectors."""
    rng = random.Random(8)
    rows = []
    for k in range(500):
        n = int(rng.lognormvariate(4.5, 0.6)) + 12
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        if k % 40 == 7:
            words = [w + "#*|" * 3 for w in words]
        if k % 40 == 13:
            words = [w * 9 for w in words]
        rows.append((k, " ".join(words), "en", "a"))
    docs = spark.createDataFrame(rows, DOCS.split(", n_chars")[0])
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    vec = quality.base_statistics(docs).select("doc_id", *quality.statistic_vector()).toPandas().set_index("doc_id")
    x, floor, h = vec.to_numpy() / quality.UNIT, np.diag(np.square(quality.FLOOR)), int(quality.KEEP * len(vec))
    gen, best = np.random.default_rng(1), (np.inf, None, None)
    for _ in range(60):
        pick = gen.choice(len(x), 12, replace=False)
        for _ in range(30):
            center, cov = x[pick].mean(axis=0), np.cov(x[pick].T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
            pick = np.argsort(d, kind="stable")[:h]
        det = np.linalg.slogdet(np.cov(x[pick].T, bias=True) + floor)[1]
        if det < best[0]:
            best = det, center, cov
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    d /= max(1.0, np.median(d) / quality.MEDIAN)
    sure = {int(k): v <= quality.CUTOFF for k, v in zip(vec.index, d, strict=True) if abs(v / quality.CUTOFF - 1) > 0.2}
    assert len(sure) > 480 and {k: got[k]["kept"] for k in sure} == sure
    assert {k for k in sure if not sure[k]} >= {k for k in range(500) if k % 40 == 7} & set(sure)


def test_quality_judges_small_groups(spark):
    """A small source by its language's rows, a small language by all rows; too few rows in all by the base rules."""
    text = lambda k: " ".join(f"word{(k * 37 + j) % 1000}" for j in range(100 + k % 80))
    odd = " ".join(f"word{j % 997}###" for j in range(120))
    large = [(k, text(k), "en", "s") for k in range(400)]
    few = [(1000 + k, text(k), "en", "t") for k in range(9)] + [(1010 + k, text(k), "en", None) for k in range(3)]
    few += [(1020 + k, text(k), "de", "t") for k in range(4)] + [(1030, text(1), None, None)]
    planted = [(2000, odd, "en", "t"), (2001, odd, "en", None), (2002, odd, "de", "t"), (2003, odd, None, None)]
    schema = "doc_id long, text string, lang string, source string"
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(large + few + planted, schema)).collect()}
    assert len(out) == len(large + few + planted)
    assert not any(out[k]["kept"] for k, *_ in planted) and all(out[k]["kept"] for k, *_ in large + few)
    alone = quality.judge(spark.createDataFrame(few + planted, schema)).collect()
    assert all(r["d2"] is None and r["kept"] for r in alone) and len(alone) == len(few + planted)


# 9


def test_substring_dedup_brute_force(spark, sf_dir, odd, empty):
    d = docs_of(sf_dir)
    got = spans.dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().set_index("doc_id")
    parts = {i: spans.sentences((t or "").encode()) for i, t in zip(d.doc_id, d.text, strict=True)}
    first, times = {}, Counter()

    def runs(p):
        for k in range(len(p)):
            for r in range(1, len(p) - k + 1):
                n = sum(x[2] for x in p[k : k + r])
                whole = r >= spans.RUN and n >= spans.LEAST_WORDS
                if whole or (r < spans.RUN and n >= spans.LONG_WORDS):
                    yield k, r, tuple(x[3] for x in p[k : k + r])
                if whole:
                    break

    for i in sorted(parts):
        for k, _, g in runs(parts[i]):
            times[g] += 1
            first.setdefault(g, (i, k))
    for i, p in parts.items():
        gone = {k + j for k, r, g in runs(p) if first[g] != (i, k) for j in range(r)}
        assert (got.loc[i].n_sentences, got.loc[i].n_removed) == (len(p), len(gone))
        left = [x[3] for k, x in enumerate(p) if k not in gone]
        assert b" ".join(left).split() == got.loc[i].text.encode().split() and got.loc[i].n_chars == len(got.loc[i].text)
    out = {r["doc_id"]: r for r in spans.dedup_substrings(odd).collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and out[5]["n_removed"] == 4 and out[1]["n_removed"] == 0
    assert spans.dedup_substrings(empty).count() == 0


def test_spans_of_rows_without_ids(spark):
    text = " ".join(f"Word{k} goes here with some more words beside it and ends." for k in range(4))
    rows = [(None, text + " One."), (None, text + " Two."), (None, text + " Two."), (3, "Other words stand alone in this place, which nobody else has. Two of them.")]
    out = spans.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in out) in ([0, 0, 0, 4], [0, 0, 4, 4])
    names = spark.createDataFrame([(k and str(k), t) for k, t in rows], "doc_id string, text string")
    assert sorted(r["n_removed"] for r in spans.dedup_substrings(names).collect()) in ([0, 0, 0, 4], [0, 0, 4, 4])


def test_spans_within_partly_shared_sentences():
    """Two sentences of 31 words, or one of 21, between others that texts share in part only."""
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n)) + ". "
    for inner in (words("p", 10) + words("q", 21), words("r", 21)):
        a, b = (spans.sentences((words(c, 9) + inner + words(c + "z", 9)).encode()) for c in "ab")
        assert {x[2:] for x in spans.span_hashes(a)} & {x[2:] for x in spans.span_hashes(b)}


# 10


def test_topk_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=8) * (1 + k % 5)]) for k in range(300)]
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (350, [0.0] * 8), (351, [-0.001] * 8), (400, [1e9] * 8), (401, [2.5e9] * 8), (None, [1.0] * 8), (450, [3.0, 4.0])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {i: [math.floor(256 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    got = defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (i for i in whole if i is not None and i % 50 == 0):
        best = sorted(((-dot(whole[q], c), i is None, i or 0, i) for i, c in whole.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, _, _, i in best], q
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_in_blocks_of_queries(spark, sf_dir, monkeypatch):
    v = topk.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    whole = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect())) == whole and len(whole) == 50


def test_topk_prunes_by_coordinates_and_length():
    rng = np.random.default_rng(1)
    p = np.floor(rng.normal(size=(400, 16)) * 256)
    norms = np.sqrt((p * p).sum(axis=1))
    order = np.argsort(-norms)
    p, norms, ids = p[order], norms[order], np.array(order, object)
    q = p[5] * 1.0
    truth = sorted(zip(-(p @ q), ids, strict=True))
    length = float(np.linalg.norm(q))
    for k, floor, kind in ((3, 0.0, "lengths"), (1, -float(truth[0][0]), "coordinates"), (1, float(norms[0]) * length * 2, "passed")):
        best = [topk.Best(k, floor)]
        used = topk.search_bucket(ids, p, norms, q[None], np.array([length]), np.array([-1], object), best)
        assert max(used, key=used.get) == kind
        assert [r[1] for r in best[0].rows] == ([] if kind == "passed" else [i for _, i in truth[:k]])


# shared


def test_word_count(spark, odd):
    got = {r["doc_id"]: r["n"] for r in odd.select("doc_id", shared.word_count("text").alias("n")).collect()}
    assert got[2] == got[3] == got[4] == 0 and got[7] == 60_000 and got[9] == 5


def test_scan_words():
    s = textscan.Scan(["Ab c,d", "", "e\nF"])
    assert s.word_len.tolist() == [2, 1, 1, 1, 1] and s.word_text.tolist() == [0, 0, 0, 2, 2]
    assert [len(t) for _, t in textscan.chunks(["x" * textscan.CHUNK, "y", None])] == [1, 2]
